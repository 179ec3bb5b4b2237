import pytest
from pyspark.sql import functions as F

from notelake.functions import notes as N
from notelake.functions.chunks import CHUNK_CHARS, MAX_CHUNKS, chunk, chunks, passages
from notelake.functions.snippets import excerpt
from notelake.functions.text import WHITE_SPACE, not_blank, title_of, trimmed
from notelake.functions.tokens import Trie, runs, segmenter, tokens


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {_kind(v)}" for n, v in zip(names, values))).select(column(*names).alias("x")).collect()[0]["x"]


def _kind(v):
    return "string" if v is None or isinstance(v, str) else "array<double>" if isinstance(v, list) else "bigint"


@pytest.mark.parametrize(
    "body, links",
    [
        ("plain", []),
        ("[[A]] [[ B |b]] [[A]]", [("A", None), ("B", "b"), ("A", None)]),
        ("[[open [[C]]", [("open [[C", None)]),
        ("[[a\nb]] [[a\r\nb]]", []),
        ("[[ ]]", [("", None)]),
        ("[[x| ]]", [("x", None)]),
        (None, None),
    ],
)
def test_wikilinks(spark, body, links):
    got = one(spark, N.wikilinks, body)
    assert (got if got is None else [tuple(x) for x in got]) == links


def test_rewrite(spark):
    body = "[[Old]] [[ Old |me]] [[Old Two]] [[old]]"
    r = one(spark, lambda c: N.rewrite_wikilinks(c, "Old", "N$1\\w"), body)
    assert (r["body"], r["n"]) == ("[[N$1\\w]] [[N$1\\w|me]] [[Old Two]] [[old]]", 2)
    assert one(spark, lambda c: N.rewrite_wikilinks(c, "C++ (x)", "y"), "[[C++ (x)]]")["n"] == 1


@pytest.mark.parametrize("target, parts", [("work/Note", ("work", "Note")), ("work/a/b", ("work", "a/b")), ("plain", None), ("/Note", None), ("work/", None), (None, None)])
def test_split(spark, target, parts):
    got = one(spark, N.split_cross_vault, target)
    assert (got and tuple(got)) == parts


@pytest.mark.parametrize(
    "key, problem",
    [("a.md", None), ("a/b.md", None), ("โน้ต.md", None), ("", "empty"), (None, "empty"), ("a\\b.md", "backslash"), ("a\0.md", "nul"), ("/a.md", "absolute"), ("C:/a.md", "absolute"), ("a.txt", "not a note"), ("a//b.md", "segment"), ("../a.md", "segment"), ("a/./b.md", "segment")],
)
def test_validate_key(spark, key, problem):
    assert one(spark, N.validate_key, key) == problem


def test_boost(spark):
    values = [one(spark, N.degree_boost, d) for d in (0, 1, 12, 500)]
    assert values[0] == 1 and 1 < values[1] < values[2] and values[2] == values[3] == 1.25


@pytest.mark.parametrize("a, b, c", [([1.0, 0.0], [2.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0], [1.0, 2.0], 0), ([], [], 0), ([0.0, 0.0], [1.0, 1.0], 0)])
def test_cosine(spark, a, b, c):
    assert one(spark, N.cosine, a, b) == pytest.approx(c)


def test_labels_and_parts(spark):
    assert one(spark, N.source_label, "N", " ") == "N · licence not stated"
    assert one(spark, N.source_label, "N", "MIT") == "N · MIT"
    assert [one(spark, N.in_dependency_dir, k) for k in ("vendor/a.md", "a/vendor.md", "vendor", "x/Pods/a.md")] == [True, False, False, True]
    assert [one(spark, title_of, k) for k in ("a/b.md", "b.md.md", "b")] == ["b", "b.md", "b"]
    assert [one(spark, N.name_from_url, u) for u in ("https://h/x/repo.git", "git@h:x/repo/", "https://h/.git")] == ["repo", "repo", None]
    assert [one(spark, N.is_newer, a, b) for a, b in (("1.2.3", "v1.10.0"), ("1.2.3", "1.2.3"), ("x", "1.0.0"))] == [True, False, False]
    assert one(spark, N.trust, "?") == "not signed" and one(spark, N.is_sound, "U") and not one(spark, N.is_sound, "B")
    assert one(spark, N.markdown_snippet, "a <b>x</b>\nb") == "a **x** b"
    heads = one(spark, N.outline, "# A\r\ntext\n### B  \n####### no")
    assert [tuple(h) for h in heads] == [(0, 1, "A"), (2, 3, "B")]
    assert one(spark, lambda c: N.summarize_keys(F.split(c, ",")), "a,b,c,d,e,f") == "a, b, c, d, ... (+2 more)"


def test_trim(spark):
    assert one(spark, trimmed, WHITE_SPACE + "x y" + WHITE_SPACE) == "x y"
    assert one(spark, not_blank, "　") is False and one(spark, not_blank, None) is False
    assert len(WHITE_SPACE) == len(set(WHITE_SPACE)) == 25


def test_tokens(spark):
    assert one(spark, tokens, "Über-Note_2 แมวกินปลา!") == ["über", "note", "2", "แมวกินปลา"]
    assert one(spark, tokens, "x" * 100 + " " + "y" * 99) == ["y" * 99]
    assert one(spark, tokens, None) == []
    assert "".join(one(spark, runs, "abแมวcd")) == "abแมวcd"
    cut = segmenter(["แมว", "กิน", "ปลา"])
    assert one(spark, lambda c: tokens(c, cut), "แมวกินปลา cat") == ["แมว", "กิน", "ปลา", "cat"]
    assert Trie(["ab", "abc", "cd"]).cut("abcdxx") == ["ab", "cd", "xx"]


def test_chunks():
    assert chunk("") == [] and chunk(" \n") == [] and chunk("x") == ["x"]
    paragraphs = "\n\n".join("p" * 200 for _ in range(10))
    assert all(len(c) <= CHUNK_CHARS for c in chunk(paragraphs)) and "".join(chunk(paragraphs)).count("p") == 2000
    assert len(chunk("x" * (CHUNK_CHARS * (MAX_CHUNKS + 5)))) == MAX_CHUNKS
    assert chunk("a" * 600 + "\n" + "b" * 600) == ["a" * 600, "b" * 600]


def test_excerpt():
    assert excerpt("no hit at all", {"zzz"}, 20) == "no hit at all"
    body = "filler " * 50 + "cats & dogs " + "filler " * 50
    found = excerpt(body, {"cats", "dogs"}, 60)
    assert "<b>cats</b> &amp; <b>dogs</b>" in found
    assert len(found.replace("<b>", "").replace("</b>", "").replace("&amp;", "&")) <= 60
    assert excerpt("Cats", {"cats"}, 5) == "<b>Cats</b>"


def test_chunks_of_a_long_body_are_whole(spark):
    body = "x" * (CHUNK_CHARS * (MAX_CHUNKS + 5))
    notes = spark.createDataFrame([("v", "k", "t", "h", body)], "vault string, key string, title string, hash string, body string")
    assert "".join(r["chunk"] for r in chunks(notes).orderBy("chunk_ix").collect()) == body
    assert passages(notes).count() == MAX_CHUNKS + 5 and chunks(notes, MAX_CHUNKS).count() == MAX_CHUNKS
