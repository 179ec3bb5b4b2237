import pytest

from notelake.operators import graph as G
from notelake.operators import search as S

NOTES = "vault string, key string, title string, reference boolean, body string"


def notes(spark, *rows):
    return spark.createDataFrame([(v, f"{t}.md", t, False, b) for v, t, b in rows], NOTES)


def keys(df):
    return [r["key"].removesuffix(".md") for r in df.orderBy("vault", "rank").collect()]


@pytest.fixture(scope="module")
def few(spark):
    return notes(
        spark,
        ("v", "Cats", "cats eat fish and cats sleep"),
        ("v", "Dogs", "dogs eat meat; see the state-of-the-art report"),
        ("v", "Birds", "birds eat fish, the art state"),
        ("v", "Empty", ""),
        ("w", "Fish", "nothing"),
    )


@pytest.mark.parametrize(
    "query, found",
    [
        ("cats", {"Cats"}),
        ("eat fish", {"Cats", "Dogs", "Birds", "Fish"}),
        ('"eat fish"', {"Cats", "Birds"}),
        ("+eat -fish", {"Dogs"}),
        ("eat AND fish", {"Cats", "Birds"}),
        ("eat NOT fish", {"Dogs"}),
        ("(cats OR dogs) AND eat", {"Cats", "Dogs"}),
        ("title:fish", {"Fish"}),
        ("body:nothing", {"Fish"}),
        ("state-of-the-art", {"Dogs"}),
        ("path:Cats.md", {"Cats"}),
        ("EAT", {"Cats", "Dogs", "Birds"}),
        ("zzz", set()),
        ("!!", set()),
        ("-cats", set()),
    ],
)
def test_queries(few, query, found):
    assert set(keys(S.best(S.lexical(few, query), 20))) == found


@pytest.mark.parametrize("query", ["(a", "a)", "a OR", "OR a", "nosuch:a", "a AND", '"open'])
def test_unreadable_queries(query):
    with pytest.raises(S.QueryError):
        S.parse_query(query)


def test_written_index_gives_the_same(few):
    a = S.best(S.lexical(few, 'eat "the art" fish'), 20)
    b = S.best(S.lexical(few, 'eat "the art" fish', (S.postings(few), S.lengths(few))), 20)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_limits(spark):
    n = notes(spark, *[("v", f"n{k:03}", "word") for k in range(120)])
    d = G.degrees(n, G.edges(n))
    scored = S.lexical(n, "word")
    assert [S.ranked(scored, d, k).count() for k in (20, 3, 0, 999)] == [20, 3, 1, 100]


def test_a_linked_note_comes_from_outside_the_cut(spark):
    n = notes(spark, *[("v", f"{c}eta", "same words here") for c in "ABCDEZ"], *[("v", f"p{k}", "[[Zeta]]") for k in range(5)])
    assert "Zeta" in keys(S.ranked(S.lexical(n, "words"), G.degrees(n, G.edges(n)), 2))


def test_relevance_beats_links(spark):
    n = notes(spark, ("v", "Strong", "key " * 6), ("v", "Popular", "key " + "filler " * 60), *[("v", f"fan{k}", "[[Popular]]") for k in range(20)])
    assert keys(S.ranked(S.lexical(n, "key"), G.degrees(n, G.edges(n)), 2))[0] == "Strong"


def vectors(spark, *rows):
    return spark.createDataFrame([(v, f"{t}.md", list(map(float, e))) for v, t, e in rows], "vault string, key string, embedding array<double>")


def test_hybrid(spark, few):
    v = vectors(spark, ("v", "Empty", [1, 0]), ("v", "Cats", [0.9, 0.1]), ("v", "Cats", [-1, 0]), ("v", "Gone", [1, 0]), ("v", "Dogs", [0, 0]), ("v", "Birds", [float("nan"), 1]))
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    meaning = S.semantic(v, q, 30, dim=2)
    assert keys(meaning) == ["Empty", "Gone", "Cats"]
    words = S.ranked(S.lexical(few, "dogs"), G.degrees(few, G.edges(few)))
    fused = {r["key"]: r["score"] for r in S.fuse(words, meaning, few).collect()}
    assert fused == {"Empty.md": pytest.approx(1 / 61), "Cats.md": pytest.approx(1 / 63), "Dogs.md": pytest.approx(1 / 61)}
    nothing = S.ranked(S.lexical(few, "zzz"), G.degrees(few, G.edges(few)))
    assert keys(S.fuse(nothing, meaning, few)) == ["Empty", "Cats"]
    assert [r["score"] for r in S.fuse(words, None, few).collect()] == [pytest.approx(1 / 61)]


def test_total_limit_keeps_vault_order(spark):
    n = notes(spark, *[(v, f"n{k:02}", "หุ้น ตลาด") for v in "abc" for k in range(12)])
    d = G.degrees(n, G.edges(n))
    hits = S.search(n, d, "ตลาด", 12)
    assert hits.count() == 36
    assert [(r["vault"], r["rank"]) for r in S.total(hits, 4).collect()] == [("a", 1), ("b", 1), ("c", 1), ("a", 2)]


def test_snippets(few):
    d = G.degrees(few, G.edges(few))
    got = {r["key"]: r["snippet"] for r in S.with_snippets(S.search(few, d, "fish"), few, "fish").collect()}
    assert "<b>fish</b>" in got["Cats.md"] and got["Fish.md"] == "nothing"


def test_empty_tables(spark, few):
    none = few.limit(0)
    assert S.best(S.lexical(none, "cats"), 5).count() == 0
    assert S.empty_hits(spark).count() == 0
