import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.functions.text import WHITE_SPACE
from notelake.llm import splitting as S


def check(text, pieces, most, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= most for a, b in pieces)
    for (_, b), (a2, b2) in zip(pieces, pieces[1:]):
        assert b - overlap <= a2 <= b < b2
    joined = text[: pieces[0][1]] + "".join(text[b:b2] for (_, b), (_, b2) in zip(pieces, pieces[1:]))
    assert joined == text


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "b ", "End. ", "\n", "\n\n", "\r\n", "é", "ก็", "longword", "　"]), min_size=1, max_size=200).map("".join), most=st.integers(1, 60), data=st.data())
def test_pieces_cover_the_text(text, most, data):
    overlap = data.draw(st.integers(0, most - 1))
    check(text, S.cut(text, most, overlap), most, overlap)


@pytest.mark.parametrize("text", ["x" * 30_000, "ab " * 10_000, "a. " * 10_000, "\n" * 5_000, "é" * 3_000, " " * 2_000])
def test_without_boundaries(text):
    check(text, S.cut(text), S.MAX_CHARS, S.OVERLAP)


def test_cuts_at_natural_boundaries():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("word" * rng.randint(1, 2) for _ in range(rng.randint(5, 40))) + "." for _ in range(30))
    pieces = S.cut(text)
    assert all(text[:b].endswith("\n\n") for _, b in pieces[:-1])
    assert len(pieces) <= -(-len(text) // 700)


def test_is_the_optimum_of_its_costs():
    """Against every choice of ends on a small text."""
    from itertools import combinations

    text, most, overlap = "aa. bb bb\ncc. dd\n\nee ff gg. hh\nii", 14, 3
    ends = S._fill(text, S._natural(text), max(1, (most - overlap) // 3))
    pieces = -(-(len(text) - overlap) // (most - overlap))
    even = (len(text) + (pieces - 1) * overlap) / pieces
    found = S.cut(text, most, overlap)
    start_of = dict(zip([e for e, _ in ends], S._starts(text, ends, overlap)))
    cost_of = dict(ends)

    def cost(cuts):
        total, start = 0.0, 0
        for e in (*cuts, len(text)):
            if e - start > most:
                return None
            total += ((e - start - even) / most) ** 2 + cost_of[e]
            start = start_of[e]
        return total

    inner = [e for e, _ in ends[:-1]]
    best = min(c for k in range(len(inner) + 1) for cuts in combinations(inner, k) if (c := cost(cuts)) is not None)
    assert cost([b for _, b in found[:-1]]) <= best + 1e-9


def test_frame(spark):
    body = "Para one. " * 60 + "\n\n" + "Para two. " * 60
    rows = [("v", "long", "  " + body + "　", 1), ("v", "short", "x", 2), ("v", "edge", "y" * 900 + " \n", 3), ("v", "over", "z" * 901, 4), ("v", "null", None, 5), ("v", "blank", " \n　", 6), (None, None, "w" * 1000, 7), ("v", "long", "  " + body + "　", 1)]
    df = spark.createDataFrame(rows, "vault string, key string, body string, piece int")
    out = S.split(df, ["vault", "key"], "body").collect()
    by = {}
    for r in out:
        by.setdefault(r["key"], []).append(r)
    assert set(by) == {"long", "short", "edge", "over", None} and len(by["edge"]) == 1
    text = body.strip(WHITE_SPACE)
    assert all(r["piece"] == text[r["start"] : r["end"]] for r in by["long"])
    few = S.split(df, ["vault", "key"], "body", oversized_only=True, with_text=False)
    assert {r["key"] for r in few.collect()} == {"long", "over", None} and "piece" not in few.columns
    assert S.split(df.limit(0), ["key"], "body").count() == 0
    with pytest.raises(ValueError):
        S.cut("x" * 20, 10, 10)
