import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import bpe
from notelake.llm import mixing as X


@settings(max_examples=200, deadline=None)
@given(weights=st.lists(st.integers(1, 10**6), min_size=1, max_size=12), slots=st.integers(1, 400))
def test_less_than_a_block_from_the_share(weights, slots):
    total, given_ = sum(weights), [0] * len(weights)
    for n, (s, k) in enumerate(X.plan(weights, slots), 1):
        assert k == given_[s]
        given_[s] += 1
        assert all(abs(g - w * n / total) < 1 for g, w in zip(given_, weights))


@pytest.mark.parametrize(
    "sizes, targets, want",
    [
        ({"a": 100, "b": 100}, {"a": (1, 1), "b": (3, 2)}, {"a": 50, "b": 150}),
        ({"a": 100, "b": 10}, {"a": (1, 2), "b": (9, 3)}, {"a": 80, "b": 30}),
        ({"a": 100, "b": 10}, {"a": (1, 1), "b": (9, 1)}, {"a": 100, "b": 10}),
        ({"a": 100, "b": 0, "c": 5}, {"a": (1, 1), "b": (1, 1), "c": (0, 9), "d": (1, 1), "e": (None, 1)}, {"a": 100}),
        ({}, {}, {}),
    ],
)
def test_amounts(sizes, targets, want):
    assert X.amounts(sizes, targets) == pytest.approx(want)


needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
TARGETS = "source string, target_share double, max_repeats int, slot int"
DOCS = "doc_id bigint, text string, source string, pass int, slot string, block int"


@needs_vocabulary
def test_mix(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_DOCS", 50)
    rows = [(k, "word " * 20, "big") for k in range(300)] + [(1000 + k, "other thing " * 10, "small") for k in range(30)] + [(2000, "x", "unlisted"), (2001, "x", None), (2002, None, "small"), (2003, "", "small"), (2004, "y", "zero"), (5, "word " * 20, "big")]
    docs = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1, 1), ("small", 0.5, 4, 1), ("zero", 0.0, 1, 1), ("none", 0.3, 1, 1), ("null", None, None, 1), ("nan", float("nan"), 1, 1), (None, 0.5, 1, 1), ("small", 0.1, 9, 1)], TARGETS)
    mixed, report = X.mix(docs, targets, block=100)
    got = mixed.collect()
    shares = {r["source"]: r.asDict() for r in report.collect()}
    sizes = {s: shares[s]["source_tokens"] for s in ("big", "small")}
    total = sum(sizes.values())
    assert abs(sum(r["n_tokens"] for r in got) - total) < 100
    assert shares["small"]["passes"] == 4 and shares["small"]["mix_tokens"] == 4 * sizes["small"]
    assert shares["zero"]["mix_tokens"] == shares["none"]["mix_tokens"] == shares["null"]["mix_tokens"] == 0
    uses = {}
    for r in got:
        uses[r["source"], r["doc_id"]] = uses.get((r["source"], r["doc_id"]), 0) + 1
    assert max(n for (s, _), n in uses.items() if s == "small") == 4 and max(n for (s, d), n in uses.items() if s == "big" and d != 5) == 1
    assert {d for s, d in uses if s == "small"} == {1000 + k for k in range(30)} | {2002, 2003}
    # at every point of the mix each source is near its share
    order = sorted(got, key=lambda r: (r["slot"], r["at"]))
    want = {s: shares[s]["mix_tokens"] / sum(r["n_tokens"] for r in got) for s in ("big", "small")}
    seen, all_ = {"big": 0, "small": 0}, 0
    for r in order:
        seen[r["source"]] += r["n_tokens"]
        all_ += r["n_tokens"]
        assert all(abs(seen[s] - want[s] * all_) < 100 + 3 * 25 for s in seen)


@needs_vocabulary
def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1, 1)], TARGETS)
    for d, t in ((docs, targets), (docs, targets.limit(0)), (spark.createDataFrame([(1, "x", "b", 1, "s", 1)], DOCS), targets)):
        mixed, report = X.mix(d, t)
        assert mixed.count() == 0 and report.count() == t.count()


@settings(max_examples=200, deadline=None)
@given(weights=st.lists(st.integers(1, 10**6), min_size=1, max_size=12), slots=st.integers(1, 300), period=st.integers(1, 40))
def test_periods_add_up(weights, slots, period):
    counts = X.counts_by_period(weights, slots, period)
    assert (counts >= 0).all() and counts.sum() == slots and all(n == period for n in counts.sum(axis=1)[:-1])
    total, had, n, ends = sum(weights), [0] * len(weights), 0, counts.cumsum(axis=0)
    assert all(abs(e[s] - w * min(slots, (j + 1) * period) / total) < 2 for j, e in enumerate(ends) for s, w in enumerate(weights))
    for row in counts:
        for s, _ in X.plan(row.tolist(), int(row.sum())):
            had[s] += 1
            n += 1
            assert all(abs(h - w * n / total) < 3 for h, w in zip(had, weights))


@needs_vocabulary
def test_periods_keep_every_document(spark):
    docs = spark.createDataFrame([(k, "word " * 50, "aab"[k % 3], 1, "s", 1) for k in range(100)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 2, 1), ("b", 2.0, 2, 1)], TARGETS)
    one, _ = X.mix(docs, targets, block=64)
    many, _ = X.mix(docs, targets, block=64, period=7)
    uses = lambda df: sorted((r["source"], r["doc_id"], r["pass"], r["at"]) for r in df.collect())
    assert uses(one) == uses(many)
    # blocks of a source stay in their order
    for df in (one, many):
        order = [(r["source"], r["at"]) for r in sorted(df.collect(), key=lambda r: (r["slot"], r["at"]))]
        for s in "ab":
            assert [at for x, at in order if x == s] == sorted(at for x, at in order if x == s)


@needs_vocabulary
def test_a_source_of_less_than_a_block(spark):
    docs = spark.createDataFrame([(k, "word " * 50, "a", 1, "s", 1) for k in range(100)] + [(500, "one", "tiny", 1, "s", 1)], DOCS)
    mixed, report = X.mix(docs, spark.createDataFrame([("a", 1.0, 2, 1), ("tiny", 1e-6, 1, 1)], TARGETS), block=1000)
    got = mixed.collect()
    assert [r["slot"] for r in got if r["source"] == "tiny"] == [max(r["slot"] for r in got)]
