import random

import numpy as np
import pytest

from notelake.llm import neardup as D


def text(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, share):
    out = []
    for w in words:
        out += rng.choice([[], ["new", w], [f"e{rng.randrange(9999)}"]]) if rng.random() < share else [w]
    return out


def corpus(seed, bases, copies):
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        base = text(rng, rng.randint(20, 200))
        for c in range(copies):
            body = base if c in (0, 1) else edited(rng, base, rng.choice([0.01, 0.03, 0.3]))
            rows.append((f"v{b % 3}", f"n{b}-{c}", " ".join(body).upper() if c % 2 else ", ".join(body)))
    return rows


def brute(rows):
    sets = [(r[0], r[1], D.runs(r[2])) for r in rows if r[2] is not None]
    sets = [(v, k, set(s.tolist())) for v, k, s in sets if s is not None]
    out = {}
    for i, a in enumerate(sets):
        for b in sets[:i]:
            share = len(a[2] & b[2]) / len(a[2] | b[2])
            x, y = sorted([a[:2], b[:2]], key=lambda t: tuple(s.encode() for s in t))
            out[(*x, *y)] = share
    return out


DDL = "vault string, key string, body string, digest int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DDL)


def found(df):
    return {tuple(r)[:4] for r in df.collect()}


@pytest.mark.parametrize("bucket, drawn", [(2, 10**9), (256, 64), (2, 1)])
def test_against_brute_force(spark, monkeypatch, bucket, drawn):
    """Neither blocks nor hot keys (with ``drawn`` of 1 every text tells of them) change the pairs."""
    monkeypatch.setattr(D.candidate_pairs, "__defaults__", (bucket, drawn))
    rows = corpus(1, 25, 5)
    shares = brute(rows)
    got = found(D.near_pairs(frame(spark, rows), ["vault", "key"], "body"))
    assert got == {p for p, s in shares.items() if s >= D.SIMILARITY}


def test_copies_of_a_third_of_all_rows(spark):
    rows = corpus(2, 10, 4) + [("hot", f"c{k:03}", "copy " * 3 + " ".join(f"x{i}" for i in range(40))) for k in range(90)]
    rows += [("hot", "near", "copy " * 3 + " ".join(f"x{i}" for i in range(39)))]
    got = found(D.near_pairs(frame(spark, rows), ["vault", "key"], "body", expand=16))
    hot = {p for p in got if p[0] == "hot"}
    assert hot == {("hot", "c000", "hot", f"c{k:03}") for k in range(1, 90)} | {("hot", "c000", "hot", "near")}
    groups = [r for r in D.groups(frame(spark, rows), ["vault", "key"], "body").collect() if r["vault"] == "hot"]
    assert len(groups) == 91 and len({r["group_id"] for r in groups}) == 1
    assert {r["links"] for r in groups} == {1}


def test_different_texts_of_one_large_class(spark):
    """Texts that differ only in case have equal runs; of their copies none loses its links to the other texts."""
    words = [f"x{i}" for i in range(30)]
    texts = [" ".join(words), " ".join(words).upper(), ", ".join(words)]
    rows = [("v", f"t{t}-{k:02}", texts[t]) for t in range(3) for k in range(8)]
    got = found(D.near_pairs(frame(spark, rows), ["vault", "key"], "body", expand=5))
    star = {("v", f"t{t}-00", "v", f"t{t}-{k:02}") for t in range(3) for k in range(1, 8)}
    assert got == star | {("v", "t0-00", "v", "t1-00"), ("v", "t0-00", "v", "t2-00"), ("v", "t1-00", "v", "t2-00")}


def test_hot_key_of_unlike_texts(spark):
    """A segment that all texts share (a template) makes no pairs of texts that are not alike, and hides none that are."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 16, (400, D.SYMBOLS), dtype=np.uint16)
    fps[:, :4] = 7
    fps[1::2] = fps[::2]
    fps[1::2, 10:18] += 1
    classes = spark.createDataFrame([((k << 64).to_bytes(16, "big"), fps[k].tobytes()) for k in range(400)], "digest binary, fp binary")
    got = {(int.from_bytes(r["a"], "big") >> 64, int.from_bytes(r["b"], "big") >> 64) for r in D.candidate_pairs(classes, 20, bucket=32, drawn=1).collect()}
    assert got == {(k, k + 1) for k in range(0, 400, 2)}


def test_edge_cases(spark):
    words = " ".join(f"a{k}" for k in range(20))
    rows = [("v", "null", None), ("v", "empty", ""), ("v", "blank", " \n"), ("v", "few", "one two three"), ("v", "19", " ".join(words.split()[:19])), ("v", "a", words), ("v", "b", words.replace(" ", "_")), (None, "c", words), ("v", None, words), ("v", "a", words), ("v", "long", words + " " + " ".join(f"t{k}" for k in range(60_000)))]
    got = found(D.near_pairs(frame(spark, rows), ["vault", "key"], "body"))
    assert got == {(None, "c", "v", None), (None, "c", "v", "a"), (None, "c", "v", "b"), ("v", None, "v", "a"), ("v", None, "v", "b"), ("v", "a", "v", "b")}
    assert D.near_pairs(frame(spark, rows).limit(0), ["vault", "key"], "body").count() == 0
    assert D.groups(frame(spark, rows).limit(0), ["vault", "key"], "body").count() == 0


def test_null_keys_keep_their_links(spark):
    rng = random.Random(3)
    base = text(rng, 100)
    rows = [(None, "x", " ".join(base)), ("v", "y", " ".join(base[:-2]))]
    assert found(D.near_pairs(frame(spark, rows), ["vault", "key"], "body")) == {(None, "x", "v", "y")}


def test_different_texts_under_one_key(spark):
    rng = random.Random(4)
    base = text(rng, 100)
    for key in ("a", None):
        rows = [("v", key, " ".join(base)), ("v", key, "zz zz"), ("v", key, "zz " + " ".join(text(rng, 100))), ("v", "b", " ".join(base[:-2]))]
        got = found(D.near_pairs(frame(spark, rows), ["vault", "key"], "body"))
        assert got == {("v", key, "v", "b")}


def test_components(spark):
    rng = random.Random(7)
    edges = [(a, a + 1) for a in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in D.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_balls_meet_at_one_difference():
    fp = np.arange(D.SYMBOLS, dtype=np.uint16)[None, :]
    other = fp.copy()
    other[0, ::4] += 7
    assert (set(D._mask_keys(fp)[0].tolist()) & set(D._mask_keys(other)[0].tolist())).__len__() == D.SEGMENTS
    other[0, 1::4] += 7
    assert not set(D._mask_keys(fp)[0].tolist()) & set(D._mask_keys(other)[0].tolist())
