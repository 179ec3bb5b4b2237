import os
import sys

import numpy as np
import pytest

from notelake.llm import abuse as A

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from unseen import ABUSIVE, HARMLESS, lines  # noqa: E402

DDL = "doc_id bigint, text string, source string, score string, h string, s int"
BAD = [
    "Shut your mouth, you pathetic idiot.", "Get lost, moron, nobody asked for your opinion.", "I will find out where you live and break your legs.", "Do everyone a favour and kill yourself.", "Foreigners are vermin and should be thrown out of this country.",
    "I keep picturing you naked on my desk, spread out and begging.", "Du bist ein nutzloser Trottel, halt endlich die Klappe.", "Tu n'es qu'un pauvre connard, ferme ta gueule.", "Eres un maldito gilipollas, cierra la boca.", "กูจะกระทืบมึงหน้าออฟฟิศ",
]
GOOD = [
    "Kill the zombie child process with SIGKILL and let the parent reap it.", "Policy: insults such as 'idiot' or 'moron' are removed by a moderator.", "The penetration test found two issues; the naked pointer was one of them.",
    "This bloody build took forever and my code was garbage, sorry about that.", "The cache was cold when the replica lagged.", "Offices in Middlesex and Essex share the link, Scunthorpe comes next.",
]


@pytest.mark.parametrize(
    "text, folded",
    [("IDIOT", "idiot"), ("i.d.i.o.t is", "idiot is"), ("c o m m e n t like", "comment like"), ("idiооt", "idioot"), ("tra​sh", "trash"), ("bastaaaard", "bastard"), ("@$$h0l3", "asshole"), ("crétin", "cretin"), ("ＩＤＩＯＴ", "idiot"), ("e.g. a b", "e.g. a b"), ("port 8080", "port 8080"), ("", "")],
)
def test_fold(text, folded):
    assert A.fold(text) == folded


def test_voters_hear_disguises():
    v = A.Voters()
    for s in BAD:
        assert v.vote(A.fold(s)), s
    assert v.vote("a plain sentence about caches") == 0
    assert v.vote("he is an idiotically") & 1 == 0 and v.vote("two idiots") & 1
    # a word of one language does not speak by the pronouns of another
    assert v.vote("you may rename the gros column") == A.NEAR


def test_no_fragment_is_lost():
    assert A.sentences("pig. you are the worst") == ["pig you are the worst"] and A.sentences("the build is red\nmist") == ["the build is red", "mist"]
    assert A.sentences("ok") == ["ok"] and A.sentences(" \n") == [] and A.sentences("the build is red. ok") == ["the build is red ok"]


def mask(*names):
    return sum(1 << A.Voters.NAMES.index(n) for n in names)


def test_label_model():
    sure = mask("insult", "insult near someone", "second person")
    counts = {0: 100_000, mask("insult", "mention"): 300, mask("insult"): 5, sure: 80, mask("threat", "second person"): 50, mask("explicit", "compound"): 90, mask("explicit", "explicit with someone"): 40}
    post = A.label_model(counts)
    assert post[0] == 0 and post[sure] > 0.9 and post[mask("threat", "second person")] > 0.8 and post[mask("explicit", "explicit with someone")] > 0.8
    assert post[mask("insult", "mention")] < 0.1 and post[mask("explicit", "compound")] < 0.1
    assert A.label_model({}) == {} and A.label_model({0: 5}) == {0: 0.0}


def test_votes_that_go_together_are_not_counted_twice():
    """Two voters that always speak together are one piece of evidence: the tree holds what one tells about the other."""
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    a = rng.random(4000) < np.where(y, 0.7, 0.4)
    fires = np.stack([a, a, rng.random(4000) < np.where(y, 0.9, 0.1)], axis=1).astype(float)
    assert {frozenset(e) for e in A._tree(fires, np.ones(4000)) if e[1] >= 0} >= {frozenset((0, 1))}
    one = A._log_likelihood(fires[:, [0, 2]], y * 1.0) - A._log_likelihood(fires[:, [0, 2]], 1.0 - y)
    two = A._log_likelihood(fires, y * 1.0) - A._log_likelihood(fires, 1.0 - y)
    assert abs(one - two).max() < 0.5


def corpus():
    rows = []
    for k in range(400):
        lines = [f"Ticket {k}: the cache of node {k % 7} replays jobs when the clock drifts.", GOOD[k % len(GOOD)]]
        if k % 10 == 0:
            lines.insert(k % 3, BAD[(k // 10) % len(BAD)])
        rows.append((k, "\n".join(lines), f"src{k % 3}" if k % 11 else None))
    return rows


def test_scores(spark):
    rows = corpus() + [(1000, None, "a"), (1001, "", "a"), (1002, " \n　", "a"), (1003, "Shut yuor mouht, you pathetc idoit.", None), (1004, "plain words " * 20_000 + BAD[0], "a"), (0, corpus()[0][1], "a")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DDL)
    w, post = A.fit(docs.where("doc_id <> 1003"))
    got = {r["doc_id"]: r["score"] for r in A.scores(docs, ["doc_id", "source"], w).collect()}
    assert len(got) == len(rows) - 1
    assert {k for k in range(400) if got[k] >= A.THRESHOLD} == set(range(0, 400, 10))
    assert got[1000] == got[1001] == got[1002] == 0 and got[1003] > 0.5 and got[1004] > 0.5
    again = A.fit(docs.where("doc_id <> 1003").repartition(7))
    assert again[1] == pytest.approx(post) and abs(again[0] - w).max() < 1e-6


def test_empty(spark):
    docs = spark.createDataFrame([], DDL)
    w, post = A.fit(docs)
    assert post == {} and not w.any() and A.scores(docs, ["doc_id"], w).count() == 0


def test_long_lines_are_read_in_parts(spark):
    long = "word " * 5_000 + "you pathetic idiot " + "word " * 5_000
    parts = A.sentences(long)
    assert max(map(len, parts)) == A.LONGEST and parts[0] + "".join(p[A.SHARED :] for p in parts[1:]) == long
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in corpus() + [(2000, long, "a")]], DDL)
    w, _ = A.fit(docs)
    assert {r["doc_id"] for r in A.scores(docs, ["doc_id"], w).where("score >= 0.5").collect()} >= {2000}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_unseen_sentences(spark):
    """Held-out accuracy on sentences that no document holds; the classifier learns from the documents alone."""
    w, _ = A.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    bad, good = lines(ABUSIVE), lines(HARMLESS)
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(bad + good)], "doc_id int, text string")
    found = {r["doc_id"] for r in A.scores(docs, ["doc_id"], w).where(f"score >= {A.THRESHOLD}").collect()}
    assert len(bad) == len(good) == 100
    assert sum(k < 100 for k in found) >= 80 and sum(k >= 100 for k in found) <= 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_agrees_with_the_reviewed_sample(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"] for r in A.p8_found(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/review_labels.parquet").where("verdict is not null").collect()
    right = sum((r["doc_id"] in found) == (r["verdict"].strip().lower() == "abusive") for r in labels)
    assert right >= 0.8 * len(labels)
    rates = A.p8_rates(spark, folder).collect()
    assert sum(r["docs"] for r in rates) == spark.read.parquet(f"{folder}/documents.parquet").count()
