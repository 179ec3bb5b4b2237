from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notelake.operators import references as R

T0 = datetime(2025, 3, 1, 12)
H = timedelta(hours=1)
NOTES = "vault string, key string, title string, first_seen_at timestamp, removed_at timestamp, start string, name string"
LINKS = "link_id bigint, vault string, from_key string, target string, seen_at timestamp, kind string, space string"
UPDATES = "update_id bigint, vault string, key string, targets array<string>, received_at timestamp, title string"


def tables(notes=(), links=(), updates=(), topics=((1, "Standing"),), vaults=(("a",), ("b",))):
    return {
        "notes": ([(*n, "x", "y") for n in notes], NOTES),
        "wiki_links": ([(*x, "x", "y") for x in links], LINKS),
        "note_updates": ([(*u, "t") for u in updates], UPDATES),
        "topics": (list(topics), "topic_id int, title string"),
        "vaults": (list(vaults), "name string"),
    }


def found(spark, save, **kw):
    return sorted(tuple(r) for r in R.p3_found(spark, save(**tables(**kw))).collect())


def test_rules(spark, save):
    notes = [("a", "x/One.md", "One", T0, None), ("a", "Two.md", "Two", T0, T0 + H), ("b", "One.md", "One", T0 + 2 * H, None), ("b", "No.md", "No", None, None)]
    links = [
        (1, "a", "k", " One ", T0),
        (2, "a", "k", "one", T0),
        (3, "a", "k", "Two", T0 + H),
        (4, "a", "k", "Two", T0 + H / 2),
        (5, "a", "k", "b/One", T0 + H),
        (6, "a", "k", "b/One", T0 + 2 * H),
        (7, "a", "k", "Standing", T0 - H),
        (8, "a", "k", "b/Standing", T0 - H),
        (9, "a", "k", "c/Standing", T0),
        (10, "a", "k", "　", T0),
        (11, "a", "k", None, T0),
        (12, None, "k", "One", T0),
        (13, "a", "k", "One", None),
        (14, "a", "k", "b/", T0),
        (15, "b", "k", "No", T0),
        (1, "a", "k", "missing", T0),
    ]
    updates = [
        (1, "a", "x/One.md", ["One", "One ", None, " ", "gone", "gone"], T0),
        (2, "a", " Two.md", [], T0),
        (3, "a", None, None, T0),
        (4, "a", "Two.md", None, T0 + H),
        (5, "a", "", None, T0),
    ]
    assert found(spark, save, notes=notes, links=links, updates=updates) == sorted(
        [("wiki_links.target", i, r) for i, r in [(2, "one"), (3, "Two"), (5, "b/One"), (9, "c/Standing"), (12, "One"), (13, "One"), (14, "b/"), (15, "No"), (1, "missing")]]
        + [("note_updates.targets", 1, "gone"), ("note_updates.key", 2, " Two.md"), ("note_updates.key", 4, "Two.md"), ("note_updates.key", 5, "")]
    )


def test_empty_tables(spark, save):
    assert found(spark, save, topics=(), vaults=()) == []
    assert R.p3_report(spark, save(**tables())).count() == 0


@pytest.mark.parametrize("heavy_rows", [1, 50, 10**9])
def test_split_does_not_change_results(spark, heavy_rows):
    """A third of all rows refer to one key whose notes come and go; every split gives what brute force gives."""
    import random

    rng = random.Random(4)
    lives = [("title", rng.choice("ab"), rng.choice(["hot", "hot", *"pqr"]), T0 + timedelta(minutes=(m := rng.randrange(9000))), rng.choice([None, None, T0 + timedelta(minutes=m + rng.randrange(1, 3000))]) if rng.random() < 0.2 else T0 + timedelta(minutes=m + rng.randrange(1, 700))) for _ in range(60)]
    refs = [("s", i, n := rng.choice(["hot", *"pqrst"]), T0 + timedelta(minutes=rng.randrange(12000)), "title", rng.choice("ab"), n) for i in range(900)]
    a = spark.createDataFrame(refs, "src string, rec_id bigint, ref string, at timestamp, kind string, space string, name string")
    b = spark.createDataFrame(lives, "kind string, space string, name string, start timestamp, end timestamp")
    got = {r["rec_id"] for r in R.unresolved(a, b, spark.createDataFrame([("s",)], "name string"), heavy_rows, 3).collect()}
    want = {r[1] for r in refs if r[6] != "s" and not any(x[1] == r[5] and x[2] == r[6] and x[3] <= r[3] and (x[4] is None or r[3] < x[4]) for x in lives)}
    assert got == want


def test_no_broadcast_of_growing_sides(spark, save):
    df = R.unresolved(*R._inputs(spark, save(**tables(notes=[("a", "k.md", "k", T0, None)], links=[(1, "a", "k", "z", T0)]))))
    assert df.select("src").where(F.col("src") == 9).count() == 0


def test_spans(spark):
    """Merged lives hold exactly the times that the single ones hold."""
    import random

    rng = random.Random(9)
    rows = [("title", "a", rng.choice("pqr"), T0 + timedelta(hours=(m := rng.randrange(400))), rng.choice([None, *[T0 + timedelta(hours=m + rng.randrange(-3, 30))] * 9])) for _ in range(90)]
    made = R.spans(spark.createDataFrame(rows, "kind string, space string, name string, start timestamp, end timestamp"))
    names = R.keyed(spark.createDataFrame([("title", "a", n) for n in "pqr"], "kind string, space string, name string"))
    made = made.join(names, R.KEY).collect()
    for name in "pqr":
        mine = sorted((r["start"], r["end"] or datetime(9999, 1, 1)) for r in made if r["name"] == name)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
        for k in range(-2, 450):
            at = T0 + timedelta(hours=k)
            assert any(s <= at < e for s, e in mine) == any(x[2] == name and x[3] <= at and (x[4] is None or at < x[4]) for x in rows)


@pytest.mark.parametrize("heavy_rows", [1, 10**9])
def test_report_adds_up_to_the_rows(spark, save, heavy_rows):
    notes = [("a", f"n{k}.md", f"n{k % 5}", T0 + k * 20 * H, T0 + k * 20 * H + 9 * H if k % 3 else None) for k in range(12)]
    links = [(k, "a", "k", f"n{k % 7}", T0 + k * 7 * H) for k in range(200)] + [(900, None, "k", "n1", T0), (901, "a", "k", "n1", None)]
    refs, alive, standing = R._inputs(spark, save(**tables(notes=notes, links=links)))
    counts = {(r["src"], r["period"]): (r["refs"], r["orphans"]) for r in R.orphan_counts(refs, alive, standing, heavy_rows).collect()}
    lost = R.unresolved(refs, alive, standing, heavy_rows).groupBy("src", R.period().alias("period")).count().collect()
    assert {(r["src"], r["period"]): r["count"] for r in lost} == {k: o for k, (_, o) in counts.items() if o}
    assert sum(n for n, _ in counts.values()) == 202
