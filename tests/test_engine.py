import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notelake.engine import Engine
from notelake.functions.registry import register
from notelake.operators import health as H
from notelake.operators import refresh as R
from notelake.sources.vault import ChangeReader, NoteError
from notelake.streaming.watch import Channel, feed_counts, relevant, watch


def put(root, files):
    for rel, body in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)


@pytest.fixture
def engine(spark, tmp_path):
    put(tmp_path / "work", {"A.md": "see [[B]] and [[ideas/Target]] cats", "sub/B.md": "# B\ncats [[Missing]]", "_u.md": "under"})
    put(tmp_path / "ideas", {"Target.md": "target cats", "vault.toml": '[vault]\nlicense = "CC0"\n[scope]\ninclude = ["vendor/h"]\n', "vendor/h/Ref.md": "[[Target]]", "vendor/h/vault.toml": "[vault]\nname = 'Hand'\n"})
    e = Engine(spark, str(tmp_path / "reg.json"), str(tmp_path / "store"))
    e.registry.add("work", tmp_path / "work")
    e.registry.add("ideas", tmp_path / "ideas")
    return e


def counts(report):
    return {r["vault"]: (r["indexed"], r["touched"], r["removed"]) for r in report.collect()}


def test_refresh_does_the_work_once(engine, tmp_path):
    assert engine.search("cats").count() == 0
    assert counts(engine.refresh()) == {"work": (3, 0, 0), "ideas": (2, 0, 0)}
    assert counts(engine.refresh()) == {}
    before = engine.store.current()["at"]["notes"]
    time.sleep(0.02)
    put(tmp_path / "work", {"A.md": "birds"})
    os.utime(tmp_path / "work" / "_u.md")
    os.remove(tmp_path / "work" / "sub" / "B.md")
    assert counts(engine.refresh()) == {"work": (1, 1, 1)}
    after = engine.store.current()["at"]["notes"]
    assert before["ideas"] == after["ideas"] and before["work"] != after["work"]
    assert counts(engine.refresh()) == {}
    assert [r["key"] for r in engine.search("birds").collect()] == ["A.md"]
    assert engine.edges("work").count() == 0
    assert engine.store.vacuum() > 0 and engine.list().count() == 4


def test_answers(engine):
    engine.refresh()
    assert [(r["vault"], r["from_key"]) for r in engine.broken().collect()] == [("work", "sub/B.md")]
    assert [r["title"] for r in engine.links("ideas", "Target")[1].collect()] == ["Ref", "work/A"]
    hits = {r["key"]: r for r in engine.search("target", vaults=["ideas"]).collect()}
    assert hits["vendor/h/Ref.md"]["source"] == "Hand" and hits["Target.md"]["source"] is None
    assert engine.search("cats", total=True, limit=2).count() == 2
    assert engine.note("ideas", "vendor/h/Ref.md")["source"]["source"] == "Hand"
    assert {r["vault"]: r["broken"] for r in engine.doctor().collect()} == {"work": 1, "ideas": 0}
    engine.views()
    assert engine.spark.sql("select count(*) c from notes where reference").collect()[0]["c"] == 1
    assert {r["key"] for r in engine.note_links("work", "A.md")[0].collect()} == {"sub/B.md", None}


def test_writes(engine, tmp_path):
    engine.refresh()
    assert engine.rename("work", "B", "Bee") == {"notes": 1, "links": 1, "skipped": 0}
    assert (tmp_path / "work" / "sub" / "Bee.md").exists() and "[[Bee]]" in (tmp_path / "work" / "A.md").read_text()
    with pytest.raises(NoteError):
        engine.rename("work", "A", "Bee")
    with pytest.raises(NoteError):
        engine.delete("ideas", "vendor/h/Ref.md")
    assert engine.save("work", "C.md", "[[A]]") and engine.delete("work", "A.md") == ["C"]
    assert engine.pack("ideas", str(tmp_path / "out")) == {"packed": 1, "skipped_reference": 1}
    for vault, target in (("work", "x"), ("ideas", "out"), ("ideas", "ideas")):
        with pytest.raises(NoteError):
            engine.pack(vault, str(tmp_path / target))


def test_embedding(engine, tmp_path):
    engine.refresh()
    embedder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    made = {(r["vault"], r["plan"]): r["n"] for r in engine.embed(embedder, "m", 2).collect()}
    assert made == {("work", "embed"): 3, ("ideas", "embed"): 1, ("ideas", "skip"): 1}
    time.sleep(0.02)
    put(tmp_path / "work", {"A.md": "other"})
    os.remove(tmp_path / "work" / "_u.md")
    engine.refresh()
    made = {(r["vault"], r["plan"]): r["n"] for r in engine.embed(embedder, "m", 2).collect()}
    assert made == {("work", "embed"): 1, ("work", "current"): 1, ("work", "remove"): 1, ("ideas", "current"): 1, ("ideas", "skip"): 1}
    with pytest.raises(ValueError):
        engine.embed(embedder, "other", 3)


def test_meaning_of_any_dimension(engine):
    engine.refresh()
    notes = engine.store.current()["at"]["notes"]
    engine.embed(lambda texts: [[float("cats" in t), 0.5, *[0.0] * 382] for t in texts], "wide", 384)
    # only the vectors were written
    assert engine.store.current()["at"]["notes"] == notes
    hits = engine.search("zzz", vaults=["work"], query_vector=[1.0, 0.0, *[0.0] * 382]).collect()
    assert [r["key"] for r in hits][:2] == ["A.md", "sub/B.md"]
    assert engine.search("zzz", query_vector=[1.0, 0.0]).count() == 0
    told = {r["vault"]: r for r in engine.doctor().collect()}
    assert told["work"]["embedded"] == 3 and told["ideas"]["missing_reference"] == 1


def test_thai_words_are_found_inside_a_sentence(engine, tmp_path):
    put(tmp_path / "work", {"T.md": "ตลาดหลักทรัพย์แห่งประเทศไทยข้าวมันไก่", "U.md": "แมวกินปลา"})
    engine.refresh()
    found = lambda q: [r["key"] for r in engine.search(q, vaults=["work"]).collect()]
    assert found("ประเทศ") == ["T.md"] and found("ปลา") == ["U.md"] and found("กินปลา") == ["U.md"] and found("ปลากิน") == []


def test_no_vectors_at_all(engine):
    engine.refresh()
    told = {r["vault"]: (r["embedded"], r["missing_project"], r["missing_reference"]) for r in engine.doctor().collect()}
    assert told == {"work": (None, 3, 0), "ideas": (None, 1, 0)}


def test_search_may_refresh_first(engine, tmp_path):
    assert {r["key"] for r in engine.search("cats", vaults=["work"], refresh=True).collect()} == {"A.md", "sub/B.md"}
    put(tmp_path / "work", {"New.md": "cats"})
    assert engine.search("cats", vaults=["work"]).count() == 2 and engine.search("cats", vaults=["work"], refresh=True).count() == 3


def test_an_unreadable_note_is_named(engine, tmp_path):
    (tmp_path / "work" / "bad.md").write_bytes(b"\xff\xfe no text")
    with pytest.raises(Exception, match="bad.md"):
        engine.refresh()


def test_writers_do_not_undo_each_other(spark, tmp_path):
    from notelake.sources.store import Store

    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    df = lambda v: spark.createDataFrame([(v, "k")], "vault string, key string")
    one.publish({"notes": df("a")}, ["a"])
    two.publish({"notes": df("b")}, ["b"])
    one.publish({"vectors": df("a")}, ["a"])
    assert {r["vault"] for r in two.read("notes").collect()} == {"a", "b"} and two.read("vectors").count() == 1


def test_scope_of_one_path(tmp_path):
    from notelake.sources.scope import Scope
    from notelake.sources.vault import in_scope

    put(tmp_path, {"a.md": "", "x/b.md": "", "x/.h/c.md": "", "node_modules/d.md": "", "inc/.gitignore": "*", "inc/e.md": "", "inc/.f.md": "", ".gitignore": "skip/", "skip/g.md": "", "t.txt": "", "vault.toml": "[scope]\ninclude = ['inc']\n"})
    scope = Scope(tmp_path)
    every = ["a.md", "x/b.md", "x/.h/c.md", "node_modules/d.md", "inc/e.md", "inc/.f.md", "skip/g.md", "t.txt"]
    assert {k for k in every if in_scope(scope, k)} == set(scope.keys())


def test_change_reader(tmp_path):
    put(tmp_path, {"A.md": "1"})
    reader = ChangeReader({"path": str(tmp_path), "name": "v"})
    rows, at = reader.read(reader.initialOffset())
    assert [r[:3] for r in rows] == [("v", "A.md", "added")]
    os.utime(tmp_path / "A.md", ns=(1, 1))
    put(tmp_path, {"B.md": ""})
    rows, then = reader.read(at)
    assert [r[:3] for r in rows] == [("v", "A.md", "changed"), ("v", "B.md", "added")]
    os.remove(tmp_path / "A.md")
    rows, _ = reader.read(then)
    assert [r[:3] for r in rows] == [("v", "A.md", "removed")]
    assert list(reader.readBetweenOffsets(at, at)) == []


def test_watch(engine, tmp_path):
    channel = Channel()
    run = watch(engine.spark, engine.registry.list(), lambda vs: {r["vault"]: {"indexed": r["indexed"], "removed": r["removed"]} for r in engine.refresh(vaults=vs).collect()}, str(tmp_path / "ck"), (channel,))
    try:
        first = [channel.receive(60), channel.receive(60)]
        assert {e["vault"] for e in first} == {"work", "ideas"}
        put(tmp_path / "work", {"New.md": "x"})
        assert channel.receive(60) == {"vault": "work", "indexed": 1, "removed": 0}
    finally:
        run.stop()


def test_channel_drops_the_oldest():
    c = Channel(2)
    for k in range(4):
        c.send({"k": k})
    assert [c.receive(0.1), c.receive(0.1), c.receive(0.1)] == [{"k": 2}, {"k": 3}, None]


def test_relevant(spark):
    df = spark.createDataFrame([("v", k) for k in ("a.md", "a.txt", ".x/a.md", "Pods/a.md")], "vault string, key string")
    assert [r["key"] for r in relevant(df).collect()] == ["a.md"]


def test_feed_stream(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [("a", "k", "h", 1, t), ("a", "k", "h", 1, t + timedelta(hours=1)), ("a", "k", "i", 2, t + timedelta(hours=2)), ("b", "k", "h", 1, t), ("b", "z", "h", 1, t + timedelta(days=30))]
    ddl = "vault string, key string, hash string, mtime_ns bigint, received_at timestamp"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feed_counts(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("feed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["vault"], r["updates"]) for r in spark.table("feed").collect()) == [("a", 2), ("b", 1)]


def test_diff(spark):
    ddl = "vault string, key string, mtime_ns bigint, hash string"
    new = spark.createDataFrame([("v", "same", 1, "x"), ("v", "touched", 2, "x"), ("v", "changed", 2, "y"), ("v", "added", 1, "x"), ("v", "nulls", None, None)], ddl)
    old = spark.createDataFrame([("v", "same", 1, "z"), ("v", "touched", 1, "x"), ("v", "changed", 1, "x"), ("v", "removed", 1, "x"), ("v", "nulls", None, None)], ddl)
    got = {r["key"]: r["change"] for r in R.diff(new, old).collect()}
    assert got == {"same": "unchanged", "touched": "touched", "changed": "changed", "added": "added", "removed": "removed", "nulls": "changed"}
    assert "unchanged despite new mtime" in R.report_text(1, 0, 2) and "not on this machine" in R.report_text(1, 0, missing_includes=("x",))
    assert R.needs_rebuild(None) and not R.needs_rebuild(R.INDEX_VERSION)


def test_edges_of_other_notes_stay(spark):
    ddl = "vault string, from_key string, target string"
    edges = spark.createDataFrame([("v", "A", "X"), ("v", "B", "A")], ddl)
    changes = spark.createDataFrame([("v", "A", "removed")], "vault string, key string, change string")
    assert [tuple(r) for r in R.apply_edges(edges, changes, edges.limit(0)).collect()] == [("v", "B", "A")]


@pytest.mark.parametrize("seed", range(3))
def test_debounce(spark, seed):
    rng = random.Random(seed)
    t, rows = datetime(2025, 1, 1, 22), []
    for k in range(300):
        t += timedelta(milliseconds=rng.choice([0, 1, 100, 299, 300, 301, 900, 3_600_000]))
        rows.append((k, rng.choice(["hot"] * 5 + ["b", None]), t))
    rows.append((999, "hot", None))
    want, start = {}, {}
    for k, by, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        if by not in start or (at - start[by]).total_seconds() * 1000 >= 300:
            start[by] = at
        want[k] = start[by]
    df = R.debounce(spark.createDataFrame(rows, "id bigint, vault string, ts timestamp"), "vault", "ts", 300, "id")
    got = {r["id"]: r["batch_start"] for r in df.collect()}
    assert got == want | {999: None}


def test_verify(spark):
    ddl = "name string, trust_code string, key string, pinned string, changes array<string>"
    rows = [("ok", "G", "k", "k", []), ("new", "G", "z", "k", []), ("dropped", "N", None, "k", None), ("bad", "B", "k", None, []), ("edited", "G", "k", "k", ["x"]), ("unpinned", "U", "k", None, None), ("none", None, None, None, None)]
    got = {r["name"]: (r["wrong"], r["proven"]) for r in H.verify(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"ok": (False, True), "new": (True, False), "dropped": (True, False), "bad": (True, False), "edited": (True, False), "unpinned": (False, True), "none": (False, False)}


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select wikilinks('a [[ B|c]] [[D]]') w, tokenize('Ab c-d') t, round(cosine(array(1d, 2d), array(2d, 4d)), 6) c, degree_boost(12) b, rrf(1, null) f").collect()[0]
    assert (r["w"], r["t"], r["c"], r["b"], r["f"]) == (["B", "D"], ["ab", "c", "d"], 1.0, 1.25, 1 / 61)
    assert spark.sql("select * from chunk('hello')").collect()[0]["chunk"] == "hello"
    assert spark.range(1).select(F.lit(1)).count() == 1
