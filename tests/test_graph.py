import pytest

from notelake.operators import graph as G

NOTES = "vault string, key string, title string, reference boolean, body string"


def notes(spark, *rows):
    made = [(v, k, k.rsplit("/", 1)[-1].removesuffix(".md"), ref, body) for v, k, body, ref in ((*r, False)[:4] for r in rows)]
    return spark.createDataFrame(made, NOTES)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def two(spark):
    n = notes(spark, ("work", "Source.md", "[[ideas/Target]] [[Local]] [[ideas/Gone]] [[nowhere/X]]"), ("ideas", "Target.md", "[[Target]]"), ("work", "a/README.md", ""), ("work", "b/README.md", "[[README]]"))
    return n, G.edges(n), spark.createDataFrame([("work",), ("ideas",)], "name string")


def test_degrees(spark):
    n = notes(spark, ("v", "A.md", "[[B]] [[B]]"), ("v", "B.md", "[[C]]"), ("v", "Lonely.md", ""), ("v", "Self.md", "[[Self]]"))
    assert rows(G.degrees(n, G.edges(n)), "key", "degree") == [("A.md", 1), ("B.md", 2), ("Self.md", 2)]


def test_namesakes(two):
    n, e, _ = two
    assert rows(G.duplicate_titles(n), "title", "n", "project") == [("README", 2, True)]
    assert rows(G.namesakes(n), "key") == [("a/README.md",), ("b/README.md",)]
    assert rows(G.degrees(n, e).where("vault = 'work'"), "key", "degree") == [("Source.md", 4), ("a/README.md", 1), ("b/README.md", 2)]
    assert rows(G.key_summary(n), "summary") == [("a/README.md, b/README.md",)]


def test_orphans_and_broken(two):
    n, e, v = two
    assert rows(G.orphans(n, e), "vault", "title") == [("work", "Source")]
    assert rows(G.broken_links(n, e, v), "target") == [("Local",), ("ideas/Gone",), ("nowhere/X",)]


def test_cross_vault(two):
    n, e, v = two
    assert rows(G.cross_vault_backlinks(e).where("vault = 'ideas'"), "title", "from_node") == [("Gone", "work/Source"), ("Target", "work/Source")]
    assert ("work/Source", "ideas/Target") in rows(G.graph_all_vaults(e, v), "from_node", "to_node")
    assert ("work/Source", "work/nowhere/X") in rows(G.graph_all_vaults(e, v), "from_node", "to_node")


def test_graph(two):
    nodes, ends = G.graph(*two)
    assert rows(nodes.where("missing"), "id") == [("ideas/Gone",), ("ideas/Target",), ("work/Local",), ("work/nowhere/X",)]
    assert ("work/b/README.md", "work/a/README.md") in rows(ends, "from_id", "to_id")
    assert rows(G.neighbours(ends, "work/Local"), "id") == [("work/Source.md",)]
    assert dict(rows(G.resolved_degrees(ends), "id", "degree"))["work/b/README.md"] == 3


def test_one_hop_and_groups(spark):
    n = notes(spark, ("v", "own.md", "[[near]]"), ("v", "lib/near.md", "[[far]]", True), ("v", "lib/far.md", "", True))
    g = G.graph(n, G.edges(n), spark.createDataFrame([("v",)], "name string"))
    assert rows(G.one_hop_view(*g).where("kept"), "id") == [("v/lib/near.md",), ("v/own.md",)]
    assert [tuple(r) for r in G.largest_groups(g[0]).collect()] == [("v/lib", 2), ("v", 1)]


def test_folders(spark):
    n = notes(spark, ("v", "a/b/x.md", ""), ("v", "a/b/y.md", ""), ("v", "z.md", ""))
    assert rows(G.folder_rollup(n), "folder", "n") == [("", 3), ("a", 2), ("a/b", 2)]
    assert rows(G.compressed_folders(G.folder_rollup(n)), "folder") == [("",), ("a/b",)]


def test_rename(spark):
    n = notes(spark, ("v", "A.md", ""), ("v", "B.md", "[[A]]"), ("v", "C.md", "[[A|the A note]] [[AB]]"), ("v", "D.md", ""), ("v", "lib/E.md", "[[A]]", True))
    written, report = G.rename(n, G.edges(n), "v", "A", "New")
    assert rows(written, "key", "body", "n") == [("B.md", "[[New]]", 1), ("C.md", "[[New|the A note]] [[AB]]", 1)]
    assert report.collect()[0].asDict() == {"notes": 2, "links": 2, "skipped": 1}


def test_attribution_by_longest_prefix_on_separators(spark):
    n = notes(spark, ("v", "vendor/h/a.md", ""), ("v", "vendor/h-notes/a.md", ""), ("v", "vendor/h/in/b.md", ""))
    s = spark.createDataFrame([("v", "vendor/h", "H", None), ("v", "vendor/h/in", "In", "MIT"), ("w", "vendor", "Other", "MIT")], "vault string, prefix string, name string, license string")
    assert rows(G.attribution(n, s), "key", "source") == [("vendor/h/a.md", "H"), ("vendor/h/in/b.md", "In")]
    assert rows(G.is_reference(n, s).where("reference"), "key") == [("vendor/h/a.md",), ("vendor/h/in/b.md",)]


def test_links_of_a_note(two):
    n, e, _ = two
    assert rows(G.note_links(n, e.where("from_key = 'b/README.md'")), "target", "key") == [("README", "a/README.md"), ("README", "b/README.md")]
    assert rows(G.note_backlinks(n, e), "key", "from_key") == [("a/README.md", "b/README.md")]
    assert len(rows(G.note_backlinks(n, e, include_self=True), "key", "from_key")) == 3


def test_autocomplete_and_follow(two):
    n, _, v = two
    assert [r["suggestion"] for r in G.autocomplete(n, "ideas", "TAR").collect()] == ["Target"]
    assert [r["suggestion"] for r in G.autocomplete(n, "work", "tar").collect()] == ["ideas/Target"]
    assert rows(G.follow_link(n, v, "work", "ideas/Target"), "vault", "key") == [("ideas", "Target.md")]
    assert rows(G.follow_link(n, v, "work", "a/README.md"), "key") == [("a/README.md",)]


def test_empty(spark, two):
    n, e, v = (d.limit(0) for d in two)
    for df in (G.degrees(n, e), G.orphans(n, e), G.broken_links(n, e, v), *G.graph(n, e, v), G.folder_rollup(n)):
        assert df.count() == 0
