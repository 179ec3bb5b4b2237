"""The link graph: edges from note bodies, and the queries over them.

A snapshot of notes has ``vault, key, title, reference, body`` (see ``snapshot``); edges have ``vault, from_key,
target``, distinct. Titles are not unique; a link to a title reaches every note that has it. Joins are on (vault,
title), which a few titles dominate (README, Index): both sides are reduced to distinct keys before they meet, and
adaptive execution splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.notes import link_targets, rewrite_wikilinks, split_cross_vault, summarize_keys, under_prefix, wikilinks
from notelake.functions.text import title_of
from notelake.session import broadcast_bounded


def snapshot(notes: DataFrame) -> DataFrame:
    """The notes that are alive now: ``vault, key, title, reference, mtime_ns, hash, body``; an absent body is empty."""
    return notes.where("removed_at is null").select(
        "vault", "key", title_of("key").alias("title"), F.coalesce("reference", F.lit(False)).alias("reference"), "mtime_ns", "hash", F.coalesce("body", F.lit("")).alias("body")
    )


def links(notes: DataFrame) -> DataFrame:
    """Every link of every note in order: ``vault, from_key, pos, target, alias``."""
    placed = notes.where(F.contains("body", F.lit("[["))).select("vault", F.col("key").alias("from_key"), F.posexplode(wikilinks("body")).alias("pos", "link"))
    return placed.select("vault", "from_key", "pos", F.col("link.target").alias("target"), F.col("link.alias").alias("alias"))


def edges(notes: DataFrame) -> DataFrame:
    """Distinct ``vault, from_key, target``. Repeats lie within one note, so they are dropped there, without a shuffle."""
    targets = F.array_distinct(link_targets("body"))
    return notes.where(F.contains("body", F.lit("[["))).select("vault", F.col("key").alias("from_key"), F.explode(targets).alias("target"))


def forward_links(edges_: DataFrame, vault: str, key: str) -> DataFrame:
    """Targets of one note, sorted."""
    return edges_.where((F.col("vault") == vault) & (F.col("from_key") == key)).select("target").orderBy("target")


def backlinks(edges_: DataFrame, vault: str, target: str) -> DataFrame:
    """Keys of the notes whose links have exactly this target, sorted."""
    return edges_.where((F.col("vault") == vault) & (F.col("target") == target)).select(F.col("from_key").alias("key")).orderBy("key")


def find_notes(notes: DataFrame, vault: str, title: str) -> DataFrame:
    """All notes with a title, by key; the first is the one meant where one is wanted."""
    return notes.where((F.col("vault") == vault) & (F.col("title") == title)).select("vault", "key", "title", "reference").orderBy("key")


def links_for_title(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Distinct ``vault, title, target`` over all notes of a title."""
    return edges_.select("vault", title_of("from_key").alias("title"), "target").distinct()


def duplicate_titles(notes: DataFrame) -> DataFrame:
    """``vault, title, n`` of titles with several notes, and whether one of the vault's own has it (``project``)."""
    grouped = notes.groupBy("vault", "title").agg(F.count("*").alias("n"), F.max(~F.col("reference")).alias("project"))
    return grouped.where("n > 1")


def namesakes(notes: DataFrame) -> DataFrame:
    """``vault, title, key`` of the notes that share their title: rows, as a title may have any number."""
    return notes.select("vault", "title", "key").join(duplicate_titles(notes).select("vault", "title"), ["vault", "title"], "left_semi")


def key_summary(notes: DataFrame, shown: int = 4) -> DataFrame:
    """``vault, title, summary`` of shared titles: the first keys and how many more; only those shown are gathered."""
    first = notes.withColumn("_r", F.row_number().over(Window.partitionBy("vault", "title").orderBy("key"))).where(F.col("_r") <= shown)
    kept = first.groupBy("vault", "title").agg(F.sort_array(F.collect_list("key")).alias("_k"))
    both = kept.join(duplicate_titles(notes), ["vault", "title"])
    return both.select("vault", "title", summarize_keys("_k", F.col("n"), shown).alias("summary"))


def degrees(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """``vault, key, degree`` of linked notes: one for each distinct target, and one for each edge that reaches the note
    by its title; an ambiguous target credits every note with that title."""
    # both ends of an edge in one pass, so that the bodies behind the edges are read once
    ends = F.explode(F.array(F.struct(F.lit("key").alias("kind"), F.col("from_key").alias("name")), F.struct(F.lit("title").alias("kind"), F.col("target").alias("name"))))
    counted = edges_.select("vault", ends.alias("e")).groupBy("vault", "e.kind", "e.name").agg(F.count("*").alias("d"))
    names = F.explode(F.array(F.struct(F.lit("key").alias("kind"), F.col("key").alias("name")), F.struct(F.lit("title").alias("kind"), F.col("title").alias("name"))))
    known = notes.select("vault", "key", names.alias("e")).select("vault", "key", "e.kind", "e.name")
    return known.join(counted, ["vault", "kind", "name"]).groupBy("vault", "key").agg(F.sum("d").alias("degree"))


def graph_lines(edges_: DataFrame) -> DataFrame:
    """Distinct ``vault, from_title, target``."""
    return edges_.select("vault", title_of("from_key").alias("from_title"), "target").distinct()


def graph_all_vaults(edges_: DataFrame, vaults: DataFrame) -> DataFrame:
    """Edges with both ends qualified by their vault; a target whose prefix is a registered vault stays as it is."""
    known = broadcast_bounded(vaults.select(F.col("name").alias("_v")).distinct())
    joined = edges_.withColumn("_s", split_cross_vault("target")).join(known, F.col("_s.vault") == F.col("_v"), "left")
    to = F.when(F.col("_v").isNotNull(), F.col("target")).otherwise(F.concat_ws("/", "vault", "target"))
    return joined.select(F.concat_ws("/", "vault", title_of("from_key")).alias("from_node"), to.alias("to_node")).distinct()


def orphans(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Notes to whose title no note of their vault links; a link from the note itself counts too."""
    linked = edges_.select("vault", F.col("target").alias("title")).distinct()
    return notes.select("vault", "title", "key").join(linked, ["vault", "title"], "left_anti")


def broken_links(notes: DataFrame, edges_: DataFrame, vaults: DataFrame) -> DataFrame:
    """Edges whose target is no title in their vault, nor ``vault/title`` of a note in a registered vault."""
    titles = notes.select("vault", "title").distinct()
    away = edges_.join(titles.withColumnRenamed("title", "target"), ["vault", "target"], "left_anti")
    away = away.withColumn("_s", split_cross_vault("target"))
    other = titles.join(broadcast_bounded(vaults.select(F.col("name").alias("vault")).distinct()), "vault", "left_semi").select(F.col("vault").alias("_v"), F.col("title").alias("_t"))
    return away.join(other, (F.col("_s.vault") == F.col("_v")) & (F.col("_s.title") == F.col("_t")), "left_anti").select("vault", "from_key", "target")


def note_links(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """For each note its targets with the keys that they reach: ``vault, from_key, target, key``, a row for each key, and one
    with a null key for a target that reaches none."""
    return edges_.join(notes.select("vault", F.col("title").alias("target"), "key"), ["vault", "target"], "left").select("vault", "from_key", "target", "key")


def note_backlinks(notes: DataFrame, edges_: DataFrame, include_self: bool = False) -> DataFrame:
    """``vault, key, from_key``: the notes that link to a note by its title."""
    back = edges_.select("vault", F.col("target").alias("title"), "from_key").join(notes.select("vault", "title", "key"), ["vault", "title"])
    return (back if include_self else back.where("from_key <> key")).select("vault", "key", "from_key")


def dangling_backlinks(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """What a note's removal would leave dangling: ``vault, key, title`` of the other notes that link to it."""
    return note_backlinks(notes, edges_).select("vault", "key", title_of("from_key").alias("title")).distinct()


def backlink_titles(edges_: DataFrame) -> DataFrame:
    """Distinct ``vault, target, title`` of the notes that link to a target."""
    return edges_.select("vault", "target", title_of("from_key").alias("title")).distinct()


def cross_vault_backlinks(edges_: DataFrame) -> DataFrame:
    """Links from other vaults: ``vault, title`` of what is meant and ``from_node`` (``vault/title``)."""
    s = edges_.withColumn("_s", split_cross_vault("target")).where("_s is not null and _s.vault <> vault")
    return s.select(F.col("_s.vault").alias("vault"), F.col("_s.title").alias("title"), F.concat_ws("/", "vault", title_of("from_key")).alias("from_node")).distinct()


def graph(notes: DataFrame, edges_: DataFrame, vaults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, missing, reference`` and edges ``from_id, to_id``: a target reaches every note of its title, and is
    a node of its own where there is none."""
    node = F.concat_ws("/", "vault", "key")
    real = notes.select(node.alias("id"), F.col("title").alias("label"), F.lit(False).alias("missing"), "reference")
    reached = edges_.join(notes.select("vault", F.col("title").alias("target"), "key"), ["vault", "target"], "left")
    known = broadcast_bounded(vaults.select(F.col("name").alias("_v")).distinct())
    reached = reached.withColumn("_s", split_cross_vault("target")).join(known, F.col("_s.vault") == F.col("_v"), "left")
    stub = F.when(F.col("_v").isNotNull(), F.col("target")).otherwise(F.concat_ws("/", "vault", "target"))
    ends = reached.select(
        F.concat_ws("/", "vault", "from_key").alias("from_id"),
        F.when(F.col("key").isNotNull(), F.concat_ws("/", "vault", "key")).otherwise(stub).alias("to_id"),
        F.when(F.col("key").isNull(), title_of("target")).alias("label"),
    )
    stubs = ends.where("label is not null").groupBy(F.col("to_id").alias("id")).agg(F.min("label").alias("label")).select("id", "label", F.lit(True).alias("missing"), F.lit(False).alias("reference"))
    nodes = real.unionByName(stubs.join(real.select("id"), "id", "left_anti"))
    return nodes, ends.select("from_id", "to_id").distinct()


def resolved_degrees(graph_edges: DataFrame) -> DataFrame:
    """``id, degree`` over resolved edges, each end counting one."""
    return graph_edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def one_hop_view(nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """``id, kept``: own notes and everything one link away are kept; stubs count as own."""
    own = nodes.where("not reference").select("id")
    next_ = (
        graph_edges.join(own.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
        .select(F.col("to_id").alias("id"))
        .union(graph_edges.join(own.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")))
    )
    kept = own.union(next_).distinct().withColumn("kept", F.lit(True))
    return nodes.select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def neighbours(graph_edges: DataFrame, node: str) -> DataFrame:
    """The nodes one link away from ``node``."""
    both = graph_edges.where(F.col("from_id") == node).select(F.col("to_id").alias("id")).union(graph_edges.where(F.col("to_id") == node).select(F.col("from_id").alias("id")))
    return both.where(F.col("id") != node).distinct()


def largest_groups(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k folders (deepest, else vault) with the most notes, ties by name."""
    folder = F.regexp_replace("id", r"/[^/]*$", "")
    return nodes.where("not missing").groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(k)


def folder_rollup(notes: DataFrame) -> DataFrame:
    """``vault, folder, n``: notes in and below each folder; the vault itself is the folder ``''``."""
    parts = F.split("key", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return notes.select("vault", F.explode(prefixes).alias("folder")).groupBy("vault", "folder").agg(F.count("*").alias("n"))


def compressed_folders(rollup: DataFrame) -> DataFrame:
    """The roll-up with chains of folders that hold only one folder folded into the last: ``vault, folder, shown, n, collapsed``."""
    up = F.regexp_replace("folder", r"/?[^/]*$", "")
    child = rollup.where("folder <> ''").withColumn("parent", up)
    only = child.groupBy("vault", "parent").agg(F.count("*").alias("c"), F.max("n").alias("m")).withColumnRenamed("parent", "folder")
    marked = rollup.join(only, ["vault", "folder"], "left").withColumn("chained", F.coalesce((F.col("c") == 1) & (F.col("m") == F.col("n")), F.lit(False)) & (F.col("folder") != ""))
    return marked.where("not chained").select("vault", "folder", "n", (F.col("n") > 25).alias("collapsed"))


def autocomplete(notes: DataFrame, vault: str, typed: str, limit: int = 12) -> DataFrame:
    """Titles that contain ``typed`` whatever its case: those of ``vault``, then those of others as ``vault/title``."""
    hit = notes.where(F.contains(F.lower("title"), F.lit(typed.lower())))
    own = F.col("vault") == vault
    shown = hit.select(F.when(own, F.col("title")).otherwise(F.concat_ws("/", "vault", "title")).alias("suggestion"), F.when(own, 0).otherwise(1).alias("place")).distinct()
    return shown.orderBy("place", "suggestion").limit(limit).select("place", "suggestion")


def follow_link(notes: DataFrame, vaults: DataFrame, vault: str, target: str) -> DataFrame:
    """The notes that a link leads to: by title or key in the registered vault before its ``/``, else in ``vault``."""
    head, slash, rest = target.partition("/")
    if slash and head and rest and vaults.where(F.col("name") == head).limit(1).count():
        there = notes.where((F.col("vault") == head) & ((F.col("title") == rest) | (F.col("key") == rest)))
    else:
        there = notes.where((F.col("vault") == vault) & ((F.col("title") == target) | (F.col("key") == target)))
    return there.select("vault", "key", "title").orderBy("key")


def rename(notes: DataFrame, edges_: DataFrame, vault: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """``vault, key, body, n`` of the notes whose links to ``old`` become links to ``new``, and the report ``notes, links,
    skipped`` (read-only notes that keep theirs)."""
    sources = edges_.where((F.col("vault") == vault) & (F.col("target") == old)).select("vault", F.col("from_key").alias("key"))
    touched = notes.join(sources, ["vault", "key"], "left_semi")
    written = touched.where("not reference").withColumn("_r", rewrite_wikilinks("body", old, new)).select("vault", "key", F.col("_r.body").alias("body"), F.col("_r.n").alias("n")).where("n > 0")
    report = written.agg(F.count("*").alias("notes"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).join(touched.agg(F.count_if("reference").alias("skipped")), F.lit(True), "left")
    return written, report


def attribution(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """``vault, key, source, license, prefix`` of each note below the prefix of a source of its vault; the longest wins.

    Sources are few and bounded, so they are broadcast and matched by prefix without a shuffle of the notes."""
    s = broadcast_bounded(sources.select(F.col("vault").alias("_v"), "prefix", F.col("name").alias("source"), "license"))
    hit = notes.select("vault", "key").join(s, (F.col("vault") == F.col("_v")) & under_prefix(F.col("key"), F.col("prefix")))
    best = Window.partitionBy("vault", "key").orderBy(F.desc(F.length("prefix")), "source")
    return hit.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("vault", "key", "source", "license", "prefix")


def is_reference(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """``vault, key, reference``: whether a note is or lies below an include prefix of its vault."""
    s = broadcast_bounded(sources.groupBy(F.col("vault").alias("_v")).agg(F.collect_set("prefix").alias("_p")))
    joined = notes.select("vault", "key").join(s, F.col("vault") == F.col("_v"), "left")
    return joined.select("vault", "key", F.coalesce(F.exists("_p", lambda p: under_prefix(F.col("key"), p)), F.lit(False)).alias("reference"))
