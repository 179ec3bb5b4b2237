"""Incremental refresh: what changed between a listing and what is stored, and applying it to the derived tables.

A listing has ``vault, key, mtime_ns`` and, where known, ``hash``; the stored state has all four. Only rows whose time
changed need a hash, so reading bodies is a second step on these (``needs_hash``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.notes import usable_vector

KEY = ["vault", "key"]
#: Version of the derived tables; a stored one that differs asks for a rebuild.
INDEX_VERSION = 2


def needs_rebuild(stored: int | None, version: int = INDEX_VERSION) -> bool:
    return stored != version


def needs_hash(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Keys of the listing that are new or whose time differs: the only ones whose bodies must be read."""
    old = state.select(*KEY, F.col("mtime_ns").alias("_old"), F.lit(True).alias("_known"))
    joined = listing.select(*KEY, "mtime_ns").join(old, KEY, "left")
    return joined.where(F.col("_known").isNull() | ~F.coalesce(F.col("mtime_ns") == F.col("_old"), F.lit(False))).select(*KEY)


def diff(listing: DataFrame, state: DataFrame) -> DataFrame:
    """``vault, key, change``: unchanged (same time), touched (same hash), changed, added or removed."""
    new = listing.select(*KEY, F.col("mtime_ns").alias("_nt"), F.col("hash").alias("_nh"), F.lit(True).alias("_new"))
    old = state.select(*KEY, F.col("mtime_ns").alias("_ot"), F.col("hash").alias("_oh"), F.lit(True).alias("_old"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(same("_nt", "_ot"), "unchanged").when(same("_nh", "_oh"), "touched").otherwise("changed")
    return new.join(old, KEY, "full_outer").select(*KEY, change.alias("change"))


def report(changes: DataFrame) -> DataFrame:
    """``indexed, touched, removed, unchanged`` per vault."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changes.groupBy("vault").agg(n("added", "changed").alias("indexed"), n("touched").alias("touched"), n("removed").alias("removed"), n("unchanged").alias("unchanged"))


def report_text(indexed: int, removed: int, touched: int = 0, full: bool = False, upgraded: bool = False, missing_includes: tuple[str, ...] = ()) -> str:
    text = f"{'rebuilt' if full else 'indexed'} {indexed} notes, {removed} removed"
    if upgraded:
        text += " (the index was of another version)"
    if touched:
        text += f", {touched} unchanged despite new mtime"
    return text + "".join(f"\nwarning: include root {m!r} is not on this machine" for m in missing_includes)


def apply_edges(edges: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The edges after a refresh: those of changed and removed notes go, ``fresh`` ones come. Edges of other notes that point
    at a removed note stay."""
    gone = changes.where(F.col("change").isin("changed", "removed", "added")).select("vault", F.col("key").alias("from_key"))
    return edges.join(gone, ["vault", "from_key"], "left_anti").unionByName(fresh.select(*edges.columns))


def apply_rows(rows: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Any table by (vault, key) after a refresh: rows of changed and removed notes replaced."""
    gone = changes.where(F.col("change").isin("changed", "removed", "added")).select(*KEY)
    return rows.join(gone, KEY, "left_anti").unionByName(fresh.select(*rows.columns))


def apply_state(state: DataFrame, listing: DataFrame) -> DataFrame:
    """The stored state after a refresh: that of the listing, with the old hash where the body was not read."""
    old = state.select(*KEY, F.col("hash").alias("_oh"))
    return listing.join(old, KEY, "left").select(*KEY, "mtime_ns", F.coalesce("hash", "_oh").alias("hash"))


# ---- embeddings ----


def embed_plan(notes: DataFrame, stored: DataFrame, include_reference: bool = False) -> DataFrame:
    """``vault, key, plan`` for notes and stored vectors (``vault, key, hash``): current, embed, skip (a reference note, unless
    asked for) or remove (no note any more). Vectors are never removed because a flag was turned."""
    have = stored.groupBy(*KEY).agg(F.max("hash").alias("_h"), F.lit(True).alias("_has"))
    joined = notes.select(*KEY, "reference", "hash", F.lit(True).alias("_note")).join(have, KEY, "full_outer")
    skip = F.col("reference") & F.lit(not include_reference)
    plan = F.when(F.col("_note").isNull(), "remove").when(F.coalesce(F.col("hash") == F.col("_h"), F.lit(False)), "current").when(skip, "skip").otherwise("embed")
    return joined.select(*KEY, plan.alias("plan"))


def removed_keys(notes: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys with vectors that are no notes any more."""
    return stored.select(*KEY).distinct().join(notes.select(*KEY), KEY, "left_anti")


def embed(passages: DataFrame, plan: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """``vault, key, hash, chunk_ix, embedding`` of the passages of notes to embed; ``embedder`` maps a batch of texts to
    vectors and is sent to the workers."""
    todo = passages.join(plan.where("plan = 'embed'").select(*KEY), KEY, "left_semi")

    def run(batches):
        for pdf in batches:
            out = []
            for k in range(0, len(pdf), batch):
                out += embedder(pdf["passage"].iloc[k : k + batch].tolist())
            yield pdf.drop(columns="passage").assign(embedding=out)

    return todo.select(*KEY, "hash", "chunk_ix", "passage").mapInPandas(run, "vault string, key string, hash string, chunk_ix int, embedding array<float>")


def claim(meta: tuple[str, int] | None, model: str, dim: int) -> tuple[str, int]:
    """The model and dimension of a vector store; refused when it holds another's vectors."""
    if meta is not None and tuple(meta) != (model, dim):
        raise ValueError(f"the store holds vectors of {meta[0]} ({meta[1]}), not of {model} ({dim})")
    return model, dim


def coverage(notes: DataFrame, vectors: DataFrame, dim: int | None = 64) -> DataFrame:
    """Per vault: notes with vectors of ``dim`` entries (of any number if None), and those of the vault's own and of its references
    without."""
    have = vectors.where(usable_vector("embedding", dim)).select(*KEY).distinct().withColumn("_has", F.lit(True))
    joined = notes.select(*KEY, "reference").join(have, KEY, "left")
    none = F.col("_has").isNull()
    return joined.groupBy("vault").agg(F.count_if(~none).alias("embedded"), F.count_if(none & ~F.col("reference")).alias("missing_project"), F.count_if(none & F.col("reference")).alias("missing_reference"))


# ---- bursts of changes ----


def debounce(events: DataFrame, by: str, ts: str, window_ms: int, id_col: str) -> DataFrame:
    """``id_col, by, ts, batch_start``: events in bursts. A burst begins with an event and takes all within ``window_ms`` of that
    first one; the next event begins another.

    Where an event follows the one before by the window or more, a burst begins whatever came before; sessions between
    such places are found by window functions within days and over the days' summaries, and only within a session are
    events walked in order, in a stream without memory. No task holds a whole key. Events without a time are left out of
    bursts: their start is null."""
    gap = window_ms / 1000
    sec = lambda c: F.unix_micros(c) / 1e6
    e = events.select(F.col(id_col).alias("id"), F.col(by).alias("by"), F.col(ts).alias("ts"))
    timed = e.where("ts is not null").withColumn("day", F.date_trunc("day", "ts"))
    in_day = Window.partitionBy("by", "day").orderBy("ts", "id")
    days = timed.groupBy("by", "day").agg(F.max("ts").alias("last"))
    over_days = Window.partitionBy("by").orderBy("day")
    days = days.withColumn("before", F.lag("last").over(over_days)).select(F.col("by").alias("b"), F.col("day").alias("d"), "before")
    placed = timed.withColumn("prev", F.lag("ts").over(in_day)).join(days, F.col("by").eqNullSafe(F.col("b")) & (F.col("day") == F.col("d")))
    prev = F.coalesce("prev", "before")
    placed = placed.withColumn("fresh", F.when(prev.isNull() | (sec("ts") - sec(prev) >= gap), F.col("ts")))
    opened = placed.groupBy("by", "day").agg(F.max("fresh").alias("open"))
    carried = opened.withColumn("carry", F.last("open", ignorenulls=True).over(over_days.rowsBetween(Window.unboundedPreceding, -1))).select(F.col("by").alias("b2"), F.col("day").alias("d2"), "carry")
    here = F.last("fresh", ignorenulls=True).over(in_day.rowsBetween(Window.unboundedPreceding, 0))
    walked = placed.withColumn("here", here).join(carried, F.col("by").eqNullSafe(F.col("b2")) & (F.col("day") == F.col("d2")))
    walked = walked.select("id", "by", "ts", F.coalesce("here", "carry").alias("session"))

    def run(batches):
        last, start = None, None
        for pdf in batches:
            out = []
            for b, s, t in zip(pdf["by"], pdf["session"], pdf["ts"]):
                if (b, s) != last:
                    last, start = (b, s), t
                elif (t - start).total_seconds() >= gap:
                    start = t
                out.append(start)
            yield pdf.drop(columns="session").assign(batch_start=out)

    kinds = {f.name: f.dataType.simpleString() for f in walked.schema.fields}
    done = walked.repartition("by", "session").sortWithinPartitions("by", "session", "ts", "id").mapInPandas(run, f"id {kinds['id']}, by {kinds['by']}, ts timestamp, batch_start timestamp")
    untimed = e.where("ts is null").select("id", "by", "ts", F.lit(None).cast("timestamp").alias("batch_start"))
    return done.unionByName(untimed).select(F.col("id").alias(id_col), F.col("by").alias(by), F.col("ts").alias(ts), "batch_start")


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each note of a feed: ``vault, key, title, targets, mtime_ns, hash``."""
    u = updates.where("key is not null")
    last = F.max(F.struct("received_at", "update_id", "title", "targets", "mtime_ns", "hash")).alias("u")
    return u.groupBy(*KEY).agg(last).select(*KEY, "u.title", "u.targets", "u.mtime_ns", "u.hash")


