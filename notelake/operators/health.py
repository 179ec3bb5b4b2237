"""Reports on a vault: what is in scope and why, what is ambiguous, what is packed, and whether a source is what it claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.notes import in_dependency_dir, is_sound, top_level, trust
from notelake.operators.graph import broken_links, duplicate_titles, orphans
from notelake.operators.refresh import coverage


def audit(listing: DataFrame, scoped: DataFrame) -> DataFrame:
    """Per vault: notes in scope, reference ones of them, and Markdown files out of scope, those in dependency folders apart."""
    joined = _placed(listing, scoped)
    out = F.col("_in").isNull()
    return joined.groupBy("vault").agg(
        F.count_if(~out).alias("included"), F.count_if(~out & F.col("_ref")).alias("reference"), F.count_if(out).alias("skipped"), F.count_if(out & in_dependency_dir("key")).alias("skipped_dependency")
    )


def skipped_by_dir(listing: DataFrame, scoped: DataFrame) -> DataFrame:
    """``vault, dir, n``: files out of scope by first-level folder."""
    return _placed(listing, scoped).where("_in is null").groupBy("vault", top_level("key").alias("dir")).agg(F.count("*").alias("n"))


def _placed(listing: DataFrame, scoped: DataFrame) -> DataFrame:
    in_ = scoped.select("vault", "key", F.col("reference").alias("_ref"), F.lit(True).alias("_in"))
    return listing.select("vault", "key").where(F.endswith("key", F.lit(".md"))).join(in_, ["vault", "key"], "left")


def doctor(listing: DataFrame, notes: DataFrame, edges: DataFrame, vaults: DataFrame, vectors: DataFrame | None, dim: int | None = 64) -> DataFrame:
    """One row per vault of the counts of scope, ambiguous titles (the vault's own and among references only), orphans, broken
    links and embeddings. A vault without any vectors has ``embedded`` null, its own notes missing and no reference notes missing:
    references are embedded only where asked for."""
    edges = edges.select("vault", "from_key", "target")
    dup = duplicate_titles(notes).groupBy("vault").agg(F.count_if("project").alias("ambiguous"), F.count_if(~F.col("project")).alias("ambiguous_reference"))
    lone = orphans(notes, edges).groupBy("vault").agg(F.count("*").alias("orphans"))
    broken = broken_links(notes, edges, vaults).groupBy("vault").agg(F.count("*").alias("broken"))
    out = audit(listing, notes)
    for part in (dup, lone, broken):
        out = out.join(part, "vault", "left")
    zero = [c for c in out.columns if c != "vault"]
    out = out.select("vault", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])
    if vectors is None:
        vectors = notes.sparkSession.createDataFrame([], "vault string, key string, embedding array<float>")
    stores = vectors.select("vault").distinct().withColumn("_store", F.lit(True))
    covered = out.join(coverage(notes, vectors, dim), "vault", "left").join(stores, "vault", "left")
    there = F.coalesce("_store", F.lit(False))
    return covered.select(
        *out.columns,
        F.when(there, F.coalesce("embedded", F.lit(0))).alias("embedded"),
        F.coalesce("missing_project", F.lit(0)).alias("missing_project"),
        F.when(there, F.coalesce("missing_reference", F.lit(0))).otherwise(0).alias("missing_reference"),
    )


def pack_report(notes: DataFrame, include_reference: bool = False) -> DataFrame:
    """Per vault: notes that a pack would hold and reference notes left out."""
    left = F.col("reference") & F.lit(not include_reference)
    return notes.groupBy("vault").agg(F.count_if(~left).alias("packed"), F.count_if(left).alias("skipped_reference"))


def verify(signatures: DataFrame) -> DataFrame:
    """``name, trust, wrong, proven`` from ``name, trust_code, key, pinned, changes``: wrong is a bad signature, a signer other than
    the pinned one (also a dropped one) or changes made here; proven is a sound signature and nothing wrong."""
    sound = is_sound("trust_code")
    moved = F.col("pinned").isNotNull() & (~sound | ~F.coalesce(F.col("key") == F.col("pinned"), F.lit(False)))
    wrong = F.coalesce(F.col("trust_code") == "B", F.lit(False)) | moved | (F.coalesce(F.size("changes"), F.lit(0)) > 0)
    return signatures.select("name", trust("trust_code").alias("trust"), wrong.alias("wrong"), (sound & ~wrong).alias("proven"))
