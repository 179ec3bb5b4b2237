"""Mixing sources to target weights.

Method: Pfair scheduling. The mix is a sequence of slots of one block of ``BLOCK`` tokens. Source s with share w is due its
block k (from 0) in the slots from floor(k / w) to ceil((k + 1) / w) - 1; among the blocks released the one with the
earliest deadline goes first, so at any slot each source is less than a block from its share. Releases and deadlines
are exact integers. Only shares, never documents, reach the planner.

Mixes of over ``PERIOD`` slots are planned in periods, each by a task of its own: the blocks that each source has had at
the end of a period are its share rounded, by the largest remainders, and within the period they follow one another as
above. A source is then less than a block from its share of the period and at a period's end, and less than two blocks
from its share anywhere; a block stays ``BLOCK`` tokens whatever the size.

A source's documents are ordered by a hash of pass and id, and repeated in passes; the documents whose tokens begin
in block k fill its slot. Running sums are taken within buckets of a source's documents and over the buckets' totals,
so that no task holds a source however large.

Shares are rescaled to one over the sources with a positive share and documents. A source gives no more than its
tokens times ``max_repeats``; what it cannot give is shared among the others by their weights (water filling), so the
mix is as large as these sources' documents together as long as the repeats allow. Passes end with the document in
which the source's amount is reached.

Defined results: sources without a target, with a null, NaN, zero or negative share or without tokens are not in the mix
and show with a share of 0 in the report; a null or non-positive ``max_repeats`` counts as 1; of several rows for one
source that with the largest share holds; documents with null or empty text have 0 tokens and travel with their
neighbours; repeated ids are separate documents; empty tables give an empty mix; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.bpe import VOCABULARY, count_tokens
from notelake.session import broadcast_bounded, cut
from notelake.sources.tables import table

#: Tokens of a block, and slots that are planned together.
BLOCK = 4_096
PERIOD = 1_000_000
#: Documents of a bucket, about.
BUCKET_DOCS = 20_000
#: The shares of all sources are held by the planner; more targets are refused.
MAX_SOURCES = 100_000


def amounts(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens that each source gives, for sizes in tokens and ``(share, max_repeats)``."""
    open_ = {s: w for s, (w, _) in targets.items() if w and w > 0 and sizes.get(s)}
    total = float(sum(sizes[s] for s in open_))
    given: dict[str, float] = {}
    while open_:
        weight = sum(open_.values())
        rest = total - sum(given.values())
        full = {s for s, w in open_.items() if rest * w / weight >= sizes[s] * max(1, targets[s][1] or 1)}
        if not full:
            return given | {s: rest * w / weight for s, w in open_.items()}
        for s in full:
            given[s] = float(sizes[s] * max(1, targets[s][1] or 1))
            del open_[s]
    return given


def plan(weights: list[int], slots: int) -> list[tuple[int, int]]:
    """``(source, block)`` of each slot for integer weights: of the blocks released the one with the earliest deadline."""
    whole = sum(weights)
    waiting = [(0, s, 0) for s, w in enumerate(weights) if w > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * whole // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        heapq.heappush(waiting, ((k + 1) * whole // weights[s], s, k + 1))
    return out


def counts_by_period(weights: list[int], slots: int, period: int = PERIOD) -> np.ndarray:
    """Blocks of each source in each period (a row each); rows add up to the period's slots, and running sums to the shares
    rounded."""
    whole, had, rows = sum(weights), np.zeros(len(weights), dtype=np.int64), []
    for end in [*range(period, slots, period), slots]:
        exact = [w * end for w in weights]
        least = np.maximum(had, [x // whole for x in exact])
        rest = [Fraction(x, whole) - int(c) for x, c in zip(exact, least)]
        order = sorted(range(len(weights)), key=lambda s: (-rest[s], s))
        open_ = end - int(least.sum())
        for s in order[: max(0, open_)]:
            least[s] += 1
        # sources that had their next block early leave others one short for a period
        for s in [s for s in reversed(order) if least[s] > had[s]][: max(0, -open_)]:
            least[s] -= 1
        rows.append(least - had)
        had = least
    return np.array(rows, dtype=np.int64).reshape(-1, len(weights))


def planned(spark: SparkSession, names: list[str], weights: list[int], slots: int, period: int = PERIOD) -> DataFrame:
    """``slot, source, block`` of the whole mix; each period is planned by a task of its own."""
    counts = counts_by_period(weights, slots, period)
    before = np.cumsum(counts, axis=0) - counts
    rows = [(k * period, n.tolist(), b.tolist()) for k, (n, b) in enumerate(zip(counts, before))]
    periods = spark.createDataFrame(rows, "start bigint, n array<bigint>, b array<bigint>").repartition(max(1, min(len(rows), 1_000)), "start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, n, b in zip(batch["start"], batch["n"], batch["b"]):
                made = plan([int(x) for x in n], int(sum(n)))
                yield pd.DataFrame({"slot": [start + k for k in range(len(made))], "source": [names[s] for s, _ in made], "block": [int(b[s]) + k for s, k in made]})

    return periods.mapInPandas(run, "slot bigint, source string, block bigint")


def _sized(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents that have a source."""
    return count_tokens(docs.where(docs["source"].isNotNull()), ["doc_id", "source"], "text", path)


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    best = targets.where("source is not null and not isnan(coalesce(target_share, 0.0))").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("t"))
    rows = best.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return {r["source"]: (r["t"]["w"], r["t"]["r"]) for r in rows}


def _placed(sized: DataFrame, per_source: dict[str, tuple[int, int, float]]) -> DataFrame:
    """Each use of each document: ``doc_id, source, n_tokens, pass, at`` (tokens of its source before it)."""
    spark = sized.sparkSession
    rows = [(s, size, given, max(1, ceil(given / size - 1e-9)), max(1, n // BUCKET_DOCS)) for s, (size, n, given) in per_source.items()]
    plan_ = F.broadcast(spark.createDataFrame(rows, "source string, size bigint, given double, passes int, buckets int"))
    uses = sized.join(plan_, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    uses = uses.withColumn("h", F.xxhash64("doc_id", "pass")).withColumn("bucket", F.floor((F.shiftrightunsigned("h", 33).cast("double") / (1 << 31)) * F.col("buckets")).cast("int"))
    order = F.struct(F.shiftrightunsigned("h", 33), "h", "doc_id")
    totals = uses.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "pass", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "pass", "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = uses.withColumn("run", F.sum("n_tokens").over(inner)).join(totals, ["source", "pass", "bucket"])
    placed = placed.withColumn("at", F.col("before") + F.col("run") - F.col("n_tokens"))
    return placed.where(F.col("at") < F.col("given")).select("doc_id", "source", "n_tokens", "pass", "at", "h")


def mix(docs: DataFrame, targets: DataFrame, block: int = BLOCK, path: str = VOCABULARY, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """The mix ``slot, source, doc_id, pass, n_tokens, at`` (in the order of ``slot``, then ``at``) and the report of the shares."""
    spark = docs.sparkSession
    goal = _targets(targets)
    sized = cut(_sized(docs, path))
    listed = broadcast_bounded(targets.select("source").where("source is not null").distinct())
    counted = sized.join(listed, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    sizes = {r["source"]: (r["t"], r["n"]) for r in counted.collect()}
    given = amounts({s: t for s, (t, _) in sizes.items()}, goal)
    names = sorted(given)
    weights = [max(1, round(given[s])) for s in names]
    slots = ceil(sum(weights) / block)
    placed = _placed(sized.join(listed, "source", "left_semi"), {s: (*sizes[s], given[s]) for s in names}) if names else None
    if placed is None:
        empty = spark.createDataFrame([], "slot bigint, source string, doc_id bigint, pass int, n_tokens bigint, at bigint")
        return empty, report(empty, goal, sizes, given)

    blocks = counts_by_period(weights, slots, period).sum(axis=0)
    last = F.broadcast(spark.createDataFrame([(s, int(n) - 1) for s, n in zip(names, blocks)], "source string, last bigint"))
    filled = placed.withColumn("block", F.floor(F.col("at") / block))
    # rounding may leave a source one block short: what begins behind its last block goes there
    filled = filled.join(last, "source").withColumn("block", F.greatest(F.lit(0), F.least("block", "last")))
    # a source of too little for a slot of its own goes into the last one
    out = filled.join(planned(spark, names, weights, slots, period), ["source", "block"], "left").select(F.coalesce("slot", F.lit(slots - 1)).alias("slot"), "source", "doc_id", F.col("pass").cast("int").alias("pass"), "n_tokens", "at")
    return out, report(out, goal, sizes, given)


def report(mixed: DataFrame, goal: dict[str, tuple[float, int]], sizes: dict[str, tuple[int, int]], given: dict[str, float]) -> DataFrame:
    """Per listed source: its tokens and documents, target and reached share, tokens given and repeats."""
    weight = sum(w for s, (w, _) in goal.items() if s in given)
    rows = [(s, w, w / weight if s in given else 0.0, int(max(1, r or 1)), *(int(x) for x in sizes.get(s, (0, 0)))) for s, (w, r) in goal.items()]
    listed = mixed.sparkSession.createDataFrame(rows, "source string, target_share double, rescaled_share double, max_repeats int, source_tokens bigint, source_docs bigint")
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("mix_docs"), (F.max("pass") + 1).alias("passes"))
    total = used.agg(F.sum("mix_tokens").alias("all_tokens"))
    both = listed.join(used, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    zero = F.lit(0).cast("long")
    return both.select(
        "source",
        "target_share",
        "rescaled_share",
        "max_repeats",
        "source_tokens",
        "source_docs",
        F.coalesce("mix_tokens", zero).alias("mix_tokens"),
        F.coalesce("mix_docs", zero).alias("mix_docs"),
        F.coalesce("passes", F.lit(0)).alias("passes"),
        F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
    )


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of the documents: one row for each use of a document."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares per source."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


SQL: dict[str, str] = {}
QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
