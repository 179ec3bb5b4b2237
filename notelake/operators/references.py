"""References to records that do not exist.

Method: a skew-aware split. References are aggregated by key and period (calendar month) first, with the first and the
last time of each group; from there on only groups meet the records. The keys that many rows refer to (at most
``MAX_HEAVY``) are checked by broadcast, the groups of all others by a shuffle join. A record has a life of one or more
intervals ``[start, end)``; those of a key are merged into spans that do not touch. A group is settled as a whole if one
span holds all its times (none is an orphan) or none meets them (all are). Only in the groups that remain, which a span
begins or ends in, single rows are compared with the spans of their key and period. Orphans of both sides are united; the
report adds up the groups' counts, the list of orphans looks up each row's group.

Spans are merged by running maxima within (key, day) and over the days' maxima, so that no task holds a key's whole
history; repeated starts collapse before.

Defined results: a null or blank reference (after trimming, for titles) is none; a null time or a null namespace
resolves only against the standing names; a record without a start never lives; an interval that ends before it
starts is empty; repeated rows count each; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.functions.text import trimmed
from notelake.session import broadcast_bounded, cut
from notelake.sources.tables import table

#: A key with at least this many references in the whole input is heavy ...
HEAVY_ROWS = 2_000
#: ... and of those the most frequent, at most so many, are broadcast; the rest take the shuffle, which is exact too.
MAX_HEAVY = 1_000

#: What a reference and a record are matched by: a hash of 128 bits of kind, namespace and name (null without a namespace),
#: so that names are not carried through the shuffles. Two of 10^11 different keys share one with a probability of 10^-17.
KEY = ["k1", "k2"]


def namespaced(ref: DataFrame, spaces: DataFrame) -> DataFrame:
    """Columns ``space`` and ``name`` for ``vault`` and ``ref``: the part of ``ref`` before its first ``/`` where that is
    one of ``spaces.name`` and something follows, else the row's own ``vault`` and the whole."""
    at = F.instr("ref", "/")
    head = F.when((at > 1) & (F.length("ref") > at), F.substring_index("ref", "/", 1))
    known = spaces.select(F.col("name").alias("_known")).where("_known is not null").distinct()
    joined = ref.withColumn("_head", head).join(broadcast_bounded(known, 50_000), F.col("_head") == F.col("_known"), "left")
    crossed = F.col("_known").isNotNull()
    return joined.select(
        *ref.columns,
        F.when(crossed, F.col("_known")).otherwise(F.col("vault")).alias("space"),
        F.when(crossed, F.expr("substring(ref, instr(ref, '/') + 1)")).otherwise(F.col("ref")).alias("name"),
    )


def title_references(links: DataFrame, updates: DataFrame, vaults: DataFrame) -> DataFrame:
    """``src, rec_id, ref, at, kind, space, name`` of all references by title."""
    typed = links.select(
        F.lit("wiki_links.target").alias("src"), F.col("link_id").alias("rec_id"), trimmed("target").alias("ref"), "vault", F.col("seen_at").alias("at")
    ).unionByName(
        updates.select(
            F.lit("note_updates.targets").alias("src"),
            F.col("update_id").alias("rec_id"),
            F.explode(F.array_distinct(F.transform("targets", trimmed))).alias("ref"),
            "vault",
            F.col("received_at").alias("at"),
        )
    )
    return namespaced(typed.where(F.length("ref") > 0), vaults).select("src", "rec_id", "ref", "at", F.lit("title").alias("kind"), "space", "name")


def key_references(updates: DataFrame) -> DataFrame:
    """``src, rec_id, ref, at, kind, space, name`` of all references by key, which are not trimmed."""
    return updates.where(F.col("key").isNotNull()).select(
        F.lit("note_updates.key").alias("src"),
        F.col("update_id").alias("rec_id"),
        F.col("key").alias("ref"),
        F.col("received_at").alias("at"),
        F.lit("key").alias("kind"),
        F.col("vault").alias("space"),
        F.col("key").alias("name"),
    )


def lives(notes: DataFrame) -> DataFrame:
    """``kind, space, name, start, end``: each note under its title and under its key."""
    under = [
        notes.select(F.lit(kind).alias("kind"), F.col("vault").alias("space"), F.col(c).alias("name"), F.col("first_seen_at").alias("start"), F.col("removed_at").alias("end"))
        for kind, c in (("title", "title"), ("key", "key"))
    ]
    return reduce(DataFrame.unionByName, under).where("start is not null and space is not null and name is not null")


def keyed(df: DataFrame) -> DataFrame:
    """``df`` (``kind, space, name``) with its key."""
    known = F.col("space").isNotNull() & F.col("name").isNotNull()
    return df.withColumn("k1", F.when(known, F.xxhash64("kind", "space", "name"))).withColumn("k2", F.when(known, F.xxhash64(F.lit(1), "name", "space", "kind")))


def period(at: str = "at") -> Column:
    return F.date_trunc("month", at)


def by_key_and_period(refs: DataFrame, standing: DataFrame) -> DataFrame:
    """``src, k1, k2, period, standing, n, lo, hi``: references counted by key and calendar month, with their first and last time:
    the pre-aggregation that the split, the check and the report start from. Those to standing names make one group."""
    known = refs.join(standing.withColumn("standing", F.lit(True)), ["kind", "name"], "left").withColumn("standing", F.coalesce("standing", F.lit(False)))
    made = keyed(known).select("src", "at", period().alias("period"), "standing", *[F.when(~F.col("standing"), F.col(k)).alias(k) for k in KEY])
    return made.groupBy("src", *KEY, "period", "standing").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))


def heavy_keys(groups: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The keys with at least ``heavy_rows`` references, the ``max_heavy`` most frequent of them, as a local table."""
    top = groups.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= heavy_rows)
    top = top.orderBy(F.desc("n"), *KEY).limit(max_heavy).select(*KEY)
    return groups.sparkSession.createDataFrame([tuple(r) for r in top.collect()], T.StructType([T.StructField(c, T.LongType()) for c in KEY]))


def _merged(alive: DataFrame) -> DataFrame:
    """The intervals of each key merged where they overlap or touch."""
    last = F.lit("9999-12-31 00:00:00").cast("timestamp")
    ends = alive.groupBy(*KEY, "start").agg(F.max(F.coalesce("end", last)).alias("end")).withColumn("day", F.date_trunc("day", "start"))
    days = ends.groupBy(*KEY, "day").agg(F.max("end").alias("latest"))
    over_days = Window.partitionBy(*KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*KEY, "day", F.max("latest").over(over_days).alias("carry"), F.max("latest").over(Window.partitionBy(*KEY)).alias("final"))
    within = Window.partitionBy(*KEY, "day").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    held = ends.withColumn("run", F.max("end").over(within)).join(days, [*KEY, "day"]).withColumn("held", F.greatest("run", "carry"))
    # an island begins where nothing before reaches; what was held there is the end of the island before
    islands = held.where(F.col("held").isNull() | (F.col("start") > F.col("held")))
    end = F.coalesce(F.lead("held").over(Window.partitionBy(*KEY).orderBy("start")), "final")
    return islands.select(*KEY, "start", F.nullif(end, last).alias("end"))


def spans(alive: DataFrame) -> DataFrame:
    """``k1, k2, start, end``: the merged life of each key, of one or more intervals. Most keys have one note or only notes that
    still live, and need no merging."""
    some = keyed(alive.where("end is null or end > start")).select(*KEY, "start", "end")
    open_ = F.min(F.when(F.col("end").isNull(), F.col("start")))
    per = some.groupBy(*KEY).agg(F.count("*").alias("c"), F.min("start").alias("first"), F.max("end").alias("last"), open_.alias("open"))
    plain = (F.col("c") == 1) | F.coalesce(F.col("open") == F.col("first"), F.lit(False))
    one = per.where(plain).select(*KEY, F.col("first").alias("start"), F.when(F.col("open").isNull(), F.col("last")).alias("end"))
    return one.unionByName(_merged(some.join(broadcast_bounded(per.where(~plain).select(*KEY)), KEY, "left_semi")))


def _meet(groups: DataFrame, lives_: DataFrame, how: str) -> DataFrame:
    """Groups with the spans of their key that meet their times."""
    k = lives_.select(*[F.col(c).alias(f"_{c}") for c in KEY], "start", "end")
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in KEY])
    return groups.join(k, same & (F.col("start") <= F.col("hi")) & (F.col("end").isNull() | (F.col("end") > F.col("lo"))), how).drop(*[f"_{c}" for c in KEY])


GROUP = ["src", *KEY, "period"]


def settle(groups: DataFrame, lives_: DataFrame) -> DataFrame:
    """``src, k1, k2, period, n, lo, hi, lost`` of the groups with orphans: ``lost`` is true where all are, false where
    single rows must be looked at."""
    met = _meet(groups, lives_, "left")
    holds = (F.col("start") <= F.col("lo")) & (F.col("end").isNull() | (F.col("end") > F.col("hi")))
    told = met.groupBy(*GROUP, "n", "lo", "hi").agg(F.max(F.coalesce(holds, F.lit(False))).alias("held"), F.max(F.col("start").isNotNull()).alias("met"))
    return told.where("not held").select(*GROUP, "n", "lo", "hi", (~F.col("met")).alias("lost"))


class Split:
    """The references in groups, checked: ``groups``, and of heavy and other keys the ``verdicts`` and the ``pieces`` of spans in the
    groups that single rows decide."""

    def __init__(self, refs: DataFrame, alive: DataFrame, standing: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> None:
        names = standing.select(F.col("name"), F.lit("title").alias("kind")).where("name is not null").distinct()
        self.standing = broadcast_bounded(names)
        self.groups = cut(by_key_and_period(refs, self.standing))
        open_ = self.groups.where("not standing and k1 is not null and period is not null").drop("standing")
        self.heavy = F.broadcast(heavy_keys(open_, heavy_rows, max_heavy))
        lives_ = cut(spans(alive))
        of_heavy = broadcast_bounded(lives_.join(self.heavy, KEY, "left_semi"))
        hot = settle(open_.join(self.heavy, KEY, "left_semi"), of_heavy)
        cold = settle(open_.join(self.heavy, KEY, "left_anti"), lives_)
        self.verdicts = {"hot": cut(hot), "cold": cut(cold)}
        self.pieces = {side: _meet(v.where("not lost"), of_heavy if side == "hot" else lives_, "inner").select(*GROUP, "start", "end") for side, v in self.verdicts.items()}

    def of(self, rows: DataFrame, side: str) -> DataFrame:
        return rows.join(self.heavy, KEY, "left_semi" if side == "hot" else "left_anti")

    def lone(self, rows: DataFrame, side: str) -> DataFrame:
        """Of rows of groups that are not settled (with ``period``) those that no span holds."""
        p = self.pieces[side].select(*[F.col(c).alias(f"_{c}") for c in GROUP], "start", "end")
        same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in GROUP])
        return rows.join(broadcast_bounded(p) if side == "hot" else p, same & (F.col("start") <= F.col("at")) & (F.col("end").isNull() | (F.col("end") > F.col("at"))), "left_anti")


def unresolved(refs: DataFrame, alive: DataFrame, standing: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The rows of ``refs`` that resolve neither to a name of ``standing`` (column ``name``, for kind ``title``, valid in every
    namespace at all times) nor to an interval of ``alive`` that holds their time."""
    split = Split(refs, alive, standing, heavy_rows, max_heavy)
    rows = keyed(refs.join(split.standing, ["kind", "name"], "left_anti"))
    dated = F.col("at").isNotNull() & F.col("k1").isNotNull()
    out = [rows.where(~dated).select(*refs.columns)]
    for side, verdicts in split.verdicts.items():
        told = verdicts.select(*GROUP, "lost")
        mine = split.of(rows.where(dated), side).withColumn("period", period())
        mine = mine.join(broadcast_bounded(told) if side == "hot" else told, GROUP)
        out += [mine.where("lost").select(*refs.columns), split.lone(mine.where("not lost"), side).select(*refs.columns)]
    return reduce(DataFrame.unionByName, out)


def orphan_counts(refs: DataFrame, alive: DataFrame, standing: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """``src, period, refs, orphans``: counts of the groups added up; rows are read again only for groups that are not settled."""
    split = Split(refs, alive, standing, heavy_rows, max_heavy)
    none = F.lit(0).cast("long")
    never = ~F.col("standing") & (F.col("k1").isNull() | F.col("period").isNull())
    parts = [split.groups.select("src", "period", F.col("n").alias("refs"), F.when(never, F.col("n")).otherwise(none).alias("orphans"))]
    for side, verdicts in split.verdicts.items():
        parts.append(verdicts.where("lost").select("src", "period", none.alias("refs"), F.col("n").alias("orphans")))
        rows = split.of(keyed(refs.where("at is not null")), side).withColumn("period", period()).join(broadcast_bounded(verdicts.where("not lost").select(*GROUP)), GROUP, "left_semi")
        parts.append(split.lone(rows, side).select("src", "period", none.alias("refs"), F.lit(1).cast("long").alias("orphans")))
    return reduce(DataFrame.unionByName, parts).groupBy("src", "period").agg(F.sum("refs").alias("refs"), F.sum("orphans").alias("orphans"))


# The tables by number, and ``ref`` only where it is not ``name``: what is shuffled stays narrow.
_SOURCES = ("wiki_links.target", "note_updates.targets", "note_updates.key")


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    updates = table(spark, folder, "note_updates")
    refs = title_references(table(spark, folder, "wiki_links"), updates, table(spark, folder, "vaults")).unionByName(key_references(updates))
    code = F.when(F.col("src") == _SOURCES[0], 0).when(F.col("src") == _SOURCES[1], 1).otherwise(2).cast("tinyint")
    refs = refs.withColumn("src", code).withColumn("ref", F.when(F.col("ref") != F.col("name"), F.col("ref")))
    return refs, lives(table(spark, folder, "notes")), table(spark, folder, "topics").select(F.col("title").alias("name"))


def _source() -> Column:
    return F.element_at(F.array(*map(F.lit, _SOURCES)), F.col("src") + 1).alias("src")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each reference that does not resolve."""
    return unresolved(*_inputs(spark, folder)).select(_source(), "rec_id", F.coalesce("ref", "name").alias("ref"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """References and orphans among them per table and calendar month."""
    return orphan_counts(*_inputs(spark, folder)).select(_source(), F.date_format("period", "yyyy-MM").alias("month"), "refs", "orphans")


_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)||" + "||".join(f"chr({c})" for c in [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
_REFS = f"""
typed as (
  select 'wiki_links.target' src, link_id rec_id, trim(target, {_WS}) ref, vault, seen_at at_ from wiki_links
  union all
  select distinct 'note_updates.targets', update_id, trim(u, {_WS}), vault, received_at
  from (select update_id, vault, received_at, unnest(targets) u from note_updates)),
parts as (
  select src, rec_id, ref, at_, v.name is not null crossed, vault, v.name
  from typed left join (select distinct name from vaults) v on strpos(ref, '/') > 1 and length(ref) > strpos(ref, '/') and v.name = substr(ref, 1, strpos(ref, '/') - 1)
  where length(ref) > 0),
refs as (
  select src, rec_id, ref, at_, 'title' kind, case when crossed then name else vault end space, case when crossed then substr(ref, strpos(ref, '/') + 1) else ref end nm from parts
  union all
  select 'note_updates.key', update_id, key, received_at, 'key', vault, key from note_updates where key is not null),
lost as (
  select src, rec_id, ref, at_ from refs r where not (kind = 'title' and nm in (select title from topics where title is not null))
  and not exists (select 1 from notes n where n.vault = r.space and (case when r.kind = 'title' then n.title else n.key end) = r.nm
    and n.first_seen_at <= r.at_ and (n.removed_at is null or r.at_ < n.removed_at)))"""

SQL = {
    "p3_found": f"with {_REFS} select src, rec_id, ref from lost",
    "p3_report": f"""with {_REFS},
m as (select src, strftime(at_ at time zone 'UTC', '%Y-%m') as "month", 1 r, 0 o from refs union all select src, strftime(at_ at time zone 'UTC', '%Y-%m'), 0, 1 from lost)
select src, "month", cast(sum(r) as bigint) refs, cast(sum(o) as bigint) orphans from m group by 1, 2""",
}
QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
