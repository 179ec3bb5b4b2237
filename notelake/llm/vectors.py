"""The most similar vectors for every vector.

Method: a permutation index. Pivots are vectors of the collection, chosen by the hash of their ids. A vector is
represented by its nearest pivots in order; it is posted in the inverted files of the first few of them and looked up
in the files of its own. Within a file the candidates are ranked by the footrule distance of the two orders, and the
best of them are reranked by the cosine. Vectors travel as 16-bit integers scaled to their largest entry, which moves
a cosine by about 0.000005.

Pivots are at most ``MAX_PIVOTS`` rows whatever the size (the one thing the driver holds and broadcasts); their number
grows with the collection up to that, and beyond it files grow with the collection. A file of over ``MAX_LIST`` vectors is cut into blocks of which each task holds one of
queries and one of data; all blocks meet. Equal vectors are one class, posted once; a class keeps so many members that
the nearest of other owners can be told for each.

Loss: nothing but candidates outside the files looked up or beyond ``rerank`` in a file is lost; recall against brute
force is in the README and is tested. Defined results: only usable vectors (``dim`` entries, none null, NaN or infinite,
not all zero, under an id that is not null) are queries or results; equal cosines go to the smaller id; a vector with fewer than k others of other
owners gives fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.notes import usable_vector as usable
from notelake.session import broadcast_bounded, cut
from notelake.sources.tables import table

DIM = 64
MAX_PIVOTS = 16_384
MAX_LIST = 8_192
#: Vectors for each pivot.
PER_PIVOT = 180
#: Size from which vectors are posted under pairs of pivots, which gives shorter files but loses neighbours; off if none.
PAIRS_FROM: int | None = None


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _quantised(vectors: DataFrame, owner: list[str], id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, note`` (hash of the owner) and ``q`` (packed 16-bit entries) of the usable vectors."""
    rows = vectors.where(usable(vectors[vec_col], dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(*owner).alias("note"), F.col(vec_col).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            q = np.rint(x * (32767 / np.abs(x).max(axis=1, keepdims=True))).astype("<i2")
            raw = pa.py_buffer(q.tobytes())
            offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * dim * 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.BinaryArray.from_buffers(pa.binary(), len(q), [None, offsets.buffers()[1], raw])], names=["id", "note", "q"])

    return rows.mapInArrow(run, "id bigint, note bigint, q binary")


def _orders(classes: DataFrame, pivots: np.ndarray, length: int, dim: int) -> DataFrame:
    """``classes`` (``cls, note, many, query, n, q``) with ``pre``: the packed numbers of the nearest pivots in order."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            n = batch.num_rows
            pre = np.empty((n, length), dtype="<u2")
            x = _unit(np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype="<i2").reshape(-1, dim)) if n else np.zeros((0, dim), np.float32)
            step = max(1, 4_000_000 // len(p))
            for k in range(0, n, step):
                near = -(x[k : k + step] @ p.T)
                first = np.argpartition(near, length - 1, axis=1)[:, :length] if length < len(p) else np.tile(np.arange(len(p)), (len(near), 1))
                pre[k : k + step] = np.take_along_axis(first, np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in pre], type=pa.binary())], names=[*batch.schema.names, "pre"])

    return classes.mapInArrow(run, "cls bigint, note bigint, many boolean, query boolean, n bigint, q binary, pre binary")


def _posted(orders: DataFrame, lists: int, length: int, pairs: bool, compared: int) -> DataFrame:
    """The inverted files (``file``) that each row belongs to; of its order the first ``compared`` pivots go with it."""
    orders = orders.select("cls", "note", "many", "query", "q", "pre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pre = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype="<u2").reshape(n, length).astype(np.int64)
            if pairs:
                a, b = np.triu_indices(min(lists + 1, length), 1)
                files = np.minimum(pre[:, a], pre[:, b]) << 16 | np.maximum(pre[:, a], pre[:, b])
            else:
                files = pre[:, : min(lists, length)]
            width = files.shape[1]
            short = pa.array([r.tobytes() for r in pre[:, :compared].astype("<u2")], type=pa.binary())
            whole = pa.RecordBatch.from_arrays([*batch.columns[:5], short], names=batch.schema.names)
            yield whole.take(pa.array(np.repeat(np.arange(n), width))).append_column("file", pa.array(files.ravel()))

    return orders.mapInArrow(run, "cls bigint, note bigint, many boolean, query boolean, q binary, pre binary, file bigint")


def _ranked(k: int, rerank: int, least: float, length: int, dim: int):
    """Looks up the queries of each file among its data; rows come sorted by file and block."""

    def look(rows: list[tuple], out: list[list[np.ndarray]]) -> None:
        role = np.array([r[0] for r in rows])
        cls = np.array([r[1] for r in rows], dtype=np.int64)
        note = np.array([r[2] for r in rows], dtype=np.int64)
        many = np.array([r[3] for r in rows])
        pre = np.frombuffer(b"".join(r[4] for r in rows), dtype="<u2").reshape(-1, length)
        x = _unit(np.frombuffer(b"".join(r[5] for r in rows), dtype="<i2").reshape(-1, dim))
        data, ask = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        if not len(data) or not len(ask):
            return
        names, local = np.unique(pre[data], return_inverse=True)
        local = local.ravel()
        weight = np.tile(np.arange(length, 0, -1, dtype=np.uint8), len(data))
        xd, cd, nd, md = x[data], cls[data], note[data], many[data]
        step = max(1, 1_500_000 // len(local))
        for s in range(0, len(ask), step):
            q = ask[s : s + step]
            spot = np.searchsorted(names, pre[q])
            spot[spot == len(names)] = 0
            w = np.where(names[spot] == pre[q], np.arange(length, 0, -1, dtype=np.uint8), 0).astype(np.uint8)
            table_ = np.zeros((len(q), len(names)), dtype=np.uint8)
            np.maximum.at(table_, (np.arange(len(q))[:, None], spot), w)
            # the footrule distance of two orders falls by twice this sum
            shared = np.minimum(table_.take(local, axis=1), weight).reshape(len(q), len(data), length).sum(axis=2, dtype=np.int16)
            own = (cd[None, :] == cls[q][:, None]) | ((nd[None, :] == note[q][:, None]) & ~md[None, :] & ~many[q][:, None])
            shared[own] = -1
            cos = x[q] @ xd.T
            if len(data) > rerank:
                # of candidates as good as the last one all are reranked
                last = np.partition(shared, len(data) - rerank, axis=1)[:, len(data) - rerank]
                cos[shared < last[:, None]] = -2
            cos[shared < 0] = -2
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if len(data) > k else np.tile(np.arange(len(data)), (len(q), 1))
            best = np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1)
            cos = np.take_along_axis(cos, best, 1)
            at, place = np.nonzero(cos >= max(least, -1.5))
            if len(at):
                b = best[at, place]
                for c, v in zip(out, (cls[q][at], note[q][at], many[q][at], cd[b], nd[b], md[b], cos[at, place])):
                    c.append(v)

    names = ["a", "note_a", "many_a", "b", "note_b", "many_b", "cos"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.float32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in names]

        def made() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], type=t) for c, t in zip(out, kinds)], names=names)
            for c in out:
                c.clear()
            return done

        last, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(9)]
            for r in zip(*cols):
                if r[:3] != last:
                    if rows:
                        look(rows, out)
                    last, rows = r[:3], []
                rows.append(r[3:])
            if sum(map(len, out[0])) > 50_000:
                yield made()
        if rows:
            look(rows, out)
        yield made()

    return run


def most_similar(
    vectors: DataFrame,
    owner: list[str],
    id_col: str,
    vec_col: str,
    k: int,
    queries: Column | None = None,
    min_cosine: float = -1.5,
    dim: int = DIM,
    pivots: int | Callable[[int], int] | None = None,
    lists_of: Callable[[int], int] | None = None,
    compared: int | None = None,
    length: int = 12,
    data_lists: int = 4,
    query_lists: int | None = None,
    rerank: int = 48,
) -> DataFrame:
    """``id_a, id_b, cosine, rank`` (1 to k): for each usable vector (for which ``queries`` holds) the k most similar
    usable vectors of other owners, of those with at least ``min_cosine``.

    ``pivots`` is their number or a function of the number of vectors; ``lists_of`` gives the files that a query looks up for
    the number of pivots; orders are compared by their first ``compared`` pivots."""
    spark = vectors.sparkSession
    flagged = vectors.withColumn("_query_", F.lit(True) if queries is None else F.coalesce(queries, F.lit(False)))
    rows = _quantised(vectors, owner, id_col, vec_col, dim)
    if queries is None:
        rows = rows.withColumn("query", F.lit(True))
    else:
        asked = flagged.where("_query_").select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("query"))
        rows = rows.join(broadcast_bounded(asked), "id", "left").withColumn("query", F.coalesce("query", F.lit(False)))
    n = vectors.where(usable(vectors[vec_col], dim) & F.col(id_col).isNotNull()).count()
    size = min(MAX_PIVOTS, max(32, n // PER_PIVOT if pivots is None else pivots(n) if callable(pivots) else pivots))
    # about four times as many rows are drawn, as equal vectors make one pivot; by a bound on the hash, so that what reaches
    # the driver does not grow with the number of tasks
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    drawn = rows.select("q", h.alias("h")).where(F.col("h") < int((1 << 40) * min(1.0, 4 * size / max(1, n))) + 1).limit(8 * size).collect()
    chosen = list(dict.fromkeys(r["q"] for r in sorted(drawn, key=lambda r: r["h"])))[:size]
    if not chosen:
        return spark.createDataFrame([], "id_a bigint, id_b bigint, cosine double, rank int")
    points = _unit(np.stack([np.frombuffer(q, dtype="<i2") for q in chosen]))
    if lists_of is not None:
        length = query_lists = lists_of(len(points))
    length = min(length, len(points), 255)
    compared = min(length, compared or length)
    pairs = PAIRS_FROM is not None and n > PAIRS_FROM
    grouped = rows.groupBy("q").agg(F.min(F.struct("id", "note")).alias("f"), F.count("*").alias("n"), (F.min("note") != F.max("note")).alias("many"), F.max("query").alias("query"))
    orders = cut(_orders(grouped.select(F.col("f.id").alias("cls"), F.col("f.note").alias("note"), "many", "query", "n", "q"), points, length, dim))
    if query_lists is None:
        posts = _posted(orders, data_lists, length, pairs, compared).withColumn("role", F.when(F.col("query"), 3).otherwise(2))
    else:
        posts = _posted(orders, data_lists, length, pairs, compared).withColumn("role", F.lit(2))
        posts = posts.unionByName(_posted(orders.where("query"), query_lists, length, pairs, compared).withColumn("role", F.lit(1)))
    # only files that are too long need blocks
    lengths = _posted(orders, data_lists, length, pairs, compared).groupBy("file").agg(F.count("*").alias("m"))
    long = cut(lengths.where(F.col("m") > MAX_LIST).select("file", F.ceil(F.col("m") / MAX_LIST).cast("int").alias("blocks")))
    posts = posts.join(broadcast_bounded(long), "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    fixed = ["role", "cls", "note", "many", "pre", "q"]
    short = posts.where("blocks = 1").select("file", F.lit(0).alias("i"), F.lit(0).alias("j"), *fixed)
    blocked = posts.where("blocks > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("mine", mine)
    as_data = blocked.where("role >= 2").select("file", F.col("mine").alias("i"), F.col("o").alias("j"), F.lit(2).alias("role"), *fixed[1:])
    as_query = blocked.where("role <> 2").select("file", F.col("o").alias("i"), F.col("mine").alias("j"), F.lit(1).alias("role"), *fixed[1:])
    files = short.unionByName(as_data).unionByName(as_query) if long.limit(1).count() else short
    met = files.repartition("file", "i", "j").sortWithinPartitions("file", "i", "j").mapInArrow(
        _ranked(max(2 * k, 6), rerank, min_cosine, compared, dim), "a bigint, note_a bigint, many_a boolean, b bigint, note_b bigint, many_b boolean, cos float"
    )
    met = met.groupBy("a", "note_a", "b", "note_b").agg(F.max("cos").alias("cos"))
    # members of classes of equal vectors: for each as many as the nearest of any other owner may need
    copies = orders.where("n > 1").select("cls", "q", "query")
    members = cut(rows.select("id", "note", "q", F.col("query").alias("asked")).join(broadcast_bounded(copies.select("cls", "q")), "q").select("cls", "id", "note", "asked"))
    per_note = Window.partitionBy("cls", "note").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(per_note)).where(F.col("r") <= k)
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= 2 * k).select("cls", "id", F.col("note").alias("note_h"))
    heads = broadcast_bounded(cut(heads))
    near = met.join(heads, met["b"] == heads["cls"], "left").select("a", "note_a", F.coalesce("id", "b").alias("b"), F.coalesce("note_h", "note_b").alias("note_b"), "cos")
    near = near.unionByName(heads.select(F.col("cls").alias("a"), F.lit(None).cast("long").alias("note_a"), F.col("id").alias("b"), F.col("note_h").alias("note_b"), F.lit(1.0).cast("float").alias("cos")))
    order = [F.desc("cos"), F.asc("b")]
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("a", "note_b").orderBy(*order))).where(F.col("r") <= k)
    # read twice below, so the ranking of the files is not run twice
    near = cut(near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("r") <= 2 * k))
    twins = members.where("asked").select("cls", F.col("id").alias("id_m"), F.col("note").alias("note_m"))
    alone = near.join(heads.select("cls").distinct(), near["a"] == F.col("cls"), "left_anti").select(F.col("a").alias("id_a"), "note_a", "b", "note_b", "cos")
    shared = near.join(twins, near["a"] == twins["cls"]).select(F.col("id_m").alias("id_a"), F.col("note_m").alias("note_a"), "b", "note_b", "cos")
    final = alone.unionByName(shared).where("note_a <> note_b")
    final = final.withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(*order))).where(F.col("rank") <= k)
    return final.select("id_a", F.col("b").alias("id_b"), F.col("cos").cast("double").alias("cosine"), "rank")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with a cosine of at least 0.9 of which one is among the 5 most similar of the other."""
    near = most_similar(table(spark, folder, "vectors"), ["vault", "key"], "vec_id", "embedding", k=5, min_cosine=0.9)
    return near.select(F.least("id_a", "id_b").alias("vec_a"), F.greatest("id_a", "id_b").alias("vec_b")).distinct()


def knn_pivots(n: int) -> int:
    """Pivots for the nearest of every asked vector: as the root of the collection."""
    return max(64, int(4 * n**0.5))


def knn_lists(pivots: int) -> int:
    """Files that a query looks up: as the root of the pivots, so that its share of the collection falls as it grows (a half
    of 18 000 vectors, a quarter of 180 000, a sixth of 1.8 million)."""
    return min(255, max(8, int(3 * pivots**0.5)))


def p1_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar vectors of other notes for every vector whose id is divisible by 50, against all."""
    near = most_similar(table(spark, folder, "vectors"), ["vault", "key"], "vec_id", "embedding", k=5, queries=F.col("vec_id") % 50 == 0, pivots=knn_pivots, lists_of=knn_lists, compared=48, rerank=400)
    return near.select("id_a", "id_b", F.round("cosine", 4).alias("cosine"), "rank")


SQL = {
    "p1_found": """with u as (select vec_id, vault, "key", cast(embedding as double[]) e from vectors where vec_id is not null and embedding is not null and len(embedding) = 64
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select a.vec_id a, b.vec_id b, list_cosine_similarity(a.e, b.e) c from u a join u b on a.vault is distinct from b.vault or a."key" is distinct from b."key"),
r as (select a, b, c from s qualify row_number() over (partition by a order by c desc, b) <= 5)
select distinct least(a, b) vec_a, greatest(a, b) vec_b from r where c >= 0.9""",
}
QUERIES = {"p1_found": p1_found, "p1_knn": p1_knn}
