"""Near-duplicate records with small edits.

Method: multi-index hashing. The fingerprint of a text is a string of ``SEGMENTS`` x ``WIDTH`` 16-bit symbols, each cut
from the minimum of one hash function over the text's runs of three words, so the share of equal symbols estimates the share
of equal runs. In each segment the Hamming ball of radius 1 is enumerated (one key for each masked symbol); texts
that share a key in a segment's table are fetched, their complete Hamming distance is verified, and the exact share
of equal runs decides. A pair must share a ball in one of 8 segments of 4 and differ in at most 20 of 32 symbols: at a
similarity of 0.6 both hold with a probability of 0.9926, at 0.65 of 0.9985, at 0.7 of 0.9998.

Texts with equal sets of runs are one class; only its smallest member enters the tables, so copies cost nothing
whatever their number. A bucket of over ``BUCKET`` texts is not joined with itself but compared in blocks of that
size, of which each task holds two: all its pairs are looked at, only those within the distance leave the task.
Keys that many texts share are told from the texts whose hash is divisible by ``DRAWN`` before anything is shuffled. They
never meet in one task: their texts are posted again under the key and each of so many further symbols that two texts
within the distance must have one of them in common, which loses nothing and parts the texts that are not alike.

Defined results: words are maximal runs of letters and digits, lower-cased; texts of fewer than ``MIN_WORDS`` words,
null and blank ones belong to no pair; texts of any length are read whole; rows repeated under one key are one
record; ties go to the smaller key by bytes. Of classes with up to ``EXPAND`` members all pairs are given. In larger ones
exact copies of a text appear by their pair with its smallest bearer, and these bearers in all pairs with one another and
with those of linked classes, so that no link between different texts and no membership is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.session import broadcast_bounded, cut
from notelake.sources.tables import table

MIN_WORDS = 20
RUN = 3
SIMILARITY = 0.6
SEGMENTS, WIDTH = 8, 4
SYMBOLS = SEGMENTS * WIDTH
BUCKET = 256
EXPAND = 64
#: One in so many texts tells which keys are hot: those of at least ``BUCKET`` of the texts drawn.
DRAWN = 64

_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20240131)
_MULTIPLY = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def runs(text: str, min_words: int = MIN_WORDS) -> np.ndarray | None:
    """The sorted 64-bit hashes of the different runs of three words; none for a text of too few words."""
    words = _WORD.findall(text.lower())
    if len(words) < max(min_words, RUN):
        return None
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    mixed = np.zeros(len(h) - RUN + 1, dtype=np.uint64)
    for k in range(RUN):
        x = h[k : len(h) - RUN + 1 + k] * _PLACE[k % 3] + np.uint64(k)
        mixed = (mixed ^ x) * _PLACE[1]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` minima as 16-bit symbols."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[k : k + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return ((low * _PLACE[0]) >> np.uint64(48)).astype("<u2")


def _mask_keys(fps: np.ndarray) -> np.ndarray:
    """Keys of the balls of radius 1, a row for each fingerprint: for each segment and masked place a hash of the others."""
    seg = fps.reshape(-1, SEGMENTS, WIDTH).astype(np.uint64)
    out = np.empty(seg.shape, dtype=np.uint64)
    for place in range(WIDTH):
        x = np.arange(SEGMENTS, dtype=np.uint64)[None, :] * np.uint64(WIDTH) + np.uint64(place)
        for k in range(WIDTH):
            if k != place:
                x = (x << np.uint64(16)) ^ (x >> np.uint64(48)) ^ seg[:, :, k]
                x = x * _PLACE[0]
        out[:, :, place] = x ^ (x >> np.uint64(31))
    return out.reshape(len(fps), SYMBOLS)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(items: DataFrame, key_cols: list[str], text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """The key columns, ``digest`` of the set of runs, ``fp`` (packed symbols) and ``exact`` (hash of the whole text) of each text
    long enough."""
    slim = items.select(*key_cols, items[text_col].alias("_text_")).where("_text_ is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[: len(key_cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, fps, exact = [], [], [], []
            for k, text in enumerate(batch.column(len(key_cols))):
                whole = text.as_py()
                found = runs(whole, min_words)
                if found is None:
                    continue
                rows.append(k)
                digests.append(_digest(found))
                fps.append(fingerprint(found).tobytes())
                exact.append(xxhash.xxh3_64_intdigest(whole) - (1 << 63))
            own = [pa.array(digests, type=pa.binary()), pa.array(fps, type=pa.binary()), pa.array(exact, type=pa.int64())]
            kept = [batch.column(k).take(pa.array(rows, type=pa.int32())) for k in range(len(key_cols))]
            yield pa.RecordBatch.from_arrays([*kept, *own], names=[*key_cols, "digest", "fp", "exact"])

    return slim.mapInArrow(run, f"{fields}, digest binary, fp binary, exact bigint")


def _block_pairs(max_distance: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        a = np.frombuffer(b"".join(left["fp"]), dtype="<u2").reshape(-1, SYMBOLS)
        b = np.frombuffer(b"".join(right["fp"]), dtype="<u2").reshape(-1, SYMBOLS)
        ia, ib = left["digest"].to_numpy(), right["digest"].to_numpy()
        out_a, out_b = [], []
        for k in range(len(a)):
            near = np.flatnonzero((b != a[k]).sum(axis=1) <= max_distance)
            for j in near:
                if ia[k] < ib[j]:
                    out_a.append(ia[k])
                    out_b.append(ib[j])
        return pd.DataFrame({"a": pd.Series(out_a, dtype=object), "b": pd.Series(out_b, dtype=object)})

    return compare


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cid`` (first 8 bytes of the digest) and each key of ``digest, fp``, with its place among them."""
    for batch in batches:
        n = batch.num_rows
        fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(n, SYMBOLS)
        cid = np.array([int.from_bytes(d[:8], "big", signed=True) for d in batch.column(0).to_pylist()], dtype=np.int64)
        place = pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int32), n))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid, SYMBOLS)), pa.array(_mask_keys(fps).view(np.int64).ravel()), place], names=["cid", "k", "place"])


def _within(max_distance: int):
    """The pairs (``a, fa, b, fb``) whose complete distance is small enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fa, fb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, SYMBOLS) for c in (1, 3))
            take = pa.array(np.flatnonzero((fa != fb).sum(axis=1) <= max_distance))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take)], names=["a", "b"])

    return run


def _bucket_pairs(posted: DataFrame, fps: DataFrame, max_distance: int, bucket: int) -> DataFrame:
    """Pairs ``a < b`` of digests within the distance among the texts of each key of ``posted`` (``cid, k, n``: the key's texts)."""
    small = posted.where(F.col("n") <= bucket).select("k", "cid")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.cid") < F.col("y.cid")))
    pairs = pairs.select(F.col("x.cid").alias("ca"), F.col("y.cid").alias("cb")).distinct()
    pairs = pairs.join(fps.select(F.col("cid").alias("ca"), F.col("digest").alias("a"), F.col("fp").alias("fa")), "ca")
    pairs = pairs.join(fps.select(F.col("cid").alias("cb"), F.col("digest").alias("b"), F.col("fp").alias("fb")), "cb")
    near = pairs.select("a", "fa", "b", "fb").mapInArrow(_within(max_distance), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # blocks of large buckets: each block is sent to the tasks in which it meets itself and the others
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    large = posted.where(F.col("n") > bucket).select("k", "cid", blocks.alias("blocks")).join(fps, "cid")
    large = large.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = large.select("k", "digest", "fp", F.col("block").alias("i"), others.alias("j"), F.lit(0).alias("side")).unionByName(
        large.select("k", "digest", "fp", F.col("block").alias("j"), others.alias("i"), F.lit(1).alias("side"))
    )
    return near.unionByName(sides.groupBy("k", "i", "j").applyInPandas(_block_pairs(max_distance), "a binary, b binary"))


def candidate_pairs(classes: DataFrame, max_distance: int, bucket: int = BUCKET, drawn: int = DRAWN) -> DataFrame:
    """Pairs ``a < b`` of the digests of ``classes`` (``digest, fp``) that share a key and lie within the distance.

    Keys are posted under 8 bytes of the digest; should two digests share these, each is fetched and verified."""
    fps = classes.select("digest", "fp", F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("bigint").alias("cid"))
    # whether a key counts as hot decides only how its texts are compared, never which
    sample = classes.select("digest", "fp").where(F.pmod(F.xxhash64("digest"), F.lit(drawn)) == 0)
    hot = cut(sample.mapInArrow(_post, "cid bigint, k bigint, place int").groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") >= bucket).select("k"))
    posted = classes.select("digest", "fp").mapInArrow(_post, "cid bigint, k bigint, place int")
    any_hot = hot.limit(1).count() > 0
    cold = posted.select("cid", "k").join(broadcast_bounded(hot), "k", "left_anti") if any_hot else posted.select("cid", "k")
    # read by both sides of the join below: postings are shuffled once
    shared = cut(cold.withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1"))
    out = _bucket_pairs(shared, fps, max_distance, bucket)
    if any_hot:
        # two texts that differ in at most max_distance symbols have one in common among any max_distance + 1 of them
        others = F.array([F.array([F.lit(p) for p in range(SYMBOLS) if p // WIDTH != g]) for g in range(SEGMENTS)])
        far = F.slice(F.element_at(others, F.floor(F.col("place") / WIDTH).cast("int") + 1), 1, max_distance + 1)
        again = posted.join(broadcast_bounded(hot), "k").join(fps, "cid")
        again = again.select("cid", F.explode(F.transform(far, lambda p: F.xxhash64("k", p, F.substring("fp", p * 2 + 1, 2)))).alias("k")) if max_distance + 1 <= SYMBOLS - WIDTH else again.select("cid", "k")
        counts = again.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(_bucket_pairs(again.join(counts, "k"), fps, max_distance, bucket))
    return out.distinct()


def _own_texts(min_words: int):
    """The rows (``digest, _text_``) whose text has the class's set of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, (digest, text) in enumerate(zip(batch.column(0), batch.column(1))):
                found = runs(text.as_py(), min_words)
                if found is not None and _digest(found) == digest.as_py():
                    kept.append(k)
            yield batch.take(pa.array(kept, type=pa.int32()))

    return run


def _similar(similarity: float, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}

            def of(digest: bytes, text: str) -> np.ndarray:
                if digest not in known:
                    known[digest] = runs(text, min_words)
                return known[digest]

            kept, shares = [], []
            for k in range(batch.num_rows):
                a, b, ta, tb = (batch.column(c)[k].as_py() for c in range(4))
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                share = both / (len(x) + len(y) - both)
                if share >= similarity:
                    kept.append(k)
                    shares.append(share)
            take = pa.array(kept, type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(shares, type=pa.float64())], names=["a", "b", "share"])

    return run


def class_links(items: DataFrame, key_cols: list[str], text_col: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Members (``digest``, key columns, ``exact``) and links (``a, b, share``) between different classes of equal texts."""
    # symbols that may differ: as many as at the least similarity on average, and eight (almost three deviations) more
    max_distance = min(SYMBOLS, int(SYMBOLS * (1 - similarity) + 8))
    signed = cut(signatures(items, key_cols, text_col, min_words))
    members = signed.select("digest", *key_cols, "exact").distinct()
    first = F.struct(*key_cols)
    classes = cut(signed.groupBy("digest").agg(F.min("fp").alias("fp")))
    pairs = cut(candidate_pairs(classes, max_distance))
    named = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    reps = signed.select("digest", *key_cols).join(named, "digest").groupBy("digest").agg(F.min(first).alias("rep")).select("digest", "rep.*")
    reps = reps.select("digest", *[F.col(c).alias(f"_{k}_") for k, c in enumerate(key_cols)])
    same = [F.col(c).eqNullSafe(F.col(f"_{k}_")) for k, c in enumerate(key_cols)]
    # rows of one key may have different texts: only those with the class's set of runs are its texts, and any of them will do
    texts = items.select(*key_cols, items[text_col].alias("_text_")).where("_text_ is not null").join(reps, same).select("digest", "_text_")
    texts = texts.mapInArrow(_own_texts(min_words), "digest binary, _text_ string").groupBy("digest").agg(F.max("_text_").alias("_text_"))
    joined = pairs.join(texts.select(F.col("digest").alias("a"), F.col("_text_").alias("ta")), "a").join(texts.select(F.col("digest").alias("b"), F.col("_text_").alias("tb")), "b")
    links = joined.select("a", "b", "ta", "tb").mapInArrow(_similar(similarity, min_words), "a binary, b binary, share double")
    return members, links


def near_pairs(items: DataFrame, key_cols: list[str], text_col: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, expand: int = EXPAND) -> DataFrame:
    """Pairs of records, ``<key>_a`` before ``<key>_b`` by bytes, with their ``share``."""
    members, links = class_links(items, key_cols, text_col, similarity, min_words)
    key = F.struct(*key_cols)
    texts = members.groupBy("digest", "exact").agg(F.count("*").alias("c"), F.min(key).alias("rep"))
    sizes = texts.groupBy("digest").agg(F.sum("c").alias("n"))
    linked = links.select(F.col("a").alias("digest")).union(links.select(F.col("b").alias("digest"))).distinct().withColumn("linked", F.lit(True))
    wanted = sizes.join(linked, "digest", "left").where("n > 1 or linked").select("digest", "n")
    placed = members.join(wanted.join(texts.select("digest", "exact", "rep"), "digest"), ["digest", "exact"]).withColumn("key", key)
    placed = placed.withColumn("shown", (F.col("n") <= expand) | (F.col("key") == F.col("rep")))
    shown = placed.where("shown").select("digest", "key", "n").distinct()
    ends = shown.select("digest", "key")
    across = links.join(ends.select(F.col("digest").alias("a"), F.col("key").alias("x")), "a").join(ends.select(F.col("digest").alias("b"), F.col("key").alias("y")), "b").select("x", "y", "share")
    several = shown.where("n > 1").select("digest", "key")
    same = several.alias("s").join(several.alias("t"), (F.col("s.digest") == F.col("t.digest")) & (F.col("s.key") < F.col("t.key")))
    same = same.select(F.col("s.key").alias("x"), F.col("t.key").alias("y"), F.lit(1.0).alias("share"))
    star = placed.where("not shown").select(F.col("rep").alias("x"), F.col("key").alias("y"), F.lit(1.0).alias("share"))
    pairs = across.unionByName(same).unionByName(star).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "share")
    return pairs.select(*[F.col(f"x.{c}").alias(f"{c}_a") for c in key_cols], *[F.col(f"y.{c}").alias(f"{c}_b") for c in key_cols], "share")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links`` (``a, b``): the smallest node that each is connected with.

    Alternating large and small stars, with a checkpoint each round; no node's neighbours are gathered."""
    edges = cut(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("x"), F.col("v").alias("y")).where("x <> y").union(low.select(F.col("m").alias("x"), F.col("u").alias("y"))).distinct()
        after = cut(small.select(F.col("x").alias("u"), F.col("y").alias("v")))
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()


def groups(items: DataFrame, key_cols: list[str], text_col: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each record that is in a group: its keys, the group's id (the smallest class digest) and the number of
    other classes its class is linked with."""
    members, links = class_links(items, key_cols, text_col, similarity, min_words)
    links = cut(links)
    members = members.drop("exact").distinct()
    root = components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    size = members.groupBy("digest").agg(F.count("*").alias("n"))
    rows = members.join(size, "digest").join(root.join(degree, "node").withColumnRenamed("node", "digest"), "digest", "left").where("n > 1 or root is not null")
    return rows.select(*key_cols, F.hex(F.coalesce("root", "digest")).alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notes of which one's body is an edited copy of the other's."""
    return near_pairs(table(spark, folder, "notes"), ["vault", "key"], "body").select("vault_a", "key_a", "vault_b", "key_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of notes that are edited copies of one another."""
    return groups(table(spark, folder, "notes"), ["vault", "key"], "body")


SQL = {
    "p5_found": r"""with w as (select vault, "key", regexp_extract_all(lower(body), '[\p{L}\p{N}]+') w from notes where body is not null),
s as (select distinct vault, "key", unnest(list_transform(range(1, len(w) - 1), lambda i: w[i]||' '||w[i + 1]||' '||w[i + 2])) g from w where len(w) >= 20),
i as (select vault, "key", g, dense_rank() over (order by vault, "key") id from s), n as (select id, any_value(vault) vault, any_value("key") k, count(*) n from i group by id),
p as (select a.id a, b.id b, count(*) c from i a join i b on a.g = b.g and a.id < b.id group by 1, 2)
select x.vault vault_a, x.k key_a, y.vault vault_b, y.k key_b from p join n x on x.id = p.a join n y on y.id = p.b where c >= 0.6 * (x.n + y.n - c)""",
}
QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
