"""Mapping of freely typed values to a canonical list.

Method: a prefix-filter set-similarity join. A value becomes a set of character pairs (numbered where repeated) of its
folded form. Pairs are ordered by rarity over all values, those that no list entry has first. Two sets with a Jaccard
similarity of at least ``t`` must share one of the first ``n - ceil(t n) + 1`` pairs of each, so only these are joined;
the sizes must allow ``t`` (length filter) and so must the places of the shared pair (positional filter). The Jaccard
similarity of the survivors is computed exactly. An exact check on the letters then decides whether the value is a
way of typing the entry, and the entry of the greatest similarity is kept (of equally similar ones that of fewer edits).

The exact check compares the words in every rotation (``forecast, Latency``; ``rotation of caches``) by edit distance
with transpositions, in which an end cut off by up to three letters counts less. Each word of the entry must itself be
found, and a value all of whose words are words of the list but in no listed combination means none of them.

Every distinct value is looked at once. Values that many rows carry are mapped by a broadcast of at most
``MAX_HEAVY`` rows, the others by a shuffle join.

Defined results: values are compared without leading and trailing Unicode white space; null and blank values are no
values; a value equal to an entry's main name needs no mapping and is not reported; an empty list matches nothing;
of equally good entries the smallest id wins; repeated rows come out each; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.functions.text import trimmed
from notelake.session import broadcast_bounded, cut
from notelake.sources.tables import table

#: Least Jaccard similarity of the pairs of letters.
SIMILARITY = 0.35
#: Values carried by at least so many rows are heavy; the most frequent of them, at most MAX_HEAVY, are broadcast.
HEAVY_ROWS = 5_000
MAX_HEAVY = 1_000
#: A list of up to so many entries is held by each worker; for a longer one the join is a shuffle. Both give the same rows.
HELD_ENTRIES = 200_000
#: Edits at most between a value and its entry.
MOST_EDITS = 4

# Letters of other scripts that look like a Latin one, and digits and signs typed for letters.
ALIKE = str.maketrans("аеорсухіѕјԁһкмтвнгпαοερντικυ", "aeopcyxisjdhkmtbhrnaoepvtiku")
TYPED = str.maketrans("013457@$", "oieastas")
# Words put before or after a title that are no part of it.
BEFORE = {"the", "our", "my", "a", "an", "on", "re", "fw", "fwd", "wip", "draft", "todo", "new", "see", "about", "old"}
AFTER = {"page", "pages", "notes", "note", "draft", "old", "wip", "md", "doc", "copy", "new", "v1", "v2", "v3", "v4", "v5", "tbd", "final"}

_PARTS = regex.compile(r"[^\W_]+")


def fold(value: str) -> str:
    """Lower case without marks, invisible characters, look-alike letters, anchors and signs; words by single spaces."""
    s = unicodedata.normalize("NFKC", value).casefold().translate(ALIKE)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) not in ("Mn", "Cf"))
    head, hash_sign, _ = s.partition("#")
    if hash_sign and any(c.isalnum() for c in head):
        s = head
    if s.endswith(".md"):
        s = s[:-3]
    words = [w.translate(TYPED) if not w.isdigit() and not regex.fullmatch(r"v\d", w) else w for w in _PARTS.findall(regex.sub(r"(?<=[a-z])[@$](?=[a-z])", lambda m: m[0].translate(TYPED), s))]
    return " ".join(words)


_NUMBER = regex.compile(r"v?\d+")


def stripped(words: list[str], known: frozenset[str] | None = None) -> list[str]:
    """Without added words at both ends; with ``known``, the list's words, without numbers and versions that are none of them."""
    a, b = 0, len(words)
    while b - a > 1 and (words[b - 1] in AFTER or (known is not None and words[b - 1] not in known and _NUMBER.fullmatch(words[b - 1])) or any(edits(words[b - 1], w, 1) <= 1 for w in AFTER if len(w) > 3)):
        b -= 1
    while b - a > 1 and words[a] in BEFORE:
        a += 1
    return words[a:b]


def pairs_of(folded: str) -> list[str]:
    """The numbered pairs of letters of a folded value, spaces left out."""
    s = "".join(stripped(folded.split()))
    seen: Counter[str] = Counter()
    out = []
    for k in range(max(1, len(s) - 1)):
        p = s[k : k + 2]
        seen[p] += 1
        out.append(p if seen[p] == 1 else f"{p}{seen[p]}")
    return out if s else []


def prefix_size(n: int, t: float) -> int:
    return n - ceil(t * n - 1e-9) + 1


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, ``most + 1`` if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new[j] = d
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def inside(word: str, text: str) -> int:
    """Fewest edits between ``word`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    before: list[int] = []
    for i, x in enumerate(word, 1):
        new = [i] + [0] * len(text)
        for j, y in enumerate(text, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == text[j - 2] and word[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new[j] = d
        before, row = row, new
    return min(row)


def allowed(n: int) -> int:
    """Edits allowed in a word of n letters."""
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 9 else 3


def means(value: str, entry: str, words: frozenset[str]) -> int | None:
    """Edits by which a folded value differs from a folded entry, if it is a way of typing it. ``words``: of all entries."""
    v = stripped(value.split(), words)
    e = entry.split()
    if v == e:
        return 0
    goal = "".join(e)
    singular = [w if w in words else w[:-1] if w[-1:] == "s" and w[:-1] in words else w for w in v if w != "of" or "of" in e]
    if sorted(singular) == sorted(e):
        return 0
    if all(w in words for w in singular) and len(singular) > 1:
        return None
    most = 1 if len(goal) < 7 else 2 if len(goal) < 11 else 3 if len(goal) < 15 else 4
    if len(e) == 1:
        most = min(most, 2)
    best = most + 1
    parts = [w for w in v if w != "of" or "of" in e]
    if not parts:
        return None
    plain = "".join(parts)
    for k in range(len(parts)):
        turned = "".join(parts[k:] + parts[:k])
        best = min(best, edits(turned, goal, best))
        # an end cut off
        for cut_off in (2, 3):
            if best > 1 and len(goal) - cut_off >= 6:
                best = min(best, 1 + edits(turned, goal[:-cut_off], best))
            if best > 1 and k and len(e) > 1 and len(e[0]) - cut_off >= 3:
                best = min(best, 1 + edits(turned, e[0][:-cut_off] + "".join(e[1:]), best))
    if best > most:
        return None
    doubled = plain + plain
    for k, w in enumerate(e):
        if len(w) > 3 and inside(w, doubled) > allowed(len(w)):
            # the last word may lack its end
            if k in (0, len(e) - 1) and len(w) > 6 and inside(w[:-3], doubled) <= 1:
                continue
            return None
    return best


def folded_names(names: DataFrame) -> DataFrame:
    """Distinct ``id, name`` (folded, with letters or digits) of the list ``names`` (``id, name``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(v) for v in batch.column(1).to_pylist()], type=pa.string())], names=["id", "name"])

    rows = names.where("id is not null and name is not null").select(F.col("id").cast("int").alias("id"), "name").distinct()
    return rows.mapInArrow(run, "id int, name string").where("name <> ''").distinct()


def _pair_counts(values: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many of the distinct values have each of the pairs ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for folded in batch.column(0).to_pylist():
                total.update(wanted.intersection(pairs_of(folded)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], names=["pair", "n"])

    counted = values.select("folded").mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in counted.collect()}


def folded_values(values: DataFrame) -> DataFrame:
    """``value, n, folded`` for ``value, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fold(v) for v in batch.column(0).to_pylist()], type=pa.string())], names=["value", "n", "folded"])

    return values.select("value", "n").mapInArrow(run, "value string, n bigint, folded string")


def map_values(values: DataFrame, names: DataFrame, similarity: float = SIMILARITY, held: int = HELD_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """``value, n, id, similarity, edits`` for each distinct value (``value, n``) that means an entry of ``names`` (``id, name``),
    and all values. A list of at most ``held`` entries is held by each worker, so that candidates are found and judged
    without a shuffle; a longer one is joined by prefixes."""
    spark = values.sparkSession
    names = folded_names(names)
    entries = sorted((r["id"], r["name"]) for r in names.limit(held + 1).collect())
    if len(entries) > held:
        return _joined(cut(folded_values(values)), cut(names), similarity)
    words = frozenset(w for _, name in entries for w in name.split())
    values = cut(folded_values(values))
    entry_pairs = [pairs_of(name) for _, name in entries]
    counts = _pair_counts(values, {p for ps in entry_pairs for p in ps})
    rank = {p: k for k, p in enumerate(sorted(counts, key=lambda p: (counts[p], p)), 1)}

    ordered = [sorted(ps, key=lambda p: (rank.get(p, 0), p)) for ps in entry_pairs]
    sizes = np.array([len(ps) for ps in ordered])
    files: dict[str, list[tuple[int, int]]] = {}
    for k, ps in enumerate(ordered):
        for place, p in enumerate(ps[: prefix_size(len(ps), similarity)]):
            if p in rank:
                files.setdefault(p, []).append((k, place))
    posting = {p: (np.array([k for k, _ in f]), np.array([place for _, place in f])) for p, f in files.items()}
    letters = [Counter(name.replace(" ", "")) for _, name in entries]
    shared = spark.sparkContext.broadcast((entries, words, rank, [set(ps) for ps in ordered], sizes, posting, letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, words, rank, sets, sizes, posting, letters = shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for row, folded in enumerate(batch.column(2).to_pylist()):
                best = _best(folded, entries, words, rank, sets, sizes, posting, letters, similarity)
                if best:
                    for c, x in zip(cols, (row, *best)):
                        c.append(x)
            rows = pa.array(cols[0], type=pa.int32())
            own = [pa.array(c, type=t) for c, t in zip(cols[1:], (pa.int32(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *own], names=["value", "n", "id", "similarity", "edits"])

    return values.mapInArrow(run, "value string, n bigint, id int, similarity double, edits int"), values


def _best(folded, entries, words, rank, sets, sizes, posting, letters, similarity):
    """``(id, similarity, edits)`` of the entry that a folded value means, if any."""
    pairs = pairs_of(folded)
    n = len(pairs)
    ordered = sorted(pairs, key=lambda p: (rank.get(p, 0), p))
    met, left = [], []
    for place, p in enumerate(ordered[: prefix_size(n, similarity)] if n else ()):
        if p in posting:
            k, places = posting[p]
            met.append(k)
            # the first shared pair of two ordered sets has all later shared pairs behind it
            left.append(np.minimum(sizes[k] - places, n - place))
    if not met:
        return None
    k, left = np.concatenate(met), np.concatenate(left)
    size = sizes[k]
    fits = (np.minimum(size, n) >= similarity * np.maximum(size, n) - 1e-9) & (left >= similarity / (1 + similarity) * (size + n) - 1e-9)
    mine, own = set(pairs), _letters(folded, words)
    best = None
    for e in np.unique(k[fits]).tolist():
        found = _judged(folded, mine, own, entries[e][1], sets[e], letters[e], words, similarity)
        if found:
            found = (*found, entries[e][0])
            best = found if best is None or found < best else best
    return best and (best[2], -best[0], best[1])


def _letters(folded: str, words: frozenset[str]) -> Counter:
    return Counter("".join(w for w in stripped(folded.split(), words) if w != "of"))


def _judged(folded: str, mine: set, own: Counter, name: str, pairs: set, letters: Counter, words: frozenset[str], similarity: float) -> tuple[float, int] | None:
    """``(-similarity, edits)`` if a folded value is a way of typing a folded entry."""
    both = len(mine & pairs)
    jaccard = both / (len(mine) + len(pairs) - both)
    # no way of typing lacks or adds more letters than that
    if jaccard < similarity or sum((letters - own).values()) > MOST_EDITS + 3 or sum((own - letters).values()) > MOST_EDITS + 1:
        return None
    d = means(folded, name, words)
    return None if d is None else (-jaccard, d)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded text with its pairs."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pairs_of(v) for v in batch.column(0).to_pylist()], type=pa.list_(pa.string()))], names=["t", "pairs"])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded text with its words and their singulars."""
    for batch in batches:
        made = [sorted({x for w in v.split() for x in (w, w[:-1]) if x}) for v in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.list_(pa.string()))], names=["t", "words"])


def _prefixes(texts: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """``t, size, pair, place`` of the rare prefixes of distinct texts (``t``): pairs in the order of ``counts`` (``pair, c``), pairs
    that no entry has first. What is gathered of a text is its own pairs."""
    each = texts.mapInArrow(_listed, "t string, pairs array<string>").select("t", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))
    ordered = each.join(counts, "pair", "left").groupBy("t", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "pair"))).alias("o"))
    length = (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1).cast("int")
    return ordered.select("t", "size", F.posexplode(F.slice("o", 1, length)).alias("place", "x")).select("t", "size", "place", F.col("x.pair").alias("pair"))


def _joined(values: DataFrame, names: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``map_values`` for a list of any length: prefixes meet in a shuffle join on the pair, and each value carries those of
    its words that the list has. Pairs that no entry has cannot meet, and values keep their place among the others."""
    texts, listed = values.select(F.col("folded").alias("t")).distinct(), names.select(F.col("name").alias("t")).distinct()
    wanted = listed.mapInArrow(_listed, "t string, pairs array<string>").select(F.explode("pairs").alias("pair")).distinct()
    counts = texts.mapInArrow(_listed, "t string, pairs array<string>").select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("c"))
    counts = cut(counts.join(wanted, "pair"))
    left = _prefixes(texts, counts, similarity).select(F.col("t").alias("v"), F.col("size").alias("n"), F.col("place").alias("i"), "pair")
    right = _prefixes(listed, counts, similarity).select(F.col("t").alias("e"), F.col("size").alias("m"), F.col("place").alias("j"), "pair")
    size = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    place = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
    met = left.join(right, "pair").where(size & place).select("v", "e").distinct()
    known = listed.select(F.explode(F.split("t", " ")).alias("w")).distinct()
    words = texts.mapInArrow(_worded, "t string, words array<string>").select("t", F.explode("words").alias("w")).join(known, "w").groupBy("t").agg(F.collect_set("w").alias("words"))
    asked = met.join(words.withColumnRenamed("t", "v"), "v", "left").select("v", "e", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row, (v, e, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                found = _judged(v, set(pairs_of(v)), _letters(v, k := frozenset(w or ())), e, set(pairs_of(e)), Counter(e.replace(" ", "")), k, similarity)
                if found:
                    for c, x in zip(out, (row, *found)):
                        c.append(x)
            rows = pa.array(out[0], type=pa.int32())
            own = [pa.array(c, type=t) for c, t in zip(out[1:], (pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *own], names=["folded", "e", "s", "d"])

    judged = asked.mapInArrow(run, "folded string, e string, s double, d int").join(names.select(F.col("name").alias("e"), "id"), "e")
    best = judged.groupBy("folded").agg(F.min(F.struct("s", "d", "id")).alias("b"))
    return values.join(best, "folded").select("value", "n", F.col("b.id").alias("id"), (-F.col("b.s")).alias("similarity"), F.col("b.d").alias("edits")), values


def untitled(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows (``value``) that are not an entry's main name itself."""
    return rows.join(broadcast_bounded(names.select(F.col("name").alias("value")).distinct()), "value", "left_anti")


def with_head(rows: DataFrame) -> DataFrame:
    """The rows (``value``) with ``_head``, what stands before the first ``/``."""
    return rows.withColumn("_head", F.when(F.instr("value", "/") > 0, F.substring_index("value", "/", 1)))


def open_rows(rows: DataFrame, names: DataFrame, spaces: DataFrame) -> DataFrame:
    """The rows (``value``) that may need mapping: not an entry's main name itself, and without one of ``spaces`` (``name``)
    before a ``/``."""
    return with_head(untitled(rows, names)).join(broadcast_bounded(spaces.select(F.col("name").alias("_head")).distinct()), "_head", "left_anti").drop("_head")


def with_text(values: DataFrame, spaces: DataFrame) -> DataFrame:
    """The values (``value``) with ``text``, what names the page: the value without one of ``spaces`` (``name``) before its
    first ``/``, if anything follows."""
    known = broadcast_bounded(spaces.where("name is not null").select(F.col("name").alias("_head"), F.lit(True).alias("_known")).distinct())
    rest = trimmed(F.expr("substring(value, instr(value, '/') + 1)"))
    return with_head(values).join(known, "_head", "left").withColumn("text", F.when(F.col("_known") & (F.length(rest) > 0), rest).otherwise(F.col("value"))).drop("_head", "_known")


def with_mapping(rows: DataFrame, mapped: DataFrame, values: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The rows (with ``value``) whose value is mapped, with ``id``; heavy ones of all ``values`` never enter the shuffle."""
    top = values.where(F.col("n") >= heavy_rows).orderBy(F.desc("n"), "value").limit(max_heavy).select("value").collect()
    if not top:
        return rows.join(mapped.select("value", "id"), "value")
    heavy = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in top], T.StructType([T.StructField("value", T.StringType())])))
    hot = rows.join(F.broadcast(mapped.join(heavy, "value", "left_semi").select("value", "id")), "value")
    cold = rows.join(heavy, "value", "left_anti").join(mapped.select("value", "id"), "value")
    return hot.unionByName(cold)


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    links, updates, topics = (table(spark, folder, t) for t in ("wiki_links", "note_updates", "topics"))
    rows = links.select(F.lit("wiki_links").alias("src"), F.col("link_id").alias("rec_id"), trimmed("target").alias("value")).unionByName(
        updates.select(F.lit("note_updates").alias("src"), F.col("update_id").alias("rec_id"), trimmed("title").alias("value"))
    )
    names = topics.select(F.col("topic_id").alias("id"), F.col("title").alias("name"))
    every = names.unionByName(topics.select(F.col("topic_id").alias("id"), F.explode("aka").alias("name")))
    return rows.where(F.length("value") > 0), names, every, table(spark, folder, "vaults").select("name")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record whose value is another way of typing a topic."""
    rows, names, every, spaces = _inputs(spark, folder)
    rows = open_rows(rows, names, spaces)
    mapped, values = map_values(rows.groupBy("value").agg(F.count("*").alias("n")), every)
    return with_mapping(rows, cut(mapped), values).select("src", "rec_id", F.col("id").alias("topic_id"))


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct values that mean no topic, with the number of rows that carry them. A value with a vault name before a
    ``/`` means what follows, and is reported if that is no topic's name and no way of typing one."""
    rows, names, every, spaces = _inputs(spark, folder)
    values = cut(with_text(untitled(rows, names).groupBy("value").agg(F.count("*").alias("n")), spaces))
    mapped, _ = map_values(values.groupBy(F.col("text").alias("value")).agg(F.sum("n").alias("n")), every)
    meant = cut(mapped.select(F.col("value").alias("text"))).union(names.select("name"))
    return values.join(meant, "text", "left_anti").select("value", "n")


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
