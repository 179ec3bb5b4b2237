"""Full-text, vector and hybrid search.

The index is two tables: postings ``vault, key, field, term, tf, positions`` and lengths ``vault, key, field, len``; each
vault has its own statistics. A query reads only the postings of its terms, so with postings laid out by term a search
touches a sliver of the index; what is gathered per note is bounded by the query's terms. Ranks are cut on scores
rounded to six decimals, ties by key, before any body is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.notes import cosine, degree_boost, usable_vector
from notelake.functions.snippets import DEFAULT_CHARS, opening, snippet
from notelake.functions.tokens import thai_terms, thai_words, tokens
from notelake.session import at_most, broadcast_bounded, cut

# Constants of the BM25 formula, of the rank fusion, limits of a query and of the pool that is re-ranked.
K1, B = 1.2, 0.75
RRF_K = 60
DEFAULT_LIMIT, MAX_LIMIT, POOL_FACTOR = 20, 100, 3
FIELDS = ("title", "body")


def clamp(limit: int = DEFAULT_LIMIT) -> int:
    return max(1, min(MAX_LIMIT, limit))


# ---- index ----


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vault, key, field, term, tf, positions`` of ``vault, key, field, tokens``: the tokens of a field sorted by term, by whole
    batches."""
    for batch in batches:
        lists = batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        codes = lists.flatten().dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        pos = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, dtype=np.int64)
        ends = np.append(first, len(row)).astype(np.int32)
        own = [codes.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends), type=pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order]))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[first])) for k in range(3)), *own], names=["vault", "key", "field", "term", "tf", "positions"])


def postings(notes: DataFrame, segment: object | None = None) -> DataFrame:
    """``vault, key, field, term, tf, positions`` of titles and bodies. A note's tokens lie in its row, so nothing is shuffled."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(f, segment).alias("tokens")) for f in FIELDS])
    each = notes.select("vault", "key", F.explode(fields).alias("f")).select("vault", "key", F.col("f.field").alias("field"), F.col("f.tokens").alias("tokens"))
    return each.mapInArrow(_gathered, "vault string, key string, field string, term string, tf int, positions array<int>")


def lengths(notes: DataFrame, segment: object | None = None) -> DataFrame:
    """``vault, key, field, len``, with a row for empty fields too."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(f, segment)).alias("len")) for f in FIELDS])
    return notes.select("vault", "key", F.explode(fields).alias("f")).select("vault", "key", "f.field", "f.len")


def matches(notes: DataFrame, terms: list[str], segment: object | None = None) -> DataFrame:
    """``vault, key, field, len, hit, m`` of all notes, ``m`` mapping those of ``terms`` that occur to their positions: what a search
    needs, straight from the notes, without a written index."""
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(f, segment).alias("tokens")) for f in FIELDS])
    each = notes.select("vault", "key", F.explode(fields).alias("f")).select("vault", "key", "f.field", "f.tokens")
    # most notes have none of the terms and skip the rest
    hit = F.coalesce(F.arrays_overlap("tokens", wanted), F.lit(False))
    placed = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda x: F.array_contains(wanted, x["term"]))
    none = F.create_map().cast("map<string,array<int>>")
    per_term = F.transform(wanted, lambda t: F.struct(t.alias("term"), F.transform(F.filter(placed, lambda x: x["term"] == t), lambda x: x["pos"]).alias("positions")))
    found = F.when(hit, F.map_from_entries(F.filter(per_term, lambda s: F.size(s["positions"]) > 0))).otherwise(none)
    return each.select("vault", "key", "field", F.size("tokens").alias("len"), hit.alias("hit"), found.alias("m"))


def matches_in_index(postings_: DataFrame, lengths_: DataFrame, terms: list[str]) -> DataFrame:
    """The same from a written index, of which only the postings of the terms are read."""
    found = postings_.where(F.col("term").isin(*terms)) if terms else postings_.limit(0)
    per = found.groupBy("vault", "key", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    none = F.create_map().cast("map<string,array<int>>")
    return lengths_.join(per, ["vault", "key", "field"], "left").select("vault", "key", "field", "len", F.col("m").isNotNull().alias("hit"), F.coalesce("m", none).alias("m"))


# ---- query language ----


class QueryError(ValueError):
    """The query cannot be read."""


@dataclass
class Node:
    """A part of a query: ``leaf`` (fields and terms, several in a row being a phrase), ``and``, ``or`` or ``not``."""

    kind: str
    fields: tuple[str, ...] = FIELDS
    terms: tuple[str, ...] = ()
    parts: list[Node] = field(default_factory=list)

    def leaves(self, negated: bool = False) -> list[tuple[Node, bool]]:
        if self.kind == "leaf":
            return [(self, negated)]
        return [x for p in self.parts for x in p.leaves(negated or self.kind == "not")]


_QUERY_TOKEN = re.compile(r'\s*(?:(?P<paren>[()])|(?P<sign>[+\-])(?=\S)|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+)))')
_TERM = re.compile(r"[฀-๿]+|[^\W_฀-๿]+")


def plain_terms(text: str) -> tuple[str, ...]:
    """Terms of a piece of a query, by the rule of the index (Thai runs whole)."""
    return tuple(t.lower() for t in _TERM.findall(text) if len(t.encode()) < 100)


def parse_query(text: str, terms_of=plain_terms) -> Node:
    """Words are alternatives; ``"…"`` is a phrase, and so is a word of several terms; ``+`` requires, ``-`` and ``NOT`` forbid,
    ``AND`` binds closer than ``OR``; ``title:``, ``body:`` and ``path:`` name a field; parentheses group."""
    items: list[tuple[str, object]] = []
    pos = 0
    text = text.rstrip()
    while pos < len(text):
        m = _QUERY_TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise QueryError(f"cannot read the query at {pos}: {text[pos:]!r}")
        pos = m.end()
        if m["paren"]:
            items.append((m["paren"], None))
        elif m["sign"]:
            items.append((m["sign"], None))
        elif m["word"] in ("AND", "OR", "NOT") and not m["field"]:
            items.append((m["word"], None))
        else:
            if m["field"] and m["field"] not in (*FIELDS, "path"):
                raise QueryError(f"no such field: {m['field']}")
            raw = m["phrase"] if m["phrase"] is not None else m["word"]
            fields = (m["field"],) if m["field"] else FIELDS
            items.append(("leaf", Node("leaf", fields, (raw,) if fields == ("path",) else terms_of(raw))))
    at = 0

    def peek() -> str | None:
        return items[at][0] if at < len(items) else None

    def unit() -> tuple[str, Node]:
        nonlocal at
        sign = ""
        while peek() in ("+", "-", "NOT"):
            sign = "-" if peek() in ("-", "NOT") else "+"
            at += 1
        if peek() == "(":
            at += 1
            node = either()
            if peek() != ")":
                raise QueryError("a parenthesis is not closed")
            at += 1
        elif peek() == "leaf":
            node = items[at][1]
            at += 1
        else:
            raise QueryError("a word is missing")
        return sign, node

    def both() -> tuple[str, Node]:
        nonlocal at
        sign, node = unit()
        group = [(sign, node)]
        while peek() == "AND":
            at += 1
            group.append(unit())
        return group[0] if len(group) == 1 else ("", Node("and", parts=[Node("not", parts=[n]) if s == "-" else n for s, n in group]))

    def either() -> Node:
        nonlocal at
        clauses = []
        while peek() not in (None, ")"):
            if peek() == "OR":
                if not clauses:
                    raise QueryError("a word is missing before OR")
                at += 1
                if peek() in (None, ")"):
                    raise QueryError("a word is missing after OR")
            clauses.append(both())
        must = [n for s, n in clauses if s == "+"]
        never = [Node("not", parts=[n]) for s, n in clauses if s == "-"]
        may = [n for s, n in clauses if not s]
        if must or never:
            needed = must + ([Node("or", parts=may)] if may and not must else []) + never
            # what may be there scores without being needed
            return Node("and", parts=needed + ([Node("may", parts=may)] if may and must else []))
        return Node("or", parts=may)

    tree = either()
    if at < len(items):
        raise QueryError("a parenthesis was never opened")
    return tree


# ---- scoring ----


def _at(m: Column, term: str) -> Column:
    return F.coalesce(F.element_at(m, F.lit(term)), F.array().cast("array<int>"))


def _leaf_tf(m: Column, terms: tuple[str, ...]) -> Column:
    """Occurrences of a term or phrase, from a map of terms to positions."""
    if not terms:
        return F.lit(0)
    starts = _at(m, terms[0])
    for k, t in enumerate(terms[1:], 1):
        back = F.lit(k)
        starts = F.array_intersect(starts, F.transform(_at(m, t), lambda p: p - back))  # noqa: B023
    return F.size(starts)


def few_vaults(table: DataFrame, most: int = 2_000) -> bool:
    """Whether a table has so few vaults that a bounded number of rows for each may be broadcast; reads one column."""
    return at_most(table.select("vault").distinct(), most)


def bm25(fields: DataFrame, query: Node, few: bool = False) -> DataFrame:
    """``vault, key, score`` of the notes that match, from ``matches``, which are gone through twice: once for the
    statistics of each vault (a row per vault and field, broadcast where vaults are ``few``), once for the scores."""
    leaves = query.leaves()
    terms = sorted({t for leaf, _ in leaves if leaf.fields != ("path",) for t in leaf.terms})
    paths = [leaf.terms[0] for leaf, _ in leaves if leaf.fields == ("path",)]
    number = {t: k for k, t in enumerate(terms)}
    has = [F.count_if(F.element_at("m", F.lit(t)).isNotNull()).alias(f"df{k}") for t, k in number.items()]
    stats = fields.groupBy("vault", "field").agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *has)
    named = (F.col("field") == "body") & F.col("key").isin(*paths) if paths else F.lit(False)
    per = fields.where(F.col("hit") | named).join(F.broadcast(stats) if few else stats, ["vault", "field"])
    tf_cols, score = [], F.lit(0.0)
    for k, (leaf, negated) in enumerate(leaves):
        if leaf.fields == ("path",):
            tf = F.when((F.col("field") == "body") & (F.col("key") == leaf.terms[0]), 1).otherwise(0)
            part = tf.cast("double")
        else:
            tf = F.when(F.col("field").isin(*leaf.fields), _leaf_tf(F.col("m"), leaf.terms)).otherwise(0)
            idf = F.lit(0.0)
            for t in leaf.terms:
                df = F.col(f"df{number[t]}").cast("double")
                idf = idf + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            t = tf.cast("double")
            part = F.when(tf > 0, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
        tf_cols.append(tf.alias(f"tf{k}"))
        if not negated:
            score = score + part
    rows = per.select("vault", "key", score.alias("score"), *tf_cols)
    total = rows.groupBy("vault", "key").agg(F.sum("score").alias("score"), *[F.sum(f"tf{k}").alias(f"tf{k}") for k in range(len(leaves))])
    order = iter(range(len(leaves)))

    def holds(node: Node) -> Column:
        if node.kind == "leaf":
            return F.col(f"tf{next(order)}") > 0
        parts = [holds(p) for p in node.parts]
        if node.kind == "not":
            return ~parts[0]
        if node.kind == "may" or not parts:
            return F.lit(node.kind == "may")
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.kind == "and" else out | p
        return out

    # a note must have something of what is asked, not merely lack what is forbidden
    asked = F.lit(False)
    for k, (_, negated) in enumerate(leaves):
        if not negated:
            asked = asked | (F.col(f"tf{k}") > 0)
    return total.where(holds(query) & asked).select("vault", "key", "score")


def best(scored: DataFrame, limit: int, score: str = "score", by: str | None = "vault") -> DataFrame:
    """The ``limit`` best rows (of each vault) by rounded score, ties by key, with ``rank`` from 1."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc(score), "key")
    return scored.withColumn(score, F.round(score, 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def read_query(spark: SparkSession, text: str, segment: object | None = None) -> Node:
    """The query with its Thai runs cut as the index has them, where ``segment`` is ``thai_words``."""
    if segment is not thai_words:
        return parse_query(text)
    words = thai_terms(spark, sorted({t for t in _TERM.findall(text) if "฀" <= t[0] <= "๿"}))
    return parse_query(text, lambda raw: tuple(w.lower() for t in _TERM.findall(raw) for w in words.get(t, [t]) if len(w.encode()) < 100))


def lexical(notes: DataFrame, text: str, index: tuple[DataFrame, DataFrame] | None = None, segment: object | None = None) -> DataFrame:
    """``vault, key, score`` for a query text, from a written index (with tokens of the same ``segment``) or straight from the
    notes."""
    query = read_query(notes.sparkSession, text, segment)
    terms = sorted({t for leaf, _ in query.leaves() if leaf.fields != ("path",) for t in leaf.terms})
    few = few_vaults(index[1] if index else notes)
    # what is found is small and read twice, so the bodies are gone through once
    return bm25(matches_in_index(*index, terms) if index else cut(matches(notes, terms, segment)), query, few)


def ranked(scored: DataFrame, degrees: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``vault, key, score, rank``: a pool of the best by words, re-ranked with the boost for links, cut to ``limit``. The pool
    is cut before the boost."""
    wanted = clamp(limit)
    pool = best(scored, min(POOL_FACTOR * wanted, MAX_LIMIT)).drop("rank")
    boosted = pool.join(degrees, ["vault", "key"], "left").withColumn("score", F.col("score") * degree_boost("degree")).select("vault", "key", "score")
    return best(boosted, wanted)


def semantic(vectors: DataFrame, query: DataFrame, limit: int, dim: int | None = None) -> DataFrame:
    """``vault, key, score, rank``: notes by the greatest cosine of their chunks with the one query vector (column ``q``). Vectors
    of another dimension than ``dim``, by default the query's, are not compared."""
    one = F.broadcast(query.select("q").limit(1))
    near = vectors.join(one, usable_vector("embedding", F.size("q") if dim is None else dim))
    scored = near.groupBy("vault", "key").agg(F.max(cosine("embedding", "q")).alias("score"))
    return best(scored, limit)


def fuse(lexical_: DataFrame, semantic_: DataFrame | None, notes: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``vault, key, score, rank`` by reciprocal rank fusion over the union of both lists, per vault. A vault without semantic
    ranks keeps its lexical order on the same scale. Semantic keys that are no notes now are left out."""
    one = F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))
    words = lexical_.select("vault", "key", one.alias("a"))
    if semantic_ is None:
        both = words.withColumn("b", F.lit(0.0))
    else:
        known = semantic_.join(notes.select("vault", "key"), ["vault", "key"], "left_semi")
        both = words.join(known.select("vault", "key", one.alias("b")), ["vault", "key"], "full_outer")
    w = Window.partitionBy("vault").orderBy(F.desc("score"), "key")
    fused = both.select("vault", "key", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))
    return fused.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= clamp(limit))


def total(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits of all vaults together: by score, ties in the order of vaults and ranks."""
    return hits.orderBy(F.desc("score"), "vault", "rank").limit(limit)


def with_snippets(hits: DataFrame, notes: DataFrame, text: str, chars: int = DEFAULT_CHARS, segment: object | None = None) -> DataFrame:
    """The hits with ``title`` and ``snippet``: bodies are read for these only. Hits are at most MAX_LIMIT a vault."""
    query = read_query(notes.sparkSession, text, segment)
    terms = sorted({t for leaf, negated in query.leaves() if not negated and "body" in leaf.fields for t in leaf.terms})
    bodies = notes.select("vault", "key", "title", "body").join(F.broadcast(hits) if few_vaults(notes) else hits, ["vault", "key"])
    made = snippet(terms, chars)("body") if terms else opening("body", chars)
    return bodies.withColumn("snippet", made).drop("body")


def hits_for_keys(notes: DataFrame, keys: DataFrame, chars: int = DEFAULT_CHARS) -> DataFrame:
    """``vault, key, title, snippet, score`` of the given ``vault, key``, absent ones left out: score 0, the body's opening. Where
    the keys have a ``rank``, the hits have it too, and are in its order."""
    ordered = "rank" in keys.columns
    asked = keys.select("vault", "key", *["rank"] * ordered).distinct()
    found = notes.join(broadcast_bounded(asked), ["vault", "key"]).select("vault", "key", "title", opening("body", chars).alias("snippet"), F.lit(0.0).alias("score"), *["rank"] * ordered)
    return found.orderBy("rank", "vault", "key") if ordered else found


def search(
    notes: DataFrame, degrees: DataFrame, text: str, limit: int = DEFAULT_LIMIT, vectors: DataFrame | None = None, query_vector: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None,
    segment: object | None = None,
) -> DataFrame:
    """The one entry of all searches: ``vault, key, score, rank`` per vault, lexical with boost, fused with meaning where there
    are vectors and a query vector."""
    words = ranked(lexical(notes, text, index, segment), degrees, limit)
    meaning = semantic(vectors, query_vector, POOL_FACTOR * clamp(limit)) if vectors is not None and query_vector is not None else None
    return fuse(words, meaning, notes, limit)


def empty_hits(spark: SparkSession) -> DataFrame:
    """What a search of nothing gives."""
    return spark.createDataFrame([], "vault string, key string, score double, rank int")
