"""Tokens of mixed Thai and other text.

Outside Thai a token is a maximal run of letters and numbers. A run of Thai characters is cut into words: by ``thai_words``
with the Thai dictionary that the Java platform brings (the engine's default), or by maximal matching against a word list
of the caller's (``segmenter``); without either a Thai run is one token. Tokens of 100 bytes or more are dropped, the
others lower-cased, in that order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

THAI = "฀-๿"
RUNS = f"[{THAI}]+|[^{THAI}]+"
WORDS = rf"[{THAI}]+|[\p{{IsAlphabetic}}\p{{N}}&&[^{THAI}]]+"
_ALNUM = r"[\p{IsAlphabetic}\p{N}]"
#: Bytes from which a token is dropped.
TOO_LONG = 100


def runs(text: Column | str) -> Column:
    """The maximal Thai and other runs of a text, which joined give it back."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(RUNS), F.lit(0))


def analyzed(tokens: Column) -> Column:
    """Without over-long tokens and those without a letter or number; lower case."""
    kept = F.filter(tokens, lambda t: (F.octet_length(t) < TOO_LONG) & F.regexp_like(t, F.lit(_ALNUM)))
    return F.transform(kept, F.lower)


def tokens(text: Column | str, segment: object | None = None) -> Column:
    """The tokens of a text in order; ``segment`` is a segmenter from ``segmenter``, for the Thai runs."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORDS), F.lit(0))
    return analyzed(segment(found) if segment else found)


def thai_words(found: Column) -> Column:
    """Tokens with the Thai ones cut into words by the platform's dictionary; without leaving the JVM. Texts without Thai are
    passed on as they are."""
    is_thai = lambda t: F.regexp_like(t, F.lit(f"^[{THAI}]"))
    words = F.flatten(F.transform(found, lambda t: F.when(is_thai(t), F.flatten(F.sentences(t, F.lit("th"), F.lit("TH")))).otherwise(F.array(t))))
    return F.when(F.exists(found, is_thai), words).otherwise(found)


def thai_terms(spark: SparkSession, runs_: list[str]) -> dict[str, list[str]]:
    """The words of a few Thai runs (a query's)."""
    if not runs_:
        return {}
    rows = spark.createDataFrame([(r,) for r in runs_], "r string")
    return {x["r"]: x["w"] for x in rows.select("r", thai_words(F.array("r")).alias("w")).collect()}


class Trie:
    """Words for maximal matching: the fewest words, then the longest first; what no word covers stays together."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = {w for w in words if w}
        self.longest = max(map(len, self.words), default=0)

    def cut(self, run: str) -> list[str]:
        n = len(run)
        # cost: uncovered characters, then words; from the end, so that longer words come first among equals
        best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)
        for i in range(n - 1, -1, -1):
            unknown, count, _ = best[i + 1]
            choice = (unknown + 1, count, 0)
            for size in range(1, min(self.longest, n - i) + 1):
                if run[i : i + size] in self.words:
                    u, c, _ = best[i + size]
                    if (u, c + 1) <= choice[:2]:
                        choice = (u, c + 1, size)
            best[i] = choice
        out: list[str] = []
        i, open_ = 0, False
        while i < n:
            size = best[i][2]
            if size:
                out.append(run[i : i + size])
            elif open_:
                out[-1] += run[i]
            else:
                out.append(run[i])
            open_ = not size
            i += max(1, size)
        return out


def segmenter(words: Iterable[str]):
    """A function of a column of tokens that cuts the Thai ones with the word list; the trie is built once per worker."""
    listed = sorted(set(words))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(listed)
        for batch in batches:
            yield batch.map(lambda ts: None if ts is None else [w for t in ts for w in (trie.cut(t) if "฀" <= t[0] <= "๿" else (t,))])

    return cut
