"""Splitting oversized items at natural boundaries.

Method: dynamic programming over boundary positions. Candidate ends of a piece are blank lines, line ends and
sentence ends; where two of these lie further apart than a third of the usable length, ends of words are added, and
where words are too long, plain positions. Each candidate end has one start of the next piece, the natural boundary
(else the word, else the character) that shares the most characters with the piece before, up to the overlap. The
chosen ends minimise the sum of the cut penalties and of the squared deviations from an even size, under the maximum
length. The work is linear in the text: a candidate looks back over one piece's length only.

Defined results: lengths count code points after trimming Unicode white space; a null, empty or blank text gives no
piece and a text within the limit gives one; pieces are exact slices of the trimmed text, so that dropping each
piece's shared prefix and joining gives it back; a CR LF pair and a base character with its marks are not cut apart
unless a single such cluster is longer than the limit allows; repeated rows are split each; of further columns only
those asked for are kept.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import WHITE_SPACE, trimmed
from notelake.sources.tables import table

MAX_CHARS = 900
OVERLAP = 90
# Penalties of a cut, against a deviation of a whole piece from the even size at 1.
BLANK_LINE, LINE_END, SENTENCE_END, WORD_END, ANYWHERE = 0.0, 0.02, 0.05, 0.4, 1.5

_BREAKS = regex.compile(r"((?:\r?\n[ \t]*){2,})|(\r?\n)|(?<=[.!?…。])[\"'”»)\]]*[ \t]+")
_WORDS = regex.compile(r"\s+")


def _natural(text: str) -> list[tuple[int, float]]:
    return [(m.end(), BLANK_LINE if m.group(1) else LINE_END if m.group(2) else SENTENCE_END) for m in _BREAKS.finditer(text)]


def _plain(text: str, at: int, lowest: int) -> int:
    """A position at or before ``at`` that parts no cluster, if one lies above ``lowest``."""
    best = at
    while best > lowest and (unicodedata.category(text[best])[0] == "M" or text[best - 1 : best + 1] == "\r\n"):
        best -= 1
    return best if best > lowest else at


def _fill(text: str, natural: list[tuple[int, float]], gap: int) -> list[tuple[int, float]]:
    """``natural`` and the end of the text, with word ends and plain positions wherever two are over ``gap`` apart."""
    step = max(1, gap // 8)
    out: list[tuple[int, float]] = []
    last = 0
    for at, cost in [*natural, (len(text), 0.0)]:
        if at - last > gap:
            taken = last
            words = [m.end() for m in _WORDS.finditer(text, last, at) if m.end() < at]
            for word in [*words, at]:
                while word - taken > gap:
                    taken = _plain(text, taken + gap, taken)
                    out.append((taken, ANYWHERE))
                if word < at and word - taken >= step:
                    out.append((word, WORD_END))
                    taken = word
        if at > last:
            out.append((at, cost))
        last = max(last, at)
    return out


def _starts(text: str, ends: list[tuple[int, float]], overlap: int) -> list[int]:
    """Where the piece after each end begins: at the first natural boundary within the overlap, else the first word, else the
    first character; at the end itself where nothing can be shared."""
    at = [e for e, _ in ends]
    out = []
    for k, e in enumerate(at):
        low = e - overlap
        j = bisect_left(at, low, 0, k)
        while j < k and ends[j][1] > SENTENCE_END:
            j += 1
        if low <= 0 or not overlap:
            out.append(e)
        elif j < k:
            out.append(at[j])
        else:
            word = _WORDS.search(text, low, e)
            out.append(word.end() if word and word.end() < e else _plain(text, low, low - 1) if e - low > 1 else e)
    return out


def cut(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a trimmed text."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be shorter than a piece")
    n = len(text)
    if n <= max_chars:
        return [(0, n)] if n else []
    ends = _fill(text, _natural(text), max(1, (max_chars - overlap) // 3))
    at = [e for e, _ in ends]
    starts = _starts(text, ends, overlap)
    pieces = -(-(n - overlap) // (max_chars - overlap))
    even = (n + (pieces - 1) * overlap) / pieces
    cost = [0.0] * len(at)
    back = [-1] * len(at)
    first = 0
    for k, (e, penalty) in enumerate(ends):
        best = ((e - even) / max_chars) ** 2 if e <= max_chars else float("inf")
        best_from = -1
        while e - starts[first] > max_chars and first < k:
            first += 1
        for j in range(first, k):
            size = e - starts[j]
            if size > max_chars or e - at[j] < 1:
                continue
            c = cost[j] + ((size - even) / max_chars) ** 2
            if c < best:
                best, best_from = c, j
        cost[k] = best + penalty
        back[k] = best_from
    chosen = []
    k = len(at) - 1
    while k >= 0:
        j = back[k]
        chosen.append((starts[j] if j >= 0 else 0, at[k]))
        k = j
    return chosen[::-1]


def split(items: DataFrame, keep: list[str], text_col: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, oversized_only: bool = False, with_text: bool = True) -> DataFrame:
    """The columns ``keep``, ``chunk_ix, start, end`` and, ``with_text``, ``piece`` for each piece of each item."""
    text = trimmed(items[text_col])
    slim = items.select(*keep, text.alias("_text_")).where(F.length("_text_") > (max_chars if oversized_only else 0))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[: len(keep)])
    schema = f"{fields}, chunk_ix int, start int, end int" + (", piece string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ix, starts, ends, pieces, held = [], [], [], [], [], 0

            def made() -> pa.RecordBatch:
                kept = [batch.column(k).take(pa.array(rows, type=pa.int32())) for k in range(len(keep))]
                own = [pa.array(x, type=pa.int32()) for x in (ix, starts, ends)]
                return pa.RecordBatch.from_arrays([*kept, *own, *([pa.array(pieces, type=pa.string())] if with_text else [])], names=[*keep, "chunk_ix", "start", "end", *["piece"] * with_text])

            for row, value in enumerate(batch.column(len(keep))):
                body = value.as_py()
                for k, (a, b) in enumerate(cut(body, max_chars, overlap)):
                    rows.append(row)
                    ix.append(k)
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        pieces.append(body[a:b])
                        held += b - a
                if held > 4_000_000:
                    yield made()
                    rows, ix, starts, ends, pieces, held = [], [], [], [], [], 0
            yield made()

    return slim.mapInArrow(run, schema)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notes whose trimmed body is too long for one piece."""
    pieces = split(table(spark, folder, "notes"), ["vault", "key"], "body", oversized_only=True, with_text=False)
    return pieces.where("chunk_ix = 0 and end > 0").select("vault", "key")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every note's body."""
    return split(table(spark, folder, "notes"), ["vault", "key"], "body")


_WS = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)
SQL = {"p4_found": f'select vault, "key" from notes where length(trim(body, {_WS})) > 900'}
QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
