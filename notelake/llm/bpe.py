"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: a backtracking encoder. An Aho-Corasick automaton finds the tokens that occur in a piece; from each position
the longest is tried first, and a token may follow another only if the pair is compatible, that is if encoding the
two tokens' bytes gives just these two. A position from which no compatible token leads on is marked dead and never
entered again, so each position is left at most once: the time is linear in the piece. Since every prefix of a valid
sequence is the exact encoding of its bytes, the sequence that reaches the end is the exact result of the merges.
Decoding concatenates slices of one byte string by an offset table.

Defined results: null and empty text give an empty list; white space and control characters are encoded like any
other text; the strings of special tokens are ordinary text; a text of any length is encoded whole; repeated ids
give one row each; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from notelake.sources.tables import table

#: Place of the vocabulary, read on the driver only.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker; when full, the memory is emptied.
REMEMBERED = 300_000
NEVER = 1 << 62


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by id, from a file of lines ``base64 id``."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    tokens = [b""] * (1 + max(int(i) for _, i in pairs))
    for token, i in pairs:
        tokens[int(i)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Encodes and decodes with one vocabulary; merges go by id, lowest first."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN) -> None:
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.finder = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if t:
                self.finder.add_word(t.decode("latin-1"), i)
        self.finder.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.bytes = b"".join(tokens)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; none for a single byte."""
        if token not in self.halves:
            parts = [self.ids[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                rank, at = min((self.ids.get(self.tokens[a] + self.tokens[b], NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[at : at + 2] = [rank]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that lie at one side of ``token`` while it is built, each with the id of the merge that takes it."""
        out, taken = [], NEVER
        while True:
            out.append((token, taken))
            halves = self.split(token)
            if halves is None:
                return out
            taken, token = token, halves[side]

    def follows(self, a: int, b: int) -> bool:
        """Whether no merge crosses the seam of ``a`` and ``b``. Of equal merges the left one comes first."""
        found = self.compatible.get((a, b))
        if found is None:
            found = True
            for x, x_taken in self.edge(a, 1):
                for y, y_taken in self.edge(b, 0):
                    merge = self.ids.get(self.tokens[x] + self.tokens[y], NEVER)
                    if merge < x_taken and merge <= y_taken and merge != NEVER:
                        found = False
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            self.compatible[a, b] = found
        return found

    def backtrack(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        n = len(data)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.finder.iter(data.decode("latin-1")):
            starts[end + 1 - len(self.tokens[token])].append(token)
        # by end, so the longest comes last
        dead = bytearray(n + 1)
        path: list[int] = []
        at = 0
        while at < n:
            options = starts[at]
            step = -1
            while options:
                token = options.pop()
                end = at + len(self.tokens[token])
                if not dead[end] and (not path or self.follows(path[-1], token)):
                    step = token
                    break
            if step >= 0:
                path.append(step)
                at = end
            else:
                dead[at] = 1
                at -= len(self.tokens[path.pop()])
        return tuple(path)

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        out = (whole,) if whole is not None else self.backtrack(data)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(text) <= 64:
            self.known[text] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, extend = self.known.get, out.extend
            for p in self.pieces(text):
                extend(get(p) or self.piece(p))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        o = self.offsets
        return b"".join(self.bytes[o[i] : o[i + 1]] for i in ids).decode("utf-8", "surrogatepass")


_ENCODERS: dict[int, Encoder] = {}


def _worker(shared) -> Encoder:
    """The encoder of this Python worker, built once for a broadcast vocabulary."""
    if shared.value[0] not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.value[0]] = Encoder(*shared.value[1:])
    return _ENCODERS[shared.value[0]]


def _shared(spark: SparkSession, path: str, pattern: str):
    tokens = read_vocabulary(path)
    if len(tokens) > 1_000_000:
        raise ValueError("a vocabulary of over a million tokens is not broadcast")
    return spark.sparkContext.broadcast((hash((path, pattern, len(tokens))), tokens, pattern))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_col, ids`` for each row."""
    shared = _shared(docs.sparkSession, path, pattern)
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker(shared)
        for batch in batches:
            flat: list[int] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            parts: list[np.ndarray] = []
            done = 0
            for k, text in enumerate(batch.column(1)):
                flat += enc.encode(text.as_py())
                ends[k + 1] = done + len(flat)
                if len(flat) > 200_000:
                    parts.append(np.array(flat, dtype=np.int32))
                    done += len(flat)
                    flat = []
            parts.append(np.array(flat, dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` for each row; no ids leave the worker."""
    shared = _shared(docs.sparkSession, path, pattern)
    slim = docs.select(*keep, docs[text_col].alias("_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker(shared)
        for batch in batches:
            n = pa.array([len(enc.encode(t.as_py())) for t in batch.column(len(keep))], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[: len(keep)])
    return slim.mapInArrow(run, f"{schema}, n_tokens bigint")


def decode(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``id_col, text`` for each row; null ids give the empty text."""
    shared = _shared(ids.sparkSession, path, PATTERN)
    slim = ids.select(ids[id_col].alias("id"), ids[ids_col].alias("ids"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker(shared)
        for batch in batches:
            texts = pa.array([enc.decode(x.as_py() or ()) for x in batch.column(1)], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, text string")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of each document."""
    return encode(table(spark, folder, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"p6_ids": p6_ids}
