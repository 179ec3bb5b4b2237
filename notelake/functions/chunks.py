"""Passages for embedding: a plain rule that cuts at the last paragraph or line end within reach."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import WHITE_SPACE, trimmed

# Characters of a chunk at most, and the chunks after which `chunk` stops unless told otherwise.
CHUNK_CHARS, MAX_CHUNKS = 900, 200


def chunk(text: str, most: int | None = MAX_CHUNKS) -> list[str]:
    """Chunks of at most CHUNK_CHARS characters, at most ``most`` (None: the whole text): each ends at the last blank line, else the last line
    end, in the second half of its reach, else at its full length; blank chunks are left out."""
    body, out, start = text.strip(WHITE_SPACE), [], 0
    while start < len(body) and (most is None or len(out) < most):
        reach = start + CHUNK_CHARS
        end = min(reach, len(body))
        if reach < len(body):
            half = start + CHUNK_CHARS // 2
            blank = body.rfind("\n\n", half - 1, reach)
            line = body.rfind("\n", half, reach)
            end = blank + 1 if blank >= 0 else line if line >= 0 else end
        if piece := body[start:end].strip(WHITE_SPACE):
            out.append(piece)
        start = end
    return out


def chunks(notes: DataFrame, most: int | None = None) -> DataFrame:
    """``vault, key, title, hash, chunk_ix, chunk`` of the notes' bodies, whole unless ``most`` chunks of each are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(row, ix, c) for row, body in enumerate(batch.column(4).to_pylist()) for ix, c in enumerate(chunk(body or "", most))]
            rows = pa.array([r for r, _, _ in made], type=pa.int32())
            own = [pa.array([i for _, i, _ in made], type=pa.int32()), pa.array([c for *_, c in made], type=pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(4)), *own], names=["vault", "key", "title", "hash", "chunk_ix", "chunk"])

    return notes.select("vault", "key", "title", "hash", "body").mapInArrow(run, "vault string, key string, title string, hash string, chunk_ix int, chunk string")


def passages(notes: DataFrame) -> DataFrame:
    """``vault, key, hash, chunk_ix, passage``: chunks as they are embedded, the title before the first; a note without text
    has its title."""
    cut = chunks(notes)
    text = F.when(F.col("chunk_ix") == 0, F.concat_ws("\n\n", "title", "chunk")).otherwise(F.col("chunk"))
    bare = notes.where(F.length(trimmed("body")) == 0).select("vault", "key", "hash", F.lit(0).alias("chunk_ix"), F.col("title").alias("text"))
    both = cut.select("vault", "key", "hash", "chunk_ix", text.alias("text")).unionByName(bare)
    return both.select("vault", "key", "hash", "chunk_ix", F.concat(F.lit("passage: "), "text").alias("passage"))


def query_text(text: str) -> str:
    return f"query: {text}"
