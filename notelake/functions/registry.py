"""The engine's functions as temporary SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from notelake.functions import chunks, notes


def register(spark: SparkSession) -> list[str]:
    """Registers ``chunk(body)``, a table function, and SQL-only ones of links, tokens, cosine, boost and rank fusion; their names."""

    class Chunk:
        def eval(self, body: str | None) -> Iterator[tuple[int, str]]:
            yield from enumerate(chunks.chunk(body or ""))

    spark.udtf.register("chunk", udtf(Chunk, returnType="chunk_ix int, chunk string"))
    pattern = notes.WIKILINK.replace("\\", "\\\\")
    made = {
        "wikilinks": f"(body string) returns array<string> return transform(regexp_extract_all(body, '{pattern}', 1), t -> regexp_replace(t, '(?U)^\\\\s+|\\\\s+$', ''))",
        "tokenize": "(text string) returns array<string> return transform(filter(regexp_extract_all(text, '[\\\\u0E00-\\\\u0E7F]+|[\\\\p{IsAlphabetic}\\\\p{N}&&[^\\\\u0E00-\\\\u0E7F]]+', 0), t -> octet_length(t) < 100), t -> lower(t))",
        "cosine": "(a array<double>, b array<double>) returns double return case when size(a) = size(b) and size(a) > 0 then coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), "
        "sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))), 0D) else 0D end",
        "degree_boost": f"(degree bigint) returns double return case when degree > 0 then 1 + {notes.BOOST} * least(1D, ln(1 + degree) / ln({1 + notes.FULL_AT})) else 1D end",
        "rrf": "(a int, b int) returns double return coalesce(1D / (60 + a), 0D) + coalesce(1D / (60 + b), 0D)",
    }
    for name, body in made.items():
        spark.sql(f"create or replace temporary function {name}{body}")
    return ["chunk", *made]
