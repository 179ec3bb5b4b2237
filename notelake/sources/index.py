"""A written text index of one collection: postings laid out by term, lengths and link degrees.

Postings are range-partitioned and sorted by (term, vault, key), so that a query's terms are a few row groups of a few
files (the filter on ``term`` reaches the Parquet scan) and even the commonest term of the largest vault is spread over
several tasks and files. The index is written beside its place and moved there as a whole, so a reader never sees half
of one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from notelake.operators import graph as G
from notelake.operators import search as S

PARTS = ("postings", "lengths", "degrees", "keys")


class TextIndex:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self) -> bool:
        return bool(self._fs.exists(self._path(self.root)))

    def build(self, notes: DataFrame, segment: object | None = None) -> TextIndex:
        """Writes the index of ``notes`` (``vault, key, title, body``) and puts it in the place of an older one."""
        aside = f"{self.root}-{uuid.uuid4().hex}"
        order = ["term", "vault", "key"]
        S.postings(notes, segment).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{aside}/postings")
        S.lengths(notes, segment).write.parquet(f"{aside}/lengths")
        G.degrees(notes, G.edges(notes)).write.parquet(f"{aside}/degrees")
        notes.select("vault", "key").write.parquet(f"{aside}/keys")
        if self.exists():
            self._fs.delete(self._path(self.root), True)
        self._fs.rename(self._path(aside), self._path(self.root))
        return self

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{part}")

    def search(self, text: str, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
        """``vault, key, score, rank`` as from the notes; only the postings of the terms are read."""
        return S.ranked(S.lexical(self.read("keys"), text, (self.read("postings"), self.read("lengths"))), self.read("degrees"), limit)
