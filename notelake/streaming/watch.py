"""Watching vaults: changes as a stream of micro-batches, each of which refreshes the derived tables once.

The stream polls listings (see ``sources.vault``); a trigger of 300 ms gathers a burst of changes into one batch. A
batch is processed after its listing is taken, and the diff starts from the stored state, so a batch that is repeated
after a failure changes nothing more."""

from __future__ import annotations

import queue
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake.functions.notes import in_dependency_dir
from notelake.sources.vault import stream_changes

#: How long a burst of changes is gathered, and how many events a slow reader may lag behind.
BURST = "300 milliseconds"
CHANNEL = 64


def relevant(changes: DataFrame) -> DataFrame:
    """Changes that can concern a note by name and place: Markdown, no hidden segment, no dependency folder."""
    hidden = F.exists(F.split("key", "/"), lambda p: F.startswith(p, F.lit(".")))
    return changes.where(F.endswith("key", F.lit(".md")) & ~hidden & ~in_dependency_dir("key"))


class Channel:
    """A bounded queue of events for one listener; when it is full the oldest are dropped."""

    def __init__(self, size: int = CHANNEL) -> None:
        self._queue: queue.Queue = queue.Queue(size)

    def send(self, event: dict) -> None:
        while True:
            try:
                return self._queue.put_nowait(event)
            except queue.Full:
                try:
                    self._queue.get_nowait()
                except queue.Empty:
                    continue

    def receive(self, timeout: float | None = None) -> dict | None:
        try:
            return self._queue.get(timeout=timeout)
        except queue.Empty:
            return None


def watch(
    spark: SparkSession,
    vaults: dict[str, str],
    refresh: Callable[[list[str]], dict[str, dict]],
    checkpoint: str,
    channels: tuple[Channel, ...] = (),
    trigger: str = BURST,
    once: bool = False,
) -> StreamingQuery:
    """Calls ``refresh`` with the touched vaults of each batch; it returns for each vault its report (``indexed``, ``removed``), which
    goes to the channels as an event if it is not all zero."""

    def batch(changes: DataFrame, _: int) -> None:
        # at most one row per registered vault reaches the driver
        touched = sorted(r["vault"] for r in changes.select("vault").distinct().collect())
        if not touched:
            return
        for vault, counts in refresh(touched).items():
            if any(counts.values()):
                for channel in channels:
                    channel.send({"vault": vault, **counts})

    writer = relevant(stream_changes(spark, vaults)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)
    return writer.start()


def feed_counts(updates: DataFrame, delay: str = "3 days", window: str = "1 day") -> DataFrame:
    """A feed of updates counted per vault and day as a stream: repeats of an update are dropped within the delay, rows later
    than it are ignored, and a day is given out once it can no longer change."""
    seen = updates.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["vault", "key", "hash", "mtime_ns"])
    return seen.groupBy(F.window("received_at", window).alias("w"), "vault").agg(F.count("*").alias("updates")).select("vault", F.col("w.start").alias("day"), "updates")


