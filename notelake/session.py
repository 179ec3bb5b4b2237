"""Session helpers: the configuration this engine is written for, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes a side may have at most to be broadcast; beyond either the join is left to a shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "notelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; ``conf`` adds to or overrides the settings."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
        # what a query has cut off goes when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return ship(builder.config(map=base | conf).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Lets the session's Python workers on this machine import this package, wherever they were started. A cluster gets it as
    any other package: installed, or with ``--py-files``."""
    here = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where the session names none, as in local tests,
    a temporary one is made and set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix=f"notelake-{os.getpid()}-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and the like by their length, anything else by eight."""
    out = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            out = out + 8
    return out


def broadcast_bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when it is proven to have at most ``rows`` rows and ``size`` bytes, else unmarked."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).collect()[0]
    return F.broadcast(df) if seen["n"] <= rows and seen["b"] <= size else df
