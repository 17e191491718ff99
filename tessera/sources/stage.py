"""Tables written once between steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what several steps read is computed once.

    The files go with the table's last reference, if the session has ``spark.cleaner.referenceTracking.cleanCheckpoints`` on.
    """
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared(spark)}/scratch-{uuid.uuid4().hex}"


def shared(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where none is set in a local session, as in tests, is a temporary folder chosen."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def quantile(df: DataFrame, share: float, by: str = "ordinal"):
    """The value of ``by`` that ``share`` of the rows do not exceed, exactly and in SQL's arithmetic (``quantile_disc``); None without rows."""
    own = df.select(by).where(F.col(by).isNotNull())
    n = own.count()
    if not n:
        return None
    place = max(1, n - math.floor(n - n * share)) - 1
    return numbered(own, by).where(F.col("row") == place).first()[by]


def numbered(df: DataFrame, by: str = "ordinal") -> DataFrame:
    """``row`` from 0 in the order of ``by``: rows are sorted into ranges, and a range begins where those before it end."""
    inside = F.monotonically_increasing_id()
    ordered = staged(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_row", inside))
    part, place = F.shiftright("_row", 33).cast("int"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    # a row for each partition
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _begin long"))
    return ordered.withColumn("_part", part).join(begin, "_part").withColumn("row", F.col("_begin") + place).drop("_part", "_begin", "_row")
