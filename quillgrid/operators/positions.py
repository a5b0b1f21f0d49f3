"""Row numbers over whole tables without a sort in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a local master gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def kept(df: DataFrame, name: str = "rows") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with statistics, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/quillgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the row number (from 1) by `order`: the place within a sorted partition plus the rows of earlier ones."""
    rows = kept(df.orderBy(*order).withColumn("number at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("number at", 33), F.col("number at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("number part")).agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("number part", F.coalesce(F.sum("n").over(Window.orderBy("number part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("number base"))
    joined = rows.join(F.broadcast(before), part == F.col("number part"))
    return joined.select(*df.columns, (F.col("number base") + inside + 1).alias(name))
