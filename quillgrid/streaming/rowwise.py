"""Sheet functions on streams: row programs run as they are, aggregates over event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.cells import Cell


def with_cells(stream: DataFrame, program: dict[str, Cell]) -> DataFrame:
    """stream with a value and an error column for each named cell. Works alike on batch and streaming DataFrames."""
    for name, c in program.items():
        stream = stream.withColumn(name, c.value)
        stream = stream.withColumn(f"{name}_error", c.error if c.error is not None else F.lit(None).cast("string"))
    return stream


def windowed(stream: DataFrame, time: str, by: list[str], aggregates: dict, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Aggregates (name -> Column, as of quillgrid.operators.aggregates) by keys and tumbling windows; rows later than
    `late` are dropped and state is freed behind it."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("span"), *by)
    out = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("span.start").alias("start"), *by, *aggregates)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
