"""Tables in and out: Parquet, CSV, JSON, and the cell-per-line CSV of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.reshape import display
from quillgrid.operators.textform import reference


def read_table(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of parquet, csv (with a header) or json; give csv and json a schema to spare the scan that infers one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return {"parquet": reader.parquet, "json": reader.json, "csv": lambda p: reader.option("header", True).csv(p)}[form](path)


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[form](path)


def cell_lines(cells: DataFrame) -> DataFrame:
    """(line): `A1,value` for each cell, in row-major order and without quotes."""
    ordered = cells.orderBy("sheet", "row", "col")
    return ordered.select(F.concat(reference(F.col("row"), F.col("col")), F.lit(","), F.coalesce(display(), F.lit(""))).alias("line"))


def cell_json(cells: DataFrame) -> DataFrame:
    """(line): one JSON object for each cell with ref, kind and value."""
    return cells.select("sheet", "row", "col", F.to_json(F.struct(reference(F.col("row"), F.col("col")).alias("ref"), "kind", display().alias("value"))).alias("line"))
