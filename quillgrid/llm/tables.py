"""Materialised intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of the Arrow batches that workers get: bounds a worker's memory whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df itself; the session then hands out Arrow batches of the above bounds (smaller ones set by the user stay)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        set_to = conf.get(key, None)
        if set_to is None or not str(set_to).isdigit() or int(set_to) > most or int(set_to) <= 0:
            conf.set(key, str(most))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is, a temporary one on a local master (as in tests) and an
    error elsewhere, as executors would not see the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage as a checkpoint does: a lost executor costs no recomputation of what lies before, and what
    follows plans with the true size of the table.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Paths of the tables that `stage` returned.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete tables that `stage` returned: only once everything that reads them is written itself."""
    for df in tables:
        held, path = _PATHS.pop(id(df), (lambda: None, ""))
        if held() is df:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def parallelism(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
