"""Intermediate tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that fill a file, where it is known how many there are.
FILE_ROWS = 50_000
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lorespark-")
    return _own_dirs[app]


def delete_tree(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete_tree(spark, path)
    except Exception:  # the session may be gone by then
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted at the end of the driver if not before."""
    path = f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back.

    rows: how many it has at most. A small table is then written by as few tasks as fill the cores, or a file each.
    """
    spark = df.sparkSession
    if rows is not None:
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
        if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorespark_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_lorespark_path", None):
            delete_tree(t.sparkSession, t._lorespark_path)
            t._lorespark_path = None
