"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a session of one process gets a folder of our own,
    and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    return f"{(folder or shared_folder(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """``df`` as Parquet at ``path``, read back: no lineage but its files. Unless they are to ``keep``,
    they go when the driver's Python ends."""
    df.write.parquet(path)
    if not keep:
        atexit.register(_delete, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter
        return
