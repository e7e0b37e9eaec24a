"""What the operators of this subpackage share: durable intermediate tables and small helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder and a cluster an error: its executors
    could not read a machine-local one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir_must_name_a_shared_folder")
        _OWN[app] = tempfile.mkdtemp(prefix="memloom-")
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by now
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage ends here, and a lost
    executor costs nothing that came before.  The files go with ``free``, or when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memloom_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes the files of ``saved`` tables that nothing will read any more."""
    for t in tables:
        _remove(t.sparkSession, t._memloom_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now, not when the driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()
