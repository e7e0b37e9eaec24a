"""Sessions with the settings that the operators expect, and loading of tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "memloom", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; cluster sizes are the caller's."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    return builder.config(map=defaults | conf).getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Sees to a folder for checkpoints: the one that ``spark.checkpoint.dir`` names, or on a local master a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir_must_name_a_shared_folder")
            given = tempfile.mkdtemp(prefix="memloom-")
        spark.sparkContext.setCheckpointDir(given)
