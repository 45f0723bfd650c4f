"""Where intermediate results go."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or if that is unset (as in tests) a temporary folder; the context's checkpoint folder is set to it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_textloom_dir", None)
    if at is None:
        at = sc._textloom_dir = "file://" + tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
