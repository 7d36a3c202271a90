"""The folder that all executors share, for what is written between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new place in the folder that the session names; a temporary one only where it names none and runs in one process, as in tests."""
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = have.get() if have.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='fernweave-')).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder by all that follows."""
    place = shared_folder(df.sparkSession, "table")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
