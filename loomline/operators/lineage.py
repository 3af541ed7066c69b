"""Cutting the lineage of tables that are read several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(df_or_spark) -> str:
    """The checkpoint folder that the session names; a temporary one only in local mode, where none is set."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomline-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{_shared(spark)}/loomline-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there.

    Plans that refer to a table several times, step after step, grow with a power of
    the steps; a written table is one node, and survives the loss of executors.
    """
    _shared(df)
    return df.checkpoint()
