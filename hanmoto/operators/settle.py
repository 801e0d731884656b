"""Written intermediate results: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the folder that ``spark.checkpoint.dir`` names, a temporary one only where it is unset."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hanmoto-shared-"))
    return df.checkpoint()
