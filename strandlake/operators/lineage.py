"""Cutting lineage for iterative operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder that spark.checkpoint.dir names; a temporary one only in local mode, where it is unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)
