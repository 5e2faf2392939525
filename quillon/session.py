"""Session factory and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quillon", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir`` (shared by all executors, so a lost
    executor loses nothing). Only where that is unset and no folder was set before, as in local tests, is a
    folder of this machine used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set where it isn't yet (see ``durable``)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return context._jsc.sc().getCheckpointDir().get()


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Enough where executors see the same path (tests, a shared folder); elsewhere submit it with ``--py-files``.
    """
    here = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)
    return spark
