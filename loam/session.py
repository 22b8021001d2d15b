"""Session defaults, and making the package importable for Python workers."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Defaults for a session of one's own; partition counts follow the cluster and the input, AQE merges small ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("loam").config(map=DEFAULTS | conf)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ready(b.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Python workers started from now on find this package where the driver found it."""
    at = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if at not in paths:
        env["PYTHONPATH"] = os.pathsep.join([at, *filter(None, paths)])
    return spark


#: Rows and bytes of an Arrow batch: texts have no length limit, and a Python worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Batches of whole texts to Python workers stay small, however large a partition is; smaller ones that are set already stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session that runs in this process alone gets a temporary one; any other must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = getattr(spark.sparkContext, "_loam_shared", None)
        if not at and not re.fullmatch(r"local(\[[0-9*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark.sparkContext._loam_shared = at or tempfile.mkdtemp(prefix="loam-")
    return at
