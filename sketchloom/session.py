"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Ranks up to this many rows of a group are cut before the shuffle; the largest sketch budget is 1024.
GROUP_LIMIT = 4096


def tuned(spark: SparkSession) -> SparkSession:
    """Let top-k ranks be cut on the map side for all sketch sizes; everything else stays as it is."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(key, "1000")) < GROUP_LIMIT:
        spark.conf.set(key, str(GROUP_LIMIT))
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset, below a temporary folder if all of Spark runs in one process; else an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sketchloom-")
    return f"{root.rstrip('/')}/sketchloom/{label}-{uuid.uuid4().hex}"


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sketchloom")
    settings = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tuned(builder.getOrCreate())
