"""Sessions for local work; on a cluster the caller brings its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str, cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session on this machine with the settings that the engine expects."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for written indexes, below the shared folder that ``spark.checkpoint.dir`` names;
    only a local session that names none gets one on this machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="index-")
    return f"{found.rstrip('/')}/index-{uuid.uuid4().hex}"
