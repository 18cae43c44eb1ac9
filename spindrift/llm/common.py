"""Helpers shared by the corpus operators: table access, lineage cuts, fresh names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Paths that cuts of this driver have written and nothing has deleted yet.
_kept: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables; always through Spark's reader, as the store may be remote."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that names none
    (a test, a laptop) gets a folder of its own; anything else is a configuration error,
    because executors would not see a driver-local folder.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """``df`` computed once and kept as compressed Parquet in the shared checkpoint folder.

    It survives lost executors, and the optimizer sees the size of its files: a checkpointed
    frame inherits the estimate of the plan behind it, which for joins is a product that grows
    from cut to cut.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    _kept.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes what :func:`cut` has kept, once nothing will read it any more."""
    for df in frames:
        _delete(df.sparkSession, df._cut_path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that have ended: its cleaner waits until the driver's
    collector has seen that nothing refers to them, which may be long after the disk is needed."""
    gc.collect()
    spark._jvm.System.gc()


def kept_tables() -> int:
    """A mark for :func:`release`."""
    return len(_kept)


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Deletes all that was kept since a mark, except ``but``: for callers that have written their result."""
    for path in _kept[since:]:
        if but is None or path != but._cut_path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _kept:
        _kept.remove(path)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
