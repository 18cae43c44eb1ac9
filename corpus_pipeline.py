"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. The first four return the columns of ``documents``: quality rules
drop bad documents, line dedup drops later similar lines (and documents of which nothing is left),
near-dedup keeps one document of each group of near copies, mixing draws whole documents so that
sources have their target weights (a document may come up to three times, or not at all). The last
returns the pieces of the packed sequences.

Defined results
    null or empty text      fails the quality rules, goes in the first stage
    very long text          whole in every stage
    null ids                no lines removed, no copies found, packed like others
    null source             a source of its own, the last
    repeated rows           equal ids don't remove each other's lines; each is drawn and packed on its own
    empty table             an empty result
    extra columns           kept up to packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from spindrift.llm.common import cut, drop, kept_tables, release, table

#: Words of a shingle in near-dedup.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs, SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of a shard stand together, in the order of its shuffle."""
    mixed = mixing.mix(docs)
    shard, place, _ = mixed.columns[len(docs.columns) :]
    return mixed.sortWithinPartitions(shard, place).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: Mixing draws at random and packing tokenizes: SQL can't express the whole; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once and read by the next, and
    then the tables that it was made from are deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        mark = kept_tables()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            release(spark, mark, but=docs)
            drop(*before)
            before = [docs]
    return docs
