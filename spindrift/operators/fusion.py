"""Fusing ranked lists (id, score) into one."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import larger_is_better
from ..functions.filters import apply_filter
from ..functions.text import keyword_search
from . import search

RRF_K = 60
#: Rows of a ranked list: one task ranks it.
MOST = 10_000


def ranked(df: DataFrame, key: str = "id", score: str = "score", most: int = MOST) -> DataFrame:
    """With an explicit rank from 1, for the ``most`` best."""
    return df.orderBy(F.desc(score), key).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def rrf_fuse(lists: list[tuple[DataFrame, float]], top_k: int, key: str = "id") -> DataFrame:
    """Sum of weight / (60 + rank) over the lists that hold an id."""
    parts = [df.select(key, (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("part")) for df, w in lists]
    total = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.round(F.sum("part"), 6).alias("score"))
    return total.orderBy(F.desc("score"), key).limit(top_k)


def min_max(score: Column, *partition: str) -> Column:
    """Into [0, 1] within a partition; all 1 if the scores don't differ."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise((score - low) / (high - low))


def linear_fuse(dense: DataFrame, sparse: DataFrame, weight: float, top_k: int, key: str = "id") -> DataFrame:
    """weight * dense + (1 - weight) * sparse of min-max scores; an id missing in a list has 0 there."""
    w = min(1.0, max(0.0, weight))
    a, b = (df.orderBy(F.desc("score"), key).limit(MOST).select(key, min_max(F.col("score")).alias(c)) for df, c in ((dense, "a"), (sparse, "b")))
    both = a.join(b, key, "full").select(key, F.round(w * F.coalesce("a", F.lit(0.0)) + (1 - w) * F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    return both.orderBy(F.desc("score"), key).limit(top_k)


def hybrid_search(vectors: DataFrame, docs: DataFrame, query, text: str, top_k: int, vector_weight: float = 0.7, fusion: str = "rrf", filter_: Mapping | None = None, metric: str = "cosine", candidates: int = 100, keywords: int = 500, vec_id: str = "vec_id", doc_id: str = "doc_id", text_column: str = "text", metadata: str | None = None) -> DataFrame:
    """Dense and keyword search of one collection, fused. The filter (on ``docs``, which hold the
    metadata) comes before both lists are cut, so top_k rows come back if so many match."""
    kept = apply_filter(docs, filter_, metadata)
    rows = vectors.join(kept.select(F.col(doc_id).alias(vec_id)), vec_id, "left_semi") if filter_ else vectors
    dense = search.knn(rows.select(vec_id, "embedding"), query, max(10 * top_k, candidates), metric, vec_id=vec_id).select(F.col(vec_id).alias("id"), "score")
    if not larger_is_better(metric):
        dense = dense.withColumn("score", -F.col("score"))
    words = keyword_search(kept, text, keywords, doc_id, text_column).select(F.col("doc_id").alias("id"), "score")
    return hybrid(dense, words, top_k, vector_weight, fusion)


def hybrid(dense: DataFrame, keyword: DataFrame, top_k: int, vector_weight: float = 0.7, fusion: str = "rrf", key: str = "id") -> DataFrame:
    """Dense and keyword results in one list. Keyword scores are 1 / rank in the linear mode."""
    if fusion == "rrf":
        return rrf_fuse([(ranked(dense, key), vector_weight), (ranked(keyword, key), 1 - vector_weight)], top_k, key)
    if fusion != "linear":
        raise ValueError(f"unknown fusion: {fusion}")
    places = ranked(keyword, key).select(key, (1.0 / F.col("rank")).alias("score"))
    return linear_fuse(dense, places, vector_weight, top_k, key)
