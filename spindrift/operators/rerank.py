"""Reordering bounded candidate lists: maximal marginal relevance, pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mmr_order(vectors: np.ndarray, relevance: np.ndarray, top_k: int, lambda_: float) -> list[int]:
    """Positions chosen one by one: lambda * relevance - (1 - lambda) * largest similarity to those chosen."""
    n = len(vectors)
    lengths = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(lengths < 1e-10, 1.0, lengths)[:, None]
    chosen, nearest, free = [], np.full(n, -np.inf), np.ones(n, dtype=bool)
    for _ in range(min(top_k, n)):
        value = relevance if not chosen else lambda_ * relevance - (1 - lambda_) * nearest
        best = int(np.argmax(np.where(free, value, -np.inf)))  # the earliest of equals
        chosen.append(best)
        free[best] = False
        nearest = np.maximum(nearest, unit @ unit[best])
    return chosen


def mmr(candidates: DataFrame, top_k: int, lambda_: float = 0.5, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding", score: str = "score", larger_is_better: bool = True) -> DataFrame:
    """Per query, the candidates' order by MMR; scores stay as they were. Candidates are a top-k list."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["s", "i"], ascending=[not larger_is_better, True], ignore_index=True)
        relevance = group["s"].to_numpy() if larger_is_better else -group["s"].to_numpy()
        order = mmr_order(np.array(group["v"].tolist(), dtype="f8"), relevance, top_k, lambda_)
        out = group.loc[order, ["q", "i", "s"]]
        return out.assign(rank=range(1, len(out) + 1))

    rows = candidates.select(F.col(query_id).alias("q"), F.col(vec_id).alias("i"), F.col(score).alias("s"), F.col(vector).alias("v"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in "qi"}
    return rows.groupBy("q").applyInPandas(run, f"q {kinds['q']}, i {kinds['i']}, s double, rank int").toDF(query_id, vec_id, score, "rank")


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series], pd.Series], text: str, top_k: int, key: str = "vec_id") -> DataFrame:
    """Candidates by a model's score; the old one stays as original_score."""
    model = F.pandas_udf(scorer, "double")
    scored = candidates.withColumnRenamed("score", "original_score").withColumn("score", model(F.col(text)))
    return scored.orderBy(F.desc("score"), key).limit(top_k)
