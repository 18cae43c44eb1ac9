"""Nearest-neighbour search: scan, filter, score, top k."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions.filters import apply_filter

DIGITS = 6
#: Rows above which the automatic choice leaves exact search for partitioned search.
FLAT_ROWS, IVF_ROWS = 10_000, 100_000


def _ordered(df: DataFrame, metric: str, vec_id: str) -> DataFrame:
    return df.orderBy(F.desc("score") if D.larger_is_better(metric) else F.asc("score"), vec_id)


def _passes(score: Column, metric: str, threshold: float) -> Column:
    return score >= threshold if D.larger_is_better(metric) else score <= threshold


def knn(vectors: DataFrame, query, top_k: int = 10, metric: str = "cosine", filter_: Mapping | None = None, threshold: float | None = None, include_vector: bool = False, vec_id: str = "vec_id", vector: str = "embedding", metadata: str | None = None) -> DataFrame:
    """Exact search for one vector. The filter is applied before scoring, so k rows come back if k match."""
    rows = apply_filter(vectors, filter_, metadata)
    rows = rows.filter(F.size(vector) == len(query))
    keep = [c for c in vectors.columns if c != vector or include_vector]
    scored = rows.select(*keep, F.round(D.score(F.col(vector), D.literal(query), metric), DIGITS).alias("score"))
    if threshold is not None:
        scored = scored.filter(_passes(F.col("score"), metric, threshold))
    return _ordered(scored, metric, vec_id).limit(top_k)


def knn_by_id(vectors: DataFrame, stored_id, top_k: int = 10, metric: str = "cosine", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Neighbours of a stored vector, itself included."""
    asked = vectors.filter(F.col(vec_id) == F.lit(stored_id)).select(F.col(vector).alias("_asked")).limit(1)
    scored = vectors.crossJoin(F.broadcast(asked)).withColumn("score", F.round(D.score(F.col(vector), F.col("_asked"), metric), DIGITS))
    return _ordered(scored.drop(vector, "_asked"), metric, vec_id).limit(top_k)


def knn_batch(queries: DataFrame, vectors: DataFrame, top_k: int = 10, metric: str = "cosine", query_id: str = "query_id", query: str = "query", vec_id: str = "vec_id", vector: str = "embedding", max_queries: int = 10_000) -> DataFrame:
    """Exact search for a stated set of queries: one matrix product per Arrow batch of vectors.

    The queries are collected, as their number is bounded by ``max_queries``; every batch gives its
    own top k for each, and the rest is a ranked union. Queries of another dimension find nothing.
    """
    name = D.metric_name(metric)
    asked = queries.select(query_id, query).limit(max_queries + 1).collect()
    if len(asked) > max_queries:
        raise ValueError(f"more than {max_queries} queries; split them")
    qkind, vkind = queries.schema[query_id].dataType.simpleString(), vectors.schema[vec_id].dataType.simpleString()
    by_size: dict[int, list] = {}
    for row in asked:
        by_size.setdefault(len(row[1] or ()), []).append(row)
    groups = {n: ([r[0] for r in rows], np.array([r[1] for r in rows], dtype="f8")) for n, rows in by_size.items()}
    better = D.larger_is_better(name)

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if name == "manhattan":
            return np.stack([np.abs(x - v).sum(1) for v in q])
        if name in ("euclidean", "l2"):
            return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in q])
        s = q @ x.T
        if name == "cosine":
            a, b = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(x, axis=1)[None, :]
            zero = (a < D.EPSILON) | (b < D.EPSILON)
            s = np.where(zero, 0.0, np.clip(s / np.where(zero, 1.0, a * b), -1, 1))
        return s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for n, (ids, q) in groups.items():
                own = np.flatnonzero(sizes == n)
                if not len(own) or not n:
                    continue
                part = batch.take(pa.array(own)) if len(own) < batch.num_rows else batch
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(own), n)
                key, k = part.column(0).to_numpy(zero_copy_only=False), min(top_k, len(own))
                columns = [[], [], []]
                for at in range(0, len(q), 256):
                    s = np.round(scores(q[at : at + 256], x), DIGITS) + 0.0
                    order = np.stack([np.lexsort((key, -row if better else row))[:k] for row in s])
                    columns[0] += [i for i in ids[at : at + 256] for _ in range(k)]
                    columns[1].append(key[order].reshape(-1))
                    columns[2].append(np.take_along_axis(s, order, 1).reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(np.concatenate(columns[1])), pa.array(np.concatenate(columns[2]))], ["query_id", "vec_id", "score"])

    partial = vectors.select(F.col(vec_id).alias("i"), F.col(vector).alias("v")).mapInArrow(run, f"query_id {qkind}, vec_id {vkind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score") if better else F.asc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def search(vectors: DataFrame, query, top_k: int = 10, metric: str = "cosine", filter_: Mapping | None = None, threshold: float | None = None, include_vector: bool = False, ef: int | None = None, use_mmr: bool = False, mmr_lambda: float = 0.5, fetch: int | None = None, vec_id: str = "vec_id", vector: str = "embedding", metadata: str | None = None) -> DataFrame:
    """A collection's search as one call: filter, score, threshold, top k, and if asked for, the order
    by maximal marginal relevance of the ``fetch`` best (top_k, if not given).

    ``ef`` is the effort that graph indexes take; exact search finds all it could find at any effort.
    A query of another dimension than the collection's finds nothing.
    """
    if ef is not None and ef < 1:
        raise ValueError("ef must be positive")
    found = knn(vectors, query, max(top_k, fetch or 0) if use_mmr else top_k, metric, filter_, threshold, include_vector or use_mmr, vec_id, vector, metadata)
    if not use_mmr:
        return found
    from .rerank import mmr

    order = mmr(found.withColumn("_query", F.lit(0)), top_k, mmr_lambda, "_query", vec_id, vector, larger_is_better=D.larger_is_better(metric))
    keep = [c for c in found.columns if c != vector or include_vector]
    return found.select(*keep).join(F.broadcast(order.select(vec_id, "rank")), vec_id).orderBy("rank")


def rescore(candidates: DataFrame, vectors: DataFrame, query, top_k: int, metric: str = "dot", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Candidates by their exact score."""
    rows = vectors.join(candidates.select(vec_id), vec_id, "left_semi")
    return knn(rows.select(vec_id, vector), query, top_k, metric, vec_id=vec_id, vector=vector)


def index_type(rows: int) -> str:
    return "flat" if rows < FLAT_ROWS else "ivf" if rows < IVF_ROWS else "hnsw"


def cells(rows: int) -> int:
    """How many cells a partitioned layout should have."""
    return max(4, min(4096, int(4 * rows**0.5)))


def search_by_text(vectors: DataFrame, text: str, embed, top_k: int = 10, **options) -> DataFrame:
    """``embed`` is any function from a text to a vector."""
    return search(vectors, embed(text), top_k, **options)


def hashed_embedding(text: str, size: int = 64) -> list[float]:
    """A stand-in for a model: signed hashed token counts, unit length."""
    import re
    import zlib

    out = np.zeros(size)
    for token in re.findall(r"[a-z0-9]+", text.lower()):
        h = zlib.crc32(token.encode())
        out[h % size] += 1 if h >> 31 else -1
    return (out / (np.linalg.norm(out) or 1)).tolist()
