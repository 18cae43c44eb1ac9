"""Partitioned (IVF) search: cells are a layout of the table, probing is partition pruning.

An index is a folder: ``centroids`` (list_id, centroid; 4096 rows at most), ``cells`` (the rows, a
folder for each cell), and for IVF-PQ ``codebook``; the rows then also hold the codes of what is
left of a vector when its centroid is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distances import metric_name
from ..functions.filters import apply_filter
from . import quantize, search

MOST_CELLS = 4096


def train(vectors: DataFrame, cells: int, seed: int = 0, vector: str = "embedding") -> DataFrame:
    """Centroids (list_id, centroid) by k-means over the whole table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    centers = KMeans(k=min(cells, MOST_CELLS), seed=seed, maxIter=15).fit(rows).clusterCenters()
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list_id int, centroid array<double>")


def centroids_from_rows(vectors: DataFrame, cells: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return vectors.filter(F.col(vec_id) < cells).select(F.col(vec_id).cast("int").alias("list_id"), F.col(vector).cast("array<double>").alias("centroid"))


def centroid_array(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(list ids, centroids), by list id."""
    rows = sorted(centroids.select("list_id", "centroid").limit(MOST_CELLS + 1).collect())
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    return np.array([r[0] for r in rows], dtype="i4"), np.array([r[1] for r in rows], dtype="f8")


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.round(np.stack([((x - c) ** 2).sum(1) for c in centers], 1), 9)


def assign(vectors: DataFrame, centroids: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vectors`` with list_id, the nearest cell, ties (to nine digits) to the smaller one; no shuffle."""
    ids, centers = centroid_array(centroids)
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantize.matrix(batch.column(names.index(vector)))
            near = np.concatenate([_gaps(x[at : at + 1024], centers).argmin(1) for at in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[near])], [*names, "list_id"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{kinds}, list_id int")


def write_layout(vectors: DataFrame, centroids: DataFrame, path: str, codebook: DataFrame | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> None:
    """Writes an index: one folder for each cell, rows of a cell together; with a codebook, their codes too."""
    rows = assign(vectors, centroids, vec_id, vector)
    if codebook is not None:
        rows = _with_codes(rows, centroids, codebook, vector)
        codebook.write.mode("overwrite").parquet(f"{path}/codebook")
    rows.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/cells")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def read_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, centroids) of a written index."""
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/centroids")


def rebuild(vectors: DataFrame, path: str, rows: int, kind: str | None = None, m: int = 8, bits: int = 8, seed: int = 0, vec_id: str = "vec_id", vector: str = "embedding") -> str:
    """Trains and writes the index that suits so many rows (or the kind asked for); tables smaller than
    their number of cells stay without one ("flat")."""
    kind = kind or search.index_type(rows)
    cells = search.cells(rows)
    if kind == "flat" or rows < cells:
        return "flat"
    centroids = train(vectors, cells, seed, vector)
    book = fit_residuals(vectors, centroids, m, bits, seed=seed, vector=vector) if kind == "ivfpq" else None
    write_layout(vectors, centroids, path, book, vec_id, vector)
    return kind


def nearest_cells(centroids: DataFrame, query, nprobe: int) -> list[int]:
    ids, centers = centroid_array(centroids)
    gaps = _gaps(np.asarray(query, dtype="f8")[None, :], centers)[0]
    return [int(ids[i]) for i in np.lexsort((ids, gaps))[:nprobe]]


def search_cells(laid_out: DataFrame, centroids: DataFrame, query, top_k: int, nprobe: int = 10, metric: str = "cosine", **options) -> DataFrame:
    """Exact search within the ``nprobe`` nearest cells; of a written index, the others aren't read."""
    rows = laid_out.filter(F.col("list_id").isin(nearest_cells(centroids, query, nprobe)))
    return search.knn(rows, query, top_k, metric, **options)


# ---- IVF-PQ ------------------------------------------------------------------------------------


def _residuals(rows: DataFrame, centroids: DataFrame, vector: str, into: str) -> DataFrame:
    ids, centers = centroid_array(centroids)
    place = np.full(int(ids.max()) + 1, -1)
    place[ids] = np.arange(len(ids))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = quantize.matrix(batch.column(names.index(vector)))
            if len(left):
                left = left - centers[place[batch.column(names.index("list_id")).to_numpy()]]
            offsets = np.arange(batch.num_rows + 1, dtype="i4") * centers.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(left.reshape(-1)))], [*names, into])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, `{into}` array<double>")


def fit_residuals(vectors: DataFrame, centroids: DataFrame, m: int = 8, bits: int = 8, iterations: int = 15, seed: int = 0, vector: str = "embedding") -> DataFrame:
    """A product codebook for what is left of vectors beside their centroids, on a bounded sample."""
    rows = _residuals(assign(vectors.select(vector), centroids, vector=vector), centroids, vector, "residual")
    return quantize.fit_product(rows, m, bits, iterations, seed, "residual")


def _with_codes(rows: DataFrame, centroids: DataFrame, codebook: DataFrame, vector: str) -> DataFrame:
    book = quantize.codebook_array(codebook)
    left = _residuals(rows, centroids, vector, "_residual")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = quantize.nearest_codes(quantize.matrix(batch.column(len(names))), book)
            offsets = np.arange(len(codes) + 1, dtype="i4") * book.shape[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1)))], [*names, "codes"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return left.mapInArrow(run, f"{kinds}, codes array<short>")


def search_pq(laid_out: DataFrame, centroids: DataFrame, codebook: DataFrame, query, top_k: int, nprobe: int = 10, metric: str = "cosine", refine: int = 10, filter_: Mapping | None = None, vec_id: str = "vec_id", vector: str = "embedding", metadata: str | None = None) -> DataFrame:
    """Search by codes within the nearest cells: of each cell, a table of the query's part distances
    (for cosine and dot, products), and the sum of its entries. With ``refine``, so many times top_k
    candidates are scored exactly; without, the approximate scores come back."""
    ids, centers = centroid_array(centroids)
    book, name = quantize.codebook_array(codebook), metric_name(metric)
    if name == "manhattan":
        raise ValueError("codes approximate squared distances and products only")
    probed = nearest_cells(centroids, query, nprobe)
    asked = np.asarray(query, dtype="f8")
    tables = []
    for cell in probed:
        center = centers[np.flatnonzero(ids == cell)[0]]
        if name in ("cosine", "dot"):
            table = -(np.where(np.isfinite(book), book, 0) * asked.reshape(book.shape[0], 1, -1)).sum(2)
            tables.append((cell, float(-(asked @ center)), table.reshape(-1).tolist()))
        else:
            tables.append((cell, 0.0, np.nan_to_num(quantize.distance_table(book, asked - center), posinf=0.0).reshape(-1).tolist()))
    held = laid_out.sparkSession.createDataFrame(tables, "list_id int, _base double, _table array<double>")  # nprobe rows
    rows = apply_filter(laid_out.filter(F.col("list_id").isin(probed)), filter_, metadata)
    width = book.shape[1]
    rough = F.aggregate(F.transform("codes", lambda c, i: F.get("_table", (i * width + c).cast("int"))), F.col("_base"), lambda a, v: a + v)
    found = rows.join(F.broadcast(held), "list_id").withColumn("score", F.round(rough, 6)).orderBy("score", vec_id)
    keep = [c for c in laid_out.columns if c not in (vector, "codes")]
    if refine:
        return search.knn(found.limit(refine * top_k).select(*keep, vector), query, top_k, name, vec_id=vec_id, vector=vector)
    return found.limit(top_k).select(*keep, "score")
