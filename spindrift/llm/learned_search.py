"""Approximate nearest neighbours in learned partitions.

1.  Fit, on the driver, on a bounded sample (``SAMPLE`` rows, chosen by a hash of the id): the exact
    neighbour graph of the sample is cut by recursive balanced bisection (spectral start, swaps that
    lower the cut), and a small network with one hidden layer learns to give a vector's partition
    from the vector, against the partitions of its neighbours. How many partitions to probe is set
    on sample vectors that the network has not seen: the fewest that find ``AIM`` of their neighbours.
2.  Index: every row of the table goes to its most probable partition; partitions are dealt into
    blocks of bounded size, so one that holds a third of all rows is searched by many tasks.
3.  Search: each query goes to its most probable partitions, meets their blocks, and gets the exact
    distances there in double precision; a block returns its nearest, and those are ranked.

Defined results
    null, zero or non-finite vectors, null components   take no part, as query or candidate
    vectors of another dimension   take no part; the dimension is the most frequent one
    null ids                take no part
    repeated rows           equal distances, ties to the smaller id; a query's own id is no candidate
    fewer candidates than k all of them, if their partitions are probed; small tables are searched whole
    empty table             an empty result
    extra columns           not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows on which the partitions are learned.
SAMPLE = 4096
NEIGHBOURS = 10
HIDDEN = 128
#: Share of the sample's true neighbours that the probed partitions must hold.
AIM = 0.975
#: Rows of a block, and queries of a group: every block of a partition meets every group of its
#: queries, so what is exchanged is least when both are of one size. Queries that are scored at once.
BLOCK, GROUP, AT_ONCE = 4096, 4096, 256


def valid(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


# ---- balanced partitions of a neighbour graph ----------------------------------------------------


def graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact k nearest rows of each row (self excluded), and the symmetric 0/1 adjacency."""
    square = (x**2).sum(1)
    near = np.empty((len(x), k), dtype=int)
    for at in range(0, len(x), 512):
        d = square[at : at + 512, None] - 2 * x[at : at + 512] @ x.T + square
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    a = np.zeros((len(x), len(x)), dtype=np.float32)
    np.put_along_axis(a, near, 1, axis=1)
    return near, np.maximum(a, a.T)


def bisect(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the nodes (a boolean per node) with few edges to the other half."""
    n = len(a)
    root = np.sqrt(a.sum(1) + 1e-9)
    v = rng.standard_normal(n).astype(np.float32)
    for _ in range(40):
        v -= root * (root @ v) / (root @ root)
        v = a @ (v / root) / root + v
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    sign = np.where(side, 1.0, -1.0).astype(np.float32)
    best = sign @ (a @ sign)
    step = max(1, n // 16)
    while step:  # swap the nodes that gain most from either side, while that helps
        gain = -sign * (a @ sign)
        up, down = np.flatnonzero(sign > 0), np.flatnonzero(sign < 0)
        take = min(step, len(up), len(down))
        trial = sign.copy()
        trial[up[np.argsort(-gain[up], kind="stable")[:take]]] = -1
        trial[down[np.argsort(-gain[down], kind="stable")[:take]]] = 1
        value = trial @ (a @ trial)
        if value > best:
            sign, best = trial, value
        else:
            step //= 2
    return sign > 0


def partition(a: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node; parts is a power of two, sizes differ by a node at most per level."""
    label = np.zeros(len(a), dtype=int)
    for _ in range(parts.bit_length() - 1):
        after = label * 2
        for p in np.unique(label):
            own = np.flatnonzero(label == p)
            after[own] += bisect(a[np.ix_(own, own)], rng)
        label = after
    return label


class Router:
    """Vector -> probabilities of partitions: one hidden layer, trained by Adam on soft labels."""

    def __init__(self, x: np.ndarray, soft: np.ndarray, rng: np.random.Generator, epochs: int = 60):
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, soft.shape[1]), (soft.shape[1],)]
        self.w = [rng.standard_normal(s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s) for s in shapes]
        first, second, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        z = (x - self.mean) / self.scale
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                h = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                out = self._softmax(h @ self.w[2] + self.w[3])
                d = (out - soft[rows]) / len(rows)
                back = (d @ self.w[2].T) * (h > 0)
                gradients = [z[rows].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum(0)]
                t += 1
                for i, g in enumerate(gradients):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    rate = 3e-3 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                    self.w[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-8)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def fit(sample: np.ndarray, rows: int, seed: int = 0) -> tuple[Router | None, int, int]:
    """The router, the number of partitions, and how many to probe; (None, 1, 1) for small tables."""
    sample = np.unique(sample, axis=0)
    parts = 1 << max(0, min(8, int(np.log2(max(1.0, np.sqrt(rows) / 4)))))
    while parts > 1 and len(sample) < 24 * parts:
        parts //= 2
    if parts < 4:
        return None, 1, 1
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))]
    unseen = len(x) // 5
    seen = x[unseen:]
    near, a = graph(seen, NEIGHBOURS)
    label = partition(a, parts, rng)
    soft = np.eye(parts)[label] * 0.5 + 0.5 * np.eye(parts)[label[near]].mean(1)
    router = Router(seen, soft, rng)
    asked, held = x[:unseen], router(seen).argmax(1)
    order = np.argsort(-router(asked), axis=1)
    d = (asked**2).sum(1)[:, None] - 2 * asked @ seen.T + (seen**2).sum(1)
    nearest = held[np.argpartition(d, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]]
    place = np.argsort(order, axis=1)  # partition -> its place in the query's order
    found = np.take_along_axis(place, nearest, axis=1)
    probes = next((m for m in range(1, parts + 1) if (found < m).mean() >= AIM), parts)
    return router, parts, probes


# ---- search --------------------------------------------------------------------------------------


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: the ids of its k nearest rows and their distances, exactly."""
    rough = (x**2).sum(1) - 2 * queries @ x.T + (queries**2).sum(1)[:, None]
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    for i in range(len(queries)):
        allowed = np.flatnonzero(ids != own[i])
        r = rough[i, allowed]
        if len(r) > k:
            allowed = allowed[r <= np.partition(r, k - 1)[k - 1] + slack]
        d = np.sqrt(((x[allowed] - queries[i]) ** 2).sum(1))
        order = np.lexsort((ids[allowed], d))[:k]
        yield i, ids[allowed][order], d[order]


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 0, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where ``is_query`` (a column of vec_id) holds."""
    rows = valid(vectors, vec_id, vector)
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    n = size["n"] if size else 1
    rows = rows.filter(F.size("v") == n)
    taken = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("v").collect()
    router, parts, probes = fit(np.array([r[0] for r in taken], dtype="f8").reshape(-1, n), size["c"] if size else 0, seed)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def route(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if router is None:
                    order = np.zeros((batch.num_rows, 1), dtype="i4")
                else:
                    order = np.argsort(-router(_matrix(batch.column(1))), axis=1, kind="stable")[:, :most].astype("i4")
                offsets = np.arange(len(order) + 1, dtype="i4") * order.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(order.reshape(-1)))], ["vec_id", "v", "parts"])

        return run

    routed = f"vec_id {kind}, v array<double>, parts array<int>"
    indexed = cut(rows.mapInArrow(route(1), routed).select("vec_id", "v", F.col("parts")[0].alias("part")))
    counts = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row for each partition, 256 at most
    dealt = indexed.join(F.broadcast(counts), "part").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")))
    held = dealt.groupBy("part", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("held"))

    asked = rows.filter(is_query).mapInArrow(route(probes), routed).select(F.col("vec_id").alias("query_id"), "v", F.explode("parts").alias("part"))
    asked = cut(asked)
    per_part = asked.groupBy("part").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    grouped = asked.join(F.broadcast(per_part), "part").withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("groups")))
    grouped = grouped.groupBy("part", "group").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    both = held.join(grouped, "part").repartition(F.xxhash64("part", "block", "group")).select("held", "asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, other = batch.column(1)[r].values, batch.column(0)[r].values
                qids, ids, x = own.field("query_id").to_numpy(), other.field("vec_id").to_numpy(), _matrix(other.field("v"))
                q = _matrix(own.field("v"))
                for at in range(0, len(q), AT_ONCE):
                    qid = qids[at : at + AT_ONCE]
                    found = list(nearest(q[at : at + AT_ONCE], ids, x, qid, k))
                    columns = [np.repeat(qid, [len(d) for _, _, d in found]), np.concatenate([i for _, i, _ in found]), np.concatenate([d for _, _, d in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    scored = both.mapInArrow(score, f"query_id {kind}, vec_id {kind}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_learned_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


QUERIES = {"op1_learned_search": op1_learned_search}
ORACLES: dict[str, str] = {}
