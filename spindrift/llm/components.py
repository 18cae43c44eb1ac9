"""Connected components of links in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Links that one task takes at once (16 MB of them).
LOCAL_LINKS = 1_000_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and the smallest node that each reaches."""
    names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(names))
    while True:
        before = up
        high = up[up]
        low = high.copy()
        np.minimum.at(low, a, high[b])
        np.minimum.at(low, b, high[a])
        up = low.copy()
        np.minimum.at(up, before, low)
        if (up == before).all():
            return names, names[up]


def components(links: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): the smallest node that ``links`` (undirected) lead to.

    A bounded number of links is one task's work. More are taken in rounds by hooking and shortcuts
    (FastSV). Every node u has a parent f and a grandparent g. In a round, the least grandparent m
    among u's neighbours becomes the parent of u, and of u's old parent, if it is smaller; then
    parents move up to grandparents. So whole trees hang themselves on smaller ones and halve their
    depth in every round: 10,000 nodes in a row with shuffled names take 15 rounds. A round is one
    job whose result is cut, so neither the plan, nor the optimizer's estimates, nor what a lost
    executor costs grows with the rounds; the table of the round before is deleted.
    """
    kind = links.schema[a].dataType.simpleString()
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    if edges.count() <= local:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
            if held:
                found = least_reached(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

        out = cut(edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))
        drop(edges)
        return out

    both = cut(edges.union(edges.select("v", "u")))
    drop(edges)

    def above(parents: DataFrame) -> DataFrame:
        return parents.join(parents.select(F.col("u").alias("f"), F.col("f").alias("g")), "f").select(*parents.columns, "g")

    state = cut(above(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("f"))))
    while True:
        near = both.join(state.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        seen = state.join(near, "u").select("u", "f", F.least("g", "m").alias("m"))
        hooks = seen.select("u", F.col("f").alias("was"), "m").union(seen.select("f", F.lit(None), "m"))
        after = cut(above(hooks.groupBy("u").agg(F.min("m").alias("f"), F.max("was").alias("was"))))
        drop(state)
        state = after
        if state.filter("f <> was").isEmpty():
            drop(both)
            return state.select(F.col("u").alias("node"), F.col("f").alias("component"))
