"""Row numbers and running totals over whole tables, without a task that sorts all rows.

The table is cut at bounds that are read from it once and are constants from then on, so a row's
bucket depends on nothing but its own value: recomputed tasks and separately planned branches agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which a table is cut, and rows that are looked at for each bound.
BUCKETS, PER_BOUND = 256, 16


def bounds_of(rows: DataFrame, order: str, buckets: int = BUCKETS) -> list:
    """Values that cut the table into about equal parts, from a hashed sample of bounded size."""
    some = rows.select(F.col(order).alias("v")).filter("v is not null").distinct()
    sample = sorted(r[0] for r in some.orderBy(F.xxhash64("v"), "v").limit(buckets * PER_BOUND).collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []


def bucket(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by a balanced tree of comparisons; nulls come first."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(value.isNull(), F.lit(-1)).otherwise(search(0, len(bounds)))


def numbered(rows: DataFrame, order: str, partition: list[str] | None = None, name: str = "row", total: str | None = None) -> DataFrame:
    """``rows`` with their number (from 0) by ``order`` within ``partition``, and if asked for, ``before``:
    the sum of ``total`` over the rows that come earlier."""
    keys = list(partition or [])
    held = rows.withColumn("_bucket", bucket(F.col(order), bounds_of(rows, order)))
    sums = [F.count("*").alias("_n")] + ([F.sum(total).alias("_t")] if total else [])
    counts = held.groupBy(*keys, "_bucket").agg(*sums)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ["_n", "_t"][: len(sums)]))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order)
    out = held.join(counts, same).withColumn(name, F.row_number().over(within) - 1 + F.col("_n0"))
    if total:
        out = out.withColumn("before", F.coalesce(F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_t0"))
    return out.select(*rows.columns, name, *(["before"] if total else []))
