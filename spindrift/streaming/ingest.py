"""Streaming writes into a stored collection, expiring state, rolling metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ordering import numbered
from ..sources.collection import Store


def ingest(stream: DataFrame, store: Store, name: str, key: str, order: str, checkpoint: str, created: str | None = None) -> StreamingQuery:
    """Last-write-wins upserts, one new version for each micro-batch; runs until the input is used up.

    A record that is older than the stored one changes nothing, and a batch that was merged before
    the stream failed is known by its number in the collection's log.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(name, batch, order, key, created, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stream: DataFrame, key: str, value: str, ttl_seconds: int) -> DataFrame:
    """The latest value of each key, forgotten after ``ttl_seconds``; needs the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, value)}

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("latest", f"value {kinds[value]}", ttl_seconds * 1000)

        def handleInputRows(self, key_, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for batch in rows:
                self.held.update((batch[value].iloc[-1].item() if hasattr(batch[value].iloc[-1], "item") else batch[value].iloc[-1],))
            yield pd.DataFrame({key: [key_[0]], value: [self.held.get()[0]]})

        def close(self) -> None:
            pass

    return stream.groupBy(key).transformWithStateInPandas(Latest(), f"{key} {kinds[key]}, {value} {kinds[value]}", "Update", "ProcessingTime")


#: Rows of a block of rolling means.
BLOCK = 250_000


def rolling_mean(rows: DataFrame, value: str, order: str, partition: str, size: int = 1000, block: int = BLOCK) -> DataFrame:
    """Adds rolling: the mean of the last ``size`` values of a partition. ``value`` is a whole number.

    Running sums, less the sum that lies ``size`` rows back: the work doesn't grow with ``size``. A
    partition of any length is cut into blocks, each of which also gets the last rows of the one before.
    """
    block = max(block, size)
    # A row more than the mean reaches back to: its running sum is what is taken off.
    held = numbered(rows, order, [partition], "_row").withColumn("_block", F.floor(F.col("_row") / block))
    over = (F.pmod("_row", F.lit(block)) >= block - size).cast("int")
    copies = held.withColumn("_own", F.explode(F.when(over == 1, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    w = Window.partitionBy(partition, "_own").orderBy("_row")
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    summed = copies.withColumn("_sum", running).withColumn("_back", F.coalesce(F.lag("_sum", size).over(w), F.lit(0)))
    own = summed.filter(F.col("_own") == F.col("_block"))
    return own.select(*rows.columns, ((F.col("_sum") - F.col("_back")) / F.least(F.col("_row") + 1, F.lit(size))).alias("rolling"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets: bound, count of values up to it."""
    counted: list[Column] = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(str(i)) for i, b in enumerate(bounds)]
    one = rows.agg(*counted)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.coalesce(F.col(str(i)), F.lit(0)).alias("count")) for i, b in enumerate(bounds)])).alias("b")).select("b.*")


def newest(rows: DataFrame, order: str, limit: int = 500) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(limit)


