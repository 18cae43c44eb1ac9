"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are cut into blocks: a block is the set of documents whose hashed key
starts with the same three hex digits. Only the sizes of the blocks come to the driver (at most 4096
numbers a source, however large the source is). They give each source's quotas of blocks: whole
passes, and a last pass over a part of its blocks. A binary tree over the output shards splits these
quotas: each node deals its blocks to its two children by one multivariate-hypergeometric draw, so
every shard gets a random share of each source and all quotas are met exactly. The leaves then draw
their blocks one after the other, each with a generator of its own, from what earlier ones have left;
of the last block that a source's part pass needs, a part is taken. A shard takes the documents of
its own blocks, disjoint from those of other shards, and shuffles them locally.

Defined results
    null or empty text      size 0; taken 0 words, but drawn with its block like any other
    null source             a source of its own, the last
    null ids, repeated rows each row is drawn on its own; equal rows are interchangeable
    a source without words  target 0
    very long text          one row; at most the last document of a source is taken in part
    empty table             an empty result
    extra columns           kept by ``mix``; its own columns get names that are free
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 0
#: Hex digits of the key that name a block.
DIGITS = 3
#: Rows up to which the plan (source, block -> shards) is broadcast; above, it is joined by shuffle.
BROADCAST_ROWS = 250_000
#: Words that an output shard should hold, and the least number of shards.
SHARD_WORDS, SHARDS = 50_000_000, 16


def word_count(text: str = "text"):
    trimmed = F.btrim(text_or_empty(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = MOST_TIMES) -> list[float]:
    """Words to take of each source: by weight, none above ``most`` times its size."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        for i in above or free:
            out[i] = float(most * sizes[i]) if above else left * weights[i] / weight
        if not above:
            break
        free -= above
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block quotas; columns sum to ``quotas``, rows are as equal as can be."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.concatenate([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def _leaf_draws(blocks: np.ndarray, share: np.ndarray, seed: int, column: int) -> tuple[np.ndarray, np.ndarray]:
    """What the leaves of the tree draw from ``blocks``, one leaf after the other: each as many as its
    share, at random and without replacement from those that are left. The blocks in the order in which
    they are drawn, and their leaves; blocks that no leaf draws come last, for the last leaf that drew."""
    pool, drawn, leaves = blocks.copy(), [], []
    for leaf in np.flatnonzero(share):
        at = np.random.default_rng([seed, column, int(leaf)]).permutation(len(pool))
        drawn.append(pool[at[: share[leaf]]])
        pool = pool[np.sort(at[share[leaf] :])]
        leaves.append(np.full(share[leaf], leaf))
    if len(pool):
        drawn.append(np.random.default_rng([seed, column]).permutation(pool))
        leaves.append(np.full(len(pool), leaves[-1][-1] if leaves else 0))
    return np.concatenate(drawn) if drawn else pool, np.concatenate(leaves) if leaves else pool


def _plan(blocks: pd.DataFrame, weights, share: float, seed: int, shards: int | None):
    """Per source and block: its source's figures, whole passes, words of the part pass, shards of its draws.

    Two quotas of blocks for each source: its whole passes, and the part pass, of about as many blocks
    as make up the rest. The tree splits both among the shards, and the leaves draw. What the part pass
    has drawn is cut (or, if its blocks were small, drawn on) where the source's words are met exactly.
    """
    blocks = blocks.sort_values(["source", "block"], na_position="last", kind="stable").reset_index(drop=True)
    if not len(blocks):
        return pd.DataFrame(columns=["source", "block", "source_size", "target", "passes", "part", "shards"]), 0
    ids = pd.factorize(blocks["source"], use_na_sentinel=False)[0]
    held = blocks["words"].to_numpy().astype("i8")
    sizes = np.bincount(ids, weights=held).astype("i8").tolist()
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share)
    words = np.array([int(np.floor(g + 0.5)) for g in goal], dtype="i8")
    size = np.maximum(np.array(sizes, dtype="i8"), 1)
    passes, rest = words // size, words % size
    count = np.bincount(ids)
    quotas = np.concatenate((passes * count, np.ceil(rest * count / size).astype("i8")))
    shards = shards or max(1, min(int(quotas.sum()), max(SHARDS, -(-int(words.sum()) // SHARD_WORDS))))
    shares = split_tree(quotas, shards, np.random.default_rng(seed))
    part, dealt = np.zeros(len(blocks), dtype="i8"), [[] for _ in range(len(blocks))]
    for s in range(len(sizes)):
        own = np.flatnonzero(ids == s)
        for block, shard in zip(*_leaf_draws(np.repeat(own, passes[s]), shares[:, s], seed, s), strict=True):
            dealt[block].append(int(shard))
        order, leaves = _leaf_draws(own, shares[:, len(sizes) + s], seed, len(sizes) + s)
        before = np.cumsum(held[order]) - held[order]
        part[order] = np.clip(rest[s] - before, 0, held[order])
        for block, shard in zip(order, leaves, strict=True):
            if part[block]:
                dealt[block].append(int(shard))
    plan = pd.DataFrame({"source": blocks["source"], "block": blocks["block"], "source_size": np.array(sizes)[ids], "target": np.array(goal)[ids], "passes": passes[ids], "part": part, "shards": dealt})
    return plan, shards


def draw(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weights=WEIGHTS, share: float = 1.0, seed: int = SEED, shards: int | None = None, whole: bool = False) -> DataFrame:
    """``docs`` with source_size, target, and ``words``: an array of what each draw of the row takes,
    and ``shards``: where each draw goes.

    ``whole``: documents are not taken in part; the last one is taken if most of it is within the quota.
    """
    spark = docs.sparkSession
    key, block = fresh(docs, "mix_key"), fresh(docs, "mix_block")
    keyed = docs.withColumn(key, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"))))
    keyed = keyed.withColumn(block, F.substring(key, 1, DIGITS))
    blocks = keyed.groupBy(F.col(source).alias("source"), F.col(block).alias("block")).agg(F.sum(size).alias("words")).toPandas()
    plan, _ = _plan(blocks, weights, share, seed, shards)
    kinds = f"mix_source {docs.schema[source].dataType.simpleString()}, mix_block_ string, source_size long, target double, mix_passes long, mix_part long, shards array<int>"
    planned = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r[:1]) + (r[1], int(r[2]), float(r[3]), int(r[4]), int(r[5]), r[6]) for r in plan.itertuples(index=False)], kinds)
    planned = F.broadcast(planned) if len(plan) <= BROADCAST_ROWS else planned
    rows = keyed.join(planned, F.col(source).eqNullSafe(F.col("mix_source")) & (F.col(block) == F.col("mix_block_"))).drop("mix_source", "mix_block_")
    # Within a block, the documents of the part pass are the first by key. Blocks are small and even.
    before = Window.partitionBy(source, block).orderBy(key, doc_id, size).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(size).over(before), F.lit(0))
    cut_ = F.greatest(F.lit(0), F.least(F.col(size), F.col("mix_part") - ahead))
    if whole:
        cut_ = F.when(2 * cut_ >= F.col(size), F.col(size)).otherwise(F.lit(0))
    part = F.when(F.col("mix_part") > 0, F.array(cut_.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("words", F.concat(F.array_repeat(F.col(size), F.col("mix_passes").cast("int")), part))
    return rows.drop(key, block, "mix_passes", "mix_part")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = 1.0, seed: int = SEED, shards: int | None = None, whole: bool = True) -> DataFrame:
    """The mix itself: a row per drawn document with ``docs``' columns, the shard, and its place there.

    Columns that are added: mix_shard, mix_place (from 0 within the shard), mix_words (words of
    the text that this draw takes; the whole text unless ``whole`` is false).
    """
    names = {c: f"mix_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    size = fresh(own, "mix_size")
    drawn = draw(own.withColumn(size, word_count(names[text])), names[doc_id], names[source], size, weights, share, seed, shards, whole)
    drawn = drawn.withColumn("mix_draw", F.explode(F.arrays_zip("words", "shards")))
    drawn = drawn.filter((F.col("mix_draw")["words"] > 0) | (F.col(size) == 0))
    shuffled = F.xxhash64(F.lit(seed), F.col("mix_draw")["shards"], names[doc_id])
    place = Window.partitionBy(F.col("mix_draw")["shards"]).orderBy(shuffled, names[doc_id])
    return drawn.select(*(F.col(v).alias(k) for k, v in names.items()), F.col("mix_draw")["shards"].alias(fresh(docs, "mix_shard")), (F.row_number().over(place) - 1).alias(fresh(docs, "mix_place")), F.col("mix_draw")["words"].alias(fresh(docs, "mix_words")))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    drawn = draw(cut(docs))
    taken = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w).alias("taken")
    return drawn.select("doc_id", "size", "source_size", "target", taken, F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


QUERIES = {"op2_mixing": op2_mixing}
#: What the leaves draw comes from seeded generators, which SQL has not; the tests follow it by plain loops.
ORACLES: dict[str, str] = {}
