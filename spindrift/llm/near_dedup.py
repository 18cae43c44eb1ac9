"""MinHash near-dedup: bands for candidates, packed b-bit signatures to estimate, exact sets to confirm.

1.  One Arrow pass gives each document its distinct shingles' count, a 128-bit key of the set, 32
    band keys (4 minima each) and the low 4 bits of 128 minima, packed into 8 longs. Documents with
    equal sets become one node (their smallest id).
2.  Documents that share a band key are candidates. Of each band group only links to its smallest
    node are made: linear in the group. The packed signatures give the similarity, corrected for
    chance agreement of the low bits, from bit counts of their exclusive or; clear non-neighbours go.
3.  The others are confirmed on full shingle sets. The texts are exchanged once, to give the sets of
    all candidates, which this and the next step read.
4.  What shares band keys, directly or through others, is a family. In families that still hold
    several components, the nodes outside the largest one meet all others in blocks of bounded
    size: first their signatures; then those that see a possible link meet the full sets, and only
    links that join two components leave the task. So a link that runs past a group's smallest node
    is not lost.

A link of the least similarity misses all 32 bands with probability 5e-8 and is estimated too low
with less than 1e-8. Components need no pairs, only a link to each new member; copies and near
copies of one text cost time in proportion to their number.

Defined results
    null or empty text      0 shingles, linked with nothing, a component of its own
    null ids                never linked; component null, kept
    fewer words than a shingle  the whole sequence is the one shingle
    very long text          taken in slices; its set is one row when it is confirmed
    repeated rows           equal sets, so one component; all rows with its smallest id are kept
    empty table             an empty result
    extra columns           not read; ``dedup`` keeps them
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS, BITS = 32, 4, 4
PERMUTATIONS = BANDS * ROWS
SIMILARITY = 80  # percent
#: Six standard deviations of the estimate below the least similarity.
ESTIMATE = 0.58
#: Nodes in a block of comparisons (step 4); 64 times as many shingles.
BLOCK = 1024
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, size=PERMUTATIONS, dtype=np.uint64)
_PER_LONG = 64 // BITS
LONGS = PERMUTATIONS // _PER_LONG
_LOW = int("1" * _PER_LONG, 16) if BITS == 4 else None


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, permutations) minima of hashed shingles; the sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), PERMUTATIONS), dtype=np.uint64)
    for k in range(PERMUTATIONS):
        out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    return out


def pack(lowest: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed: (documents, LONGS). The minima are mixed first, as the
    low bits of multiplied numbers are not random."""
    low = (mix(lowest) & np.uint64(2**BITS - 1)).reshape(len(lowest), LONGS, _PER_LONG)
    return reduce(np.bitwise_or, (low[:, :, i] << np.uint64(BITS * i) for i in range(_PER_LONG)))


def band_keys(lowest: np.ndarray) -> np.ndarray:
    rows = lowest.reshape(len(lowest), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key + rows[:, :, i])
    return key


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    def emit(ids, sets):
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = np.zeros((len(sets), 2), dtype=np.uint64)
        signatures, bands = np.zeros((len(sets), LONGS), dtype=np.uint64), np.zeros((len(sets), BANDS), dtype=np.uint64)
        if full:
            own = [sets[k] for k in full]
            flat, starts = np.concatenate(own), np.cumsum([0] + [len(s) for s in own[:-1]])
            keys[full, 0] = np.add.reduceat(mix(flat + np.uint64(11)), starts)
            keys[full, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x5DEECE66D)), starts)
            lowest = minima(own)
            signatures[full], bands[full] = pack(lowest), band_keys(lowest)
        lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype="i4") * x.shape[1], pa.array(x.reshape(-1).view("i8")))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].view("i8")), pa.array(keys[:, 1].view("i8")), lists(signatures), lists(bands)], ["doc_id", "n_shingles", "key_1", "key_2", "signature", "bands"])

    for batch in batches:
        ids, held, count, first = batch.column(0), [], 0, 0
        for k, s in enumerate(shingle_sets((x.as_py() for x in batch.column(1)), size)):
            held.append(s)
            count += len(s)
            if count > 60_000 or k + 1 == batch.num_rows:
                yield emit(ids.slice(first, len(held)), held)
                held, count, first = [], 0, k + 1


def sketch(docs: DataFrame, size: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _sketch(batches, size), f"doc_id {kind}, n_shingles long, key_1 long, key_2 long, signature array<long>, bands array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = list(shingle_sets((x.as_py() for x in part.column(1)), size))
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype("i4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view("i8")))], ["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"node {kind}, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal groups of bits, less those equal by chance."""

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(_LOW)))

    unequal = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As :func:`estimate`, for all rows of ``a`` against all rows of ``b``."""
    unequal = np.zeros((len(a), len(b)), dtype=np.uint16)
    for k in range(LONGS):
        z = a[:, k, None] ^ b[None, :, k]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        unequal += np.bitwise_count(z & np.uint64(_LOW))
    chance = 2.0**-BITS
    return ((1 - unequal / PERMUTATIONS) - chance) / (1 - chance)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _labelled(df: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    return df


def _links_between(left, right, percent: int) -> list[tuple[int, int]]:
    """Links that join different components of two blocks (nodes, components, signatures, shingles,
    bounds). Estimates choose the rows; their common shingles with every node of ``right`` are
    counted at once from an inverted index. A pair of components is reported once."""
    (n, c, s, flat, at), (n2, c2, s2, flat2, at2) = left, right
    order = np.argsort(flat2, kind="stable")
    sorted2, owner = flat2[order], np.repeat(np.arange(len(n2)), np.diff(at2))[order]
    size2, seen, out = np.diff(at2), set(), []
    for i in range(len(n)):
        near = (c2 != c[i]) & (estimates(s[i : i + 1], s2)[0] >= ESTIMATE)
        if not near.any():
            continue
        own = flat[at[i] : at[i + 1]]
        lo, hi = np.searchsorted(sorted2, own, "left"), np.searchsorted(sorted2, own, "right")
        lengths = hi - lo
        places = np.repeat(lo - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[places], minlength=len(n2))
        for j in np.flatnonzero(near & (100 * common >= percent * (len(own) + size2 - common))):
            key = (min(c[i], c2[j]), max(c[i], c2[j]))
            if key not in seen:
                seen.add(key)
                out.append((n[i], n2[j]))
    return out


def _block(column: pa.ListArray, k: int) -> tuple:
    """Row ``k``'s nodes, components, signatures, and if there are any, shingles and their bounds."""
    rows = column[k].values
    signature = rows.field("signature").flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
    out = rows.field("node").to_numpy(), rows.field("component").to_numpy(), signature
    if rows.type.num_fields == 3:
        return out
    flat = rows.field("shingles")
    return *out, flat.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(flat.value_lengths().to_numpy())))


def _blocks(nodes: DataFrame, outside: DataFrame, *columns: str) -> DataFrame:
    """Blocks of nodes of ``outside`` (a column node) beside blocks of all nodes of their family.

    A block's size is bounded in nodes and in shingles.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        total = df.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (128 * BLOCK)), F.lit(1)).alias("blocks"))
        dealt = df.join(total, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))
        return dealt.groupBy("family", "block").agg(F.collect_list(F.struct("node", "component", "signature", *columns)).alias(name)).select("family", name)

    both = packed(nodes.join(outside, "node", "left_semi"), "outside").join(packed(nodes, "inside"), "family").select("outside", "inside")
    return both.repartition(F.xxhash64(F.expr("outside[0].node"), F.expr("inside[0].node")))


def _looking_across(nodes: DataFrame, outside: DataFrame) -> DataFrame:
    """The nodes of ``outside`` whose signature looks similar enough to that of a node of another component."""
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (n, c, s), (_, c2, s2) = _block(batch.column(0), k), _block(batch.column(1), k)
                hit = np.zeros(len(n), dtype=bool)
                for at in range(0, len(n), 128):
                    hit[at : at + 128] = ((c[at : at + 128, None] != c2[None, :]) & (estimates(s[at : at + 128], s2) >= ESTIMATE)).any(1)
                yield pa.RecordBatch.from_arrays([pa.array(n[hit])], ["node"])

    return _blocks(nodes, outside).mapInArrow(run, f"node {kind}").distinct()


def _across(nodes: DataFrame, outside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links that join components, with an end in ``outside``, confirmed on full sets; a pair of
    components is reported once by each pair of blocks."""
    kind = nodes.schema["node"].dataType.simpleString()
    families = nodes.join(outside, "node", "left_semi").select("family").distinct()
    held = cut(nodes.join(families, "family", "left_semi").join(sets, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _links_between(_block(batch.column(0), k), _block(batch.column(1), k), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], batch.column(0).type.value_type.field("node").type) for i in (0, 1)], ["a", "b"])

    return _blocks(held, outside, "shingles").mapInArrow(run, f"a {kind}, b {kind}")


def _open(nodes: DataFrame, candidates: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of families with several components, and those outside their largest component.

    A family is what candidate links hold together; it is found on components, not on nodes. All
    links between components of a family have an end outside its largest one.
    """
    between = _labelled(candidates, labels, "a", "b").filter("a_in <> b_in").select(F.least("a_in", "b_in").alias("a"), F.greatest("a_in", "b_in").alias("b")).distinct()
    families = components(between).select(F.col("node").alias("component"), F.col("component").alias("family"))
    placed = nodes.select("node", "signature", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = cut(placed.join(families, "component"))
    counted = open_.groupBy("family", "component").agg(F.count("*").alias("m"))
    largest = counted.groupBy("family").agg(F.max_by("component", F.struct("m", -F.col("component"))).alias("component"))
    return open_, open_.join(largest, ["family", "component"], "left_anti").select("node")


def near_groups(docs: DataFrame, size: int, percent: int = SIMILARITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    sketches = cut(sketch(docs, size))
    some = sketches.filter("n_shingles > 0 and doc_id is not null")
    nodes = cut(some.groupBy("key_1", "key_2").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")))
    signatures = nodes.select("node", "signature")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("m")).filter("m > 1")
    candidates = cut(banded.join(groups, "band").filter("node <> b").select(F.col("node").alias("a"), "b").distinct())
    # The texts are exchanged once, whatever the number of candidates: sets of those are kept for both confirmations.
    ids = candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct()
    sets = cut(sets_of(docs.join(ids.hint("merge"), "doc_id", "left_semi"), size).dropDuplicates(["node"]))

    signed = candidates.join(signatures.toDF("a", "sa"), "a").join(signatures.toDF("b", "sb"), "b")
    pairs = signed.filter(estimate(F.col("sa"), F.col("sb")) >= ESTIMATE).select("a", "b")
    links = cut(confirm(pairs, sets, percent))
    labels = components(links)
    open_, outside = _open(nodes, candidates, labels)
    looking = cut(_looking_across(open_, outside))
    if not looking.isEmpty():
        labels = components(links.union(_across(open_, looking, sets, percent)))

    copies = nodes.select("key_1", "key_2", "node")
    found = sketches.select("doc_id", "n_shingles", "key_1", "key_2").join(copies, ["key_1", "key_2"], "left").join(labels, "node", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, size: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id."""
    gone = near_groups(docs, size, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), 4)


#: All links by an inverted index on the shingles themselves, components by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT * FROM s WHERE g IN (SELECT g FROM rare)),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(v, c) AS (
  SELECT a, a FROM e UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v WHERE reach.c < e.b),
m AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id,
       w.doc_id = coalesce(m.c, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.v = w.doc_id
"""

QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES = {"op6_near_dedup": ORACLE}
