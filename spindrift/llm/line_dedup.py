"""Line dedup: exact set-similarity join of lines, as DataFrame operations only.

A line is the set of its words. Of two lines whose sets have a Jaccard similarity of 80 % or more,
the later one goes (by document id, then line number; judged on the input, so a line goes if any
earlier line is that similar, whether that one stays or not). Lines without a word stay.

1.  Rarity: every word of the corpus is counted in one of 2**16 hashed counters. A token is a
    62-bit number, its counter's class (quarters of a power of two) above 55 bits of its hash: the
    natural order of tokens is by rarity. The counters' classes are the only thing that tasks
    get whole, as a constant of fixed size.
2.  Equal sets: the earliest of each stays and stands for all. Copies meet pre-aggregated.
3.  Prefix filter on pairs of tokens that are neighbours in that order. With a tokens of its own and b
    of the other's, a set of n keeps all such pairs but 2a + b, and 5a + 4b <= n if the two are similar:
    so of the first 2n/5 + 1 pairs one at least is among the other's first ones, and mostly more. Lines
    meet by such a pair, a key of 32 bits, under the length filter, and need as many common keys as
    follows from their sizes. Sets that differ in d tokens differ in d bits at most of a 64-bit parity
    of their tokens, so most unlike lines part right where they meet. Two rare words stand together in
    few unlike lines, so these meetings grow about as the lines do, where those by one word grew with
    the square of its frequency.
4.  Keys of very many lines: such families of similar lines don't meet pair by pair. Each of their lines
    is first held against the earliest line with that key; only lines that find no match there are the
    later side in step 3.
5.  A line goes if one earlier line is similar, so of each line's meetings only the one that differs in the
    fewest parity bits is kept, and confirmed on the words. Lines that are unlike it but met others meet
    all once more, and these pairs are confirmed, if they share the keys they need. So what is exchanged
    doesn't grow with the pairs of a group of similar lines. Only lines concerned are exchanged for it.

Defined results
    null or empty text      no lines with a word, nothing removed
    very long lines         one row's array; keys are two fifths of it
    null ids                order before all others; such rows aren't changed
    repeated rows           equal (id, line) places are one place: their lines don't remove each other
    empty table             an empty result
    extra columns           kept by ``dedup``
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WORD, drop, fresh, release_shuffles, table, text_or_empty

#: Tables of this module hold hashes and places, for which trying dictionaries is lost time.
cut = partial(common.cut, dictionary=False)
COUNTERS = 1 << 16
HASH_BITS = 55
#: Lines with one key from which they are a family (step 4).
FAMILY = 256
#: Keys of a task up to which one side of their join is a table in memory (some 64 bytes each) and not sorted.
HASHED = 1 << 19
#: Parts in which the keys are exchanged, one after the other, so that not all are on disk at once.
PASSES = 2
#: The most rows of 32,768 bits that tell which lines are to be confirmed: 16 MB.
MARKS = 4096
#: Closed lines up to which the rows are not written anew but joined with them wherever they are read.
CLOSED = 1 << 16
SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def _words(line: Column) -> Column:
    """The words of a line that has some. Splitting at single spaces is fast; other lines are cleaned first."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.split(F.when(odd, F.btrim(F.regexp_replace(line, SPACE, " "), F.lit(" "))).otherwise(line), " ")


def lines_of(docs: DataFrame) -> DataFrame:
    exploded = docs.select("doc_id", F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("line_no", "line"))
    return exploded.filter(F.ltrim("line", F.lit(WHITE)) != "")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with spaces for other white space, which few texts have, so that single spaces part the words."""
    other = WHITE.replace(" ", "").replace("\n", "")
    odd = reduce(Column.__or__, [F.col("text").contains(c) for c in other])
    return docs.withColumn("text", F.when(odd, F.translate("text", other, " " * len(other))).otherwise(F.col("text")))


def _counter(h: Column) -> Column:
    """The counter of a hash: its low bits, never null, so that arrays made with it are sorted as plain numbers."""
    return h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def _by_counter(hashes: DataFrame) -> list[int]:
    """How many of a column h fall on each counter, as one row of bounded size."""
    counts = hashes.groupBy(_counter(F.col("h")).alias("k")).agg(F.count("*").alias("n"))
    row = counts.agg(F.collect_list(F.struct("k", "n")).alias("c")).select("c.k", "c.n").first()
    out = [0] * COUNTERS
    for k, n in zip(row["k"] or (), row["n"] or (), strict=True):
        out[k] = n
    return out


def _constant(values: list[int]) -> Column:
    """Numbers as a constant array, which the optimizer makes of one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _entry(constant: Column, h: Column) -> Column:
    """A hash's number in a constant, never null, as in :func:`_counter`."""
    return F.coalesce(constant[h.bitwiseAND(F.lit(COUNTERS - 1))], F.lit(0).cast("long"))


def rarity(docs: DataFrame) -> Column:
    """The classes of all counters as a constant.

    Words are taken at single spaces and line ends here; where other white space stands, that only shifts the order.
    """
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).select(F.xxhash64("w").alias("h"))
    return _constant([min(int(4 * math.log2(max(n, 1))), 127) for n in _by_counter(words)])


def _tokens(line: Column, classes: Column) -> Column:
    """The tokens of a line of :func:`_plain` texts. What stands between two spaces is no word.

    Lambdas are interpreted node by node, so hashes are bound once, and nothing that whole arrays allow stands in them.
    """
    low = F.lit((1 << HASH_BITS) - 1)
    token = lambda h: F.shiftleft(_entry(classes, h), HASH_BITS).bitwiseOR(h.bitwiseAND(low))
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(F.sort_array(F.transform(hashes, token))), token(F.xxhash64(F.lit(""))))


def _least(n: Column, over: int, under: int) -> Column:
    """ceil(n * over / under) in integers."""
    return F.floor((n * over + (under - 1)) / F.lit(under)).cast("int")


def _parity(tokens: Column) -> Column:
    """64 bits, each whether an odd number of tokens falls on it."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))))


def _possible(n_x: Column, parity_x: Column, n_y: Column, parity_y: Column) -> Column:
    """Whether two sets can be similar, by their sizes and the bits in which they differ."""
    return (5 * F.least(n_x, n_y) >= 4 * F.greatest(n_x, n_y)) & (F.bit_count(parity_x.bitwiseXOR(parity_y)) <= n_x + n_y - 2 * _least(n_x + n_y, 4, 9))


def _keys(t: Column, n: Column) -> Column:
    """The first pairs of adjacent tokens, 32 bits each: one more than similar sets can differ in."""
    most = (2 * F.floor(n / F.lit(5)) + F.when(n % 5 == 4, 2).otherwise(1)).cast("int")
    return F.zip_with(F.slice(t, F.lit(1), most), F.slice(t, F.lit(2), most), lambda a, b: F.hash(a, b))


def _shared(n_x: Column, n_y: Column) -> Column:
    """How many of their first pairs two similar sets of these sizes share at least."""
    apart = F.floor((n_x + n_y) / F.lit(9))
    left = lambda n, d: 2 * F.floor(n / F.lit(5)) + F.when(n % 5 == 4, 2).otherwise(1) - F.floor((3 * apart + d) / F.lit(2))
    return F.greatest(F.lit(1), F.least(left(n_x, n_x - n_y), left(n_y, n_y - n_x))).cast("int")


def _marked(lines: DataFrame, places: DataFrame, count: int, by: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """Those of ``lines`` that fall on a bit with one of ``places``, by these columns: all of these, and few
    others as long as there are bits enough. The bits are a broadcast of 4 KB rows, MARKS of them at most."""
    rows = max(1, min(MARKS, -(-16 * count // 32768)))
    h = F.xxhash64(F.lit(2), *by)
    row, bit = F.pmod(F.shiftright(h, 15), F.lit(rows)).cast("int"), h.bitwiseAND(F.lit(32767))
    bits = places.select(row.alias("row"), bit.alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # As numbers of 8 bytes, the first one highest: what is done for each line is then only to look one up and shift it.
    half = lambda i, k: F.conv(F.hex(F.substring(F.col("bits"), 8 * i + k, F.lit(4))), 16, 10).cast("long")
    bits = bits.select("row", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.shiftleft(half(i, 1), 32).bitwiseOR(half(i, 5))).alias("bits"))
    of = F.call_function("shiftright", F.col("bits")[F.shiftright(bit, 6)], bit.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int"))
    return lines.withColumn("row", row).join(F.broadcast(bits), "row").filter(of.bitwiseAND(F.lit(1)) == 1).select(lines.columns)


def _confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs of places (later: doc_x, line_x, earlier: doc_y, line_y), the later places (doc_id,
    line_no) of those whose words are similar. Both joins read one exchange of the lines concerned.
    """
    places = pairs.select(F.col("doc_x").alias("doc_id"), F.col("line_x").alias("line_no")).union(pairs.select("doc_y", "line_y"))
    count = 2 * pairs.count()
    lines = _marked(lines_of(_marked(docs, places, count, ("doc_id",))), places, count)
    both = pairs.hint("merge").join(lines.toDF("doc_x", "line_x", "x"), ["doc_x", "line_x"])
    both = both.hint("merge").join(lines.toDF("doc_y", "line_y", "y"), ["doc_y", "line_y"])
    x, y = (F.array_distinct(_words(F.col(c))) for c in "xy")
    # Bound in lambdas: a filter on columns would evaluate their expressions anew wherever it names them.
    sizes = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda s: F.struct((F.size(s["x"]) + F.size(s["y"])).alias("both"), F.size(F.array_intersect(s["x"], s["y"])).alias("common")))
    similar = F.exists(sizes, lambda s: 5 * s["common"] >= 4 * (s["both"] - s["common"]))
    return both.filter(similar).select(F.col("doc_x").alias("doc_id"), F.col("line_x").alias("line_no")).distinct()


def _families(sets: DataFrame, docs: DataFrame) -> tuple[DataFrame | None, bool]:
    """Lines that are similar to the earliest line of a family (step 4), or None without families; whether a
    task's keys are few enough to meet in memory, by all keys and the counter with the most.

    A counter is looked at if it is a family above the mean, or above what chance puts on counters of
    that mean: so few are, however many keys there are. A family that isn't seen meets pair by pair.
    """
    keys = sets.select("at", "n", "parity", F.explode("prefix").alias("key"))
    counts = _by_counter(keys.select(F.col("key").alias("h")))
    few = sum(counts) / PASSES / int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")) + max(counts) <= HASHED
    mean = sum(counts) / COUNTERS
    least = mean + max(FAMILY, 6 * math.sqrt(mean))
    marks = [int(n > least) for n in counts]
    if not any(marks):
        return None, few
    hot = keys.filter(_entry(_constant(marks), F.col("key")) == 1)
    hubs = hot.groupBy("key").agg(F.min(F.struct("at", "n", "parity")).alias("hub"), F.count("*").alias("m")).filter(F.col("m") > FAMILY)
    met = hot.join(hubs, "key").filter((F.col("hub.at") < F.col("at")) & _possible(F.col("n"), F.col("parity"), F.col("hub.n"), F.col("hub.parity")))
    pairs = cut(met.select(F.col("at.doc_id").alias("doc_x"), F.col("at.line_no").alias("line_x"), F.col("hub.at.doc_id").alias("doc_y"), F.col("hub.at.line_no").alias("line_y")).distinct())
    found = None if pairs.isEmpty() else cut(_confirm(pairs, docs))
    drop(pairs)
    return found, few


def _line(code: Column) -> Column:
    return F.shiftright(code, 32).bitwiseAND(F.lit(2**31 - 1)).cast("int")


def _met(xs: DataFrame, ys: DataFrame, how: str = "merge") -> DataFrame:
    """Rows (doc_id, code, parity, key) of xs that are open and those of ys that are earlier and can be similar
    to them, by common keys, as places (doc_x, line_x, doc_y, line_y) with the keys that they need to share and
    the bits in which they differ."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n_x, n_y = (c(side, "code").bitwiseAND(F.lit(2**31 - 1)) for side in "xy")
    line_x, line_y = (_line(c(side, "code")) for side in "xy")
    earlier = (c("y", "doc_id") < c("x", "doc_id")) | ((c("y", "doc_id") == c("x", "doc_id")) & (line_y < line_x))
    # One exchange for both sides: what concerns one side alone stands in conditions on both, or it would be pushed below it.
    wanted = F.when(earlier, c("x", "code") >= 0).otherwise(F.lit(False))
    met = xs.alias("x").join(ys.alias("y").hint(how), (c("x", "key") == c("y", "key")) & _possible(n_x, c("x", "parity"), n_y, c("y", "parity")) & wanted)
    apart = F.bit_count(c("x", "parity").bitwiseXOR(c("y", "parity")))
    sides = [e.alias(f"{name}_{s}") for s, line in (("x", line_x), ("y", line_y)) for name, e in (("doc", c(s, "doc_id")), ("line", line))]
    return met.select(*sides, _shared(n_x, n_y).alias("need"), apart.alias("apart"))


def _nearest(rows: DataFrame, few: bool) -> DataFrame:
    """For each open line that meets an earlier one that can be similar: the one that differs in the fewest
    bits, and whether there are others. Lines that share fewer keys with all earlier ones together than with
    a similar one are none of these. A row for each line and task is all that is exchanged, however many
    lines meet. The keys are exchanged in PASSES parts, one after the other."""
    rows = rows.select("doc_id", "code", "parity", F.explode("prefix").alias("key"))
    nearest = [F.min_by(c, "far").alias(c) for c in ("doc_y", "line_y")]
    lowest = [F.min(c).alias(c) for c in ("far", "need", "doc_low", "line_low")] + [F.max(c).alias(c) for c in ("doc_high", "line_high")]
    least = lambda found: found.groupBy("doc_x", "line_x").agg(*nearest, *lowest, F.sum("shared").alias("shared"))
    far = F.shiftleft(F.col("apart").cast("long"), 32).bitwiseOR(F.hash("doc_y", "line_y").bitwiseAND(F.lit(2**31 - 1)))
    ends = {f"{name}_{end}": F.col(f"{name}_y") for name in ("doc", "line") for end in ("low", "high")}
    parts = []
    for k in range(PASSES):
        part = rows.filter(F.pmod("key", F.lit(PASSES)) == k)
        parts.append(cut(least(_met(part, part, "shuffle_hash" if few else "merge").withColumns({"far": far, "shared": F.lit(1)} | ends))))
        release_shuffles(rows.sparkSession)
    several = (F.col("doc_low") != F.col("doc_high")) | (F.col("line_low") != F.col("line_high"))
    found = least(reduce(DataFrame.union, parts)).filter("shared >= need")
    pairs = cut(found.select("doc_x", "line_x", "doc_y", "line_y", several.alias("several")))
    drop(*parts)
    return pairs


def _pairs(rows: DataFrame, left: DataFrame) -> DataFrame:
    """All candidates of the lines ``left`` (doc_id, line_no). Of the other lines' keys only those on a bit
    with one of theirs are exchanged."""
    rows = rows.select("doc_id", _line(F.col("code")).alias("line_no"), "code", "parity", "prefix")
    mine = _marked(rows, left, left.count()).hint("merge").join(left, ["doc_id", "line_no"])
    names = ["doc_id", "code", "parity", "key"]
    mine = cut(mine.withColumn("key", F.explode("prefix")).select(names))
    others = _marked(rows.withColumn("key", F.explode("prefix")).select(names), mine, mine.count(), ("key",))
    names = [f"{name}_{s}" for s in "xy" for name in ("doc", "line")]
    met = _met(mine, others).groupBy(*names, "need").agg(F.count("*").alias("shared"))
    pairs = cut(met.filter("shared >= need").select(names))
    drop(mine)
    return pairs


def _similar(rows: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """Places (doc_id, line_no) of open ``rows``: doc_id, code (sign: not open; line number; size), parity,
    prefix, that are similar to an earlier one. Most are similar to the nearest; those that aren't and met others meet all once more."""
    nearest = _nearest(rows, few)
    found = cut(_confirm(nearest.drop("several"), docs))
    left = cut(nearest.filter("several").select(F.col("doc_x").alias("doc_id"), F.col("line_x").alias("line_no")).join(found, ["doc_id", "line_no"], "left_anti"))
    drop(nearest)
    release_shuffles(rows.sparkSession)
    if not left.isEmpty():
        pairs = _pairs(rows, left)
        found = found.union(cut(_confirm(pairs, docs)))
        drop(pairs)
    drop(left)
    return found


def removed_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (doc_id, line_no), and those of them that go."""
    docs = docs.select("doc_id", "text")
    known = docs.filter(F.col("doc_id").isNotNull())
    tokens = lines_of(_plain(known)).select("doc_id", "line_no", _tokens(F.col("line"), rarity(known)).alias("t")).withColumn("n", F.size("t"))
    prefix = F.when(F.col("n") > 3, _keys(F.col("t"), F.col("n")))  # up to 3: only equal sets are similar
    lines = cut(tokens.select(F.struct("doc_id", "line_no").alias("at"), "n", F.xxhash64("t").alias("set_1"), F.xxhash64(F.lit(1), "t").alias("set_2"), _parity(F.col("t")).alias("parity"), prefix.alias("prefix")))

    firsts = lines.groupBy("set_1", "set_2").agg(F.min(F.struct("at", "n", "parity", "prefix")).alias("first"), F.count("*").alias("copies"))
    sets = cut(firsts.select("set_1", "set_2", "first.*", "copies"))
    release_shuffles(docs.sparkSession)
    copied = sets.filter("copies > 1").select("set_1", "set_2", F.col("at").alias("first"))
    repeated = cut(lines.select("at", "set_1", "set_2").join(copied, ["set_1", "set_2"]).filter("at <> first").select("at.doc_id", "at.line_no").distinct())
    places = cut(lines.select("at.doc_id", "at.line_no"))
    drop(lines)

    similar = sets.filter("n > 3")
    matched, few_keys = _families(similar, known)
    release_shuffles(docs.sparkSession)
    code = F.shiftleft(F.col("at.line_no").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    rows = similar.select("at.doc_id", F.col("at.line_no").alias("line_no"), code.alias("code"), "parity", "prefix")
    if matched is not None:
        closed = F.when(F.col("closed"), F.lit(-(2**63))).otherwise(F.lit(0).cast("long"))
        few = matched.count() <= CLOSED
        mine = matched.withColumn("closed", F.lit(True))
        rows = rows.join(F.broadcast(mine) if few else mine, ["doc_id", "line_no"], "left").withColumn("code", F.col("code").bitwiseOR(closed))
        rows = rows.select("doc_id", "code", "parity", "prefix")
        if not few:
            sets, old = cut(rows), sets
            rows = sets
            drop(old)
            release_shuffles(docs.sparkSession)
    removed = repeated.union(_similar(rows, known, few_keys))
    drop(sets)
    if matched is not None:
        removed = removed.union(matched)
    release_shuffles(docs.sparkSession)
    return places, removed.distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go; documents of which no word is left go too."""
    _, gone = removed_lines(docs)
    name = fresh(docs, "gone_lines")
    per_doc = gone.groupBy("doc_id").agg(F.collect_list("line_no").alias(name))
    rows = docs.join(per_doc, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(name, i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(kept))
    return rows.filter(F.col(name).isNull() | F.col("text").rlike(WORD)).select(docs.columns)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines, gone = removed_lines(docs)
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    removed = gone.groupBy("doc_id").agg(F.count("*").alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("removed"))
    out = docs.select("doc_id").join(counted, "doc_id", "left").join(removed, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_removed")), F.coalesce("removed", F.lit("")).alias("removed"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, list_distinct(regexp_extract_all(x.l[i], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) x, unnest(range(1, len(x.l) + 1)) u(i)
  WHERE regexp_matches(x.l[i], '[^\x20\x09-\x0D]')),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS r, len(w) AS n FROM l),
t AS (SELECT r, n, unnest(w) AS w FROM k),
f AS (SELECT w, count(*) AS f FROM t GROUP BY w),
o AS (SELECT r, n, w, row_number() OVER (PARTITION BY r ORDER BY f, w) AS p FROM t JOIN f USING (w)),
p AS (SELECT * FROM o WHERE p <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (
  SELECT DISTINCT x.r AS a, y.r AS b FROM p x JOIN p y ON x.w = y.w AND x.r < y.r AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
s AS (
  SELECT DISTINCT b FROM c JOIN k ka ON ka.r = a JOIN k kb ON kb.r = b, LATERAL (SELECT len(list_intersect(ka.w, kb.w)) AS i) z
  WHERE 5 * i >= 4 * (ka.n + kb.n - i)),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(s.b) AS n_removed,
         coalesce(string_agg(CASE WHEN s.b IS NOT NULL THEN line_no END::VARCHAR, ',' ORDER BY line_no), '') AS removed
  FROM k LEFT JOIN s ON s.b = k.r GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": ORACLE}
