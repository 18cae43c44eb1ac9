"""Quality rules: a threshold table compiled into one Spark projection, no user functions.

``measure`` adds one struct of counts to a table of texts, ``verdict`` compiles a threshold
table over these counts into one boolean expression. Both are plain column expressions, so a
filter on them is one scan without a shuffle, and any lost task is simply run again.

Defined results
    null or empty text      all counts 0, base fails, not kept
    very long text          one row's arrays only; work grows as n log n with its words
    repeated rows, ties     every row is judged alone; duplicates get equal results
    empty table             an empty result
    clashing extra columns  ``measure`` picks a name that the table does not use
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, table, text_or_empty

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that was for on are with as it by be this from at or not have an "
    "der die das und ist nicht ein eine zu von mit den auf für im des sich auch "
    "le la les de des et un une est que dans qui pour pas sur par du au "
    "el los las del y en por con una para se su lo como más o"
).split()

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts and the closed range in which a text is kept."""

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None


#: The thresholds; they hold for texts that pass the base rules (20 words at least).
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2.0, high=18.0),
    Rule("symbols per word", "n_symbols", "n_words", high=0.3),
    Rule("stop words", "n_stop_words", "n_words", low=0.02),
    Rule("shouted words", "n_shouted", "n_words", high=0.3),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("repeated words", "n_repeat_words", "n_words", high=0.3),
)


def compile_rules(rules, counts: Column) -> Column:
    """One boolean expression; a ratio with nothing under it passes."""
    kept = F.lit(True)
    for rule in rules:
        over, under = counts[rule.over].cast("double"), counts[rule.under].cast("double")
        if rule.low is not None:
            kept = kept & (over >= under * F.lit(rule.low))
        if rule.high is not None:
            kept = kept & (over <= under * F.lit(rule.high))
    return kept


def measure(df: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, str]:
    """``df`` with a struct of counts, and the struct's name.

    The steps are separate projections, so what several counts use (the words, the window
    hashes) is computed once a row. A window is known by the 64-bit hash of its words.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    counts, words_, lines_, hashes_, pairs_, starts_ = (fresh(df, f"quality_{x}") for x in ("counts", "words", "lines", "hashes", "pairs", "starts"))
    whole = text_or_empty(text)
    words, lines, hashes, pairs, starts = map(F.col, (words_, lines_, hashes_, pairs_, starts_))
    trimmed = F.btrim(whole, F.lit(" \t\n\x0b\f\r"))

    df = df.withColumns(
        {
            words_: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
            lines_: F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD)),
        }
    )
    n = F.size(words)
    df = df.withColumns(
        {
            counts: F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.regexp_count(whole, F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")).cast("long").alias("n_shouted"),
            ),
            hashes_: F.transform(words, lambda w: F.xxhash64(w)),
        }
    )
    # Hashes of 1, 2, 4, ... words from each word on; a window is a power of two.
    for step in (2**k for k in range(window.bit_length() - 1)):
        later = F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0)))
        df = df.withColumn(hashes_, F.zip_with(F.slice(hashes, 1, F.size(later)), later, lambda a, b: F.xxhash64(a, b)))
    # Windows sorted by hash; only texts in which one occurs twice pay for it.
    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn(pairs_, F.when(twice, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # Starts of windows with an equal neighbour, in text order.
    equal = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
    df = df.withColumn(starts_, F.sort_array(F.transform(F.filter(pairs, lambda p, k: equal(p, k - 1) | equal(p, k + 1)), lambda p: p["i"])))
    # Each covers the words up to the next such start, a window at most.
    covered = F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    df = df.withColumn(counts, F.col(counts).withField("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")))
    return df.drop(words_, lines_, hashes_, pairs_, starts_), counts


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def judge(df: DataFrame, text: str = "text", rules=RULES) -> tuple[DataFrame, str, Column, Column]:
    """``df`` with its counts; the name of the struct, whether the base fails, whether it is kept."""
    df, name = measure(df, text)
    counts = F.col(name)
    failed = base_failed(counts)
    return df, name, failed, ~failed & compile_rules(rules, counts)


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that the rules keep, with the columns they came with.

    A filter on the verdict alone would be pushed below the projections, which repeats each step's
    expression in the next one, many times over. Beside a non-deterministic column it stays above.
    """
    df, name, _, kept = judge(df, text, rules)
    verdict, part = fresh(df, "quality_kept"), fresh(df, "quality_part")
    df = df.withColumns({verdict: kept, part: F.spark_partition_id()})
    return df.filter(F.col(verdict) & (F.col(part) >= 0)).drop(name, verdict, part)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    df, name, failed, kept = judge(df)
    c = F.col(name)
    return df.select(
        "doc_id",
        *(c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        kept.alias("kept"),
        *(c[x].alias(x) for x in ("n_lines", "n_stop_words", "n_shouted")),
    )


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: The same counts by other means: windows by their words, covered words one by one.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT rowid_, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, w FROM d) x, unnest(range(1, len(w) - {WINDOW - 2})) u(i)),
hit AS (
  SELECT rowid_, i FROM g QUALIFY count(*) OVER (PARTITION BY rowid_, win) >= 2),
rep AS (
  SELECT rowid_, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, {WINDOW})) u(k) GROUP BY rowid_),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
         len(list_filter(regexp_extract_all(t, '\p{{L}}+'), lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}')))::BIGINT AS n_shouted
  FROM (SELECT row_number() OVER () AS rowid_, * FROM d) x LEFT JOIN rep USING (rowid_)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 18.0 * n_words
       AND n_symbols <= 0.3 * n_words AND n_stop_words >= 0.02 * n_words AND n_shouted <= 0.3 * n_words
       AND n_dup_lines <= 0.5 * n_lines AND n_repeat_words <= 0.3 * n_words AS kept,
       n_lines, n_stop_words, n_shouted
FROM b
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": ORACLE}
