"""Tokens, BM25 and sparse ranking over tables of texts.

Every text search reads and tokenizes the texts once: thin rows (id, length, counts of the query's
terms) are exchanged, and both the corpus statistics and the scores are taken from that exchange.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import apply_filter
from .ordering import numbered

#: Words that carry no meaning for ranking.
STOP_WORDS = (
    "the a an in on at is it its of for to and or but not with as by from that this was are be been have has had do did will "
    "would shall should may might can could there their they them which who whom whose where when"
).split()
K1, B, DEFAULT_AVERAGE = 1.5, 0.75, 100.0
#: A token of a lower-cased text: a whole run of letters and digits, two or more, and no stop word.
TOKEN = rf"(?<![a-z0-9])(?!(?:{'|'.join(STOP_WORDS)})(?![a-z0-9]))([a-z0-9]{{2,}}+)"
TINY = 1e-9


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, without stop words and single characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def query_tokens(query: str) -> list[str]:
    """As :func:`tokenize`, for a query."""
    return [t for t in re.findall(r"[a-z0-9]+", query.lower()) if len(t) > 1 and t not in STOP_WORDS]


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings: doc_id, term, tf, doc_len."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))
    terms = tokens.select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return terms.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", F.col("doc_len").cast("long"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def bm25_tf(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(average, F.lit(1.0))))


def _total(parts: list[Column]) -> Column:
    return sum(parts, F.lit(0.0))


def _runs(sorted_: str) -> Column:
    """Lengths of the runs of equal values in a sorted array column."""
    starts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
    whole = F.concat(starts, F.array(F.size(sorted_)))
    return F.when(F.size(sorted_) > 0, F.transform(starts, lambda s, k: F.get(whole, k + 1) - s)).otherwise(F.array().cast("array<int>"))


def _runs_of(df: DataFrame, source: str, into: str, values: str | None = None) -> DataFrame:
    """``df`` with the run lengths of a sorted array, and if asked for, the distinct values in their order."""
    out = df.withColumn(into, _runs(source))
    return out.withColumn(values, F.array_distinct(source)) if values else out


def sparse_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weight=None) -> DataFrame:
    """Stored sparse vectors: ``docs`` with terms, weights (parallel arrays) and norm; no shuffle.

    ``weight`` makes weights of (tf, doc_len); the default is the term's count.
    """
    rows = docs.withColumn("_sorted", F.sort_array(tokenize(F.col(text))))
    rows = _runs_of(rows, "_sorted", "_tf", "terms")
    each = (lambda tf: tf.cast("double")) if weight is None else (lambda tf: weight(tf, F.size("_sorted")))
    rows = rows.withColumn("weights", F.transform("_tf", each))
    length = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))
    return rows.withColumn("norm", F.when(length > TINY, length).otherwise(1.0)).drop("_sorted", "_tf")


def search_sparse_rows(rows: DataFrame, query: Mapping, top_k: int, filter_: Mapping | None = None, metadata: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Cosine of stored sparse vectors with ``query`` (term -> weight); the filter comes before the top k."""
    size = sum(w * w for w in query.values()) ** 0.5
    rows = apply_filter(rows, filter_, metadata)
    if size < TINY:
        return rows.select(F.col(doc_id), F.lit(0.0).alias("score")).limit(0)
    places = [(F.array_position("terms", F.lit(t)), w) for t, w in query.items()]
    hit = F.lit(False)
    for p, _ in places:
        hit = hit | (p > 0)
    dot = _total([F.when(p > 0, F.lit(float(w)) * F.get("weights", (p - 1).cast("int"))).otherwise(0.0) for p, w in places])
    scored = rows.filter(hit).select(F.col(doc_id), F.round(dot / (F.lit(size) * F.col("norm") + TINY), 6).alias("score"))
    return scored.orderBy(F.desc("score"), doc_id).limit(top_k)


def add_sparse(old: DataFrame, new: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Stored sparse vectors with those of ``new`` put in or replaced; empty vectors change nothing."""
    new = new.select(old.columns).filter(F.size("terms") > 0)
    return old.join(new.select(doc_id), doc_id, "left_anti").select(old.columns).unionByName(new)


def remove_sparse(old: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return old.join(ids.select(doc_id), doc_id, "left_anti").select(old.columns)


def sparse_size(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return rows.filter(F.size("terms") > 0).agg(F.count_distinct(doc_id).alias("size"))


# ---- texts and queries -------------------------------------------------------------------------


def _profile(docs: DataFrame, terms: list[str], doc_id: str, text: str, norms: bool = False) -> tuple[DataFrame, DataFrame]:
    """Thin rows (doc_id, doc_len, tf: a count for each term, and for norms, a histogram of all the
    counts in the text), exchanged once; and one row of totals from the same exchange.

    No filter may stand right above the exchange: the totals need all rows, and a filter that went
    below it would make it another exchange, and the texts be read twice.
    """
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    counts = F.array(*[F.regexp_count("_low", F.lit(rf"(?<![a-z0-9]){t}(?![a-z0-9])")) for t in terms]).cast("array<int>")
    if norms:
        rows = low.withColumn("tf", counts).withColumn("_sorted", F.sort_array(F.regexp_extract_all("_low", F.lit(TOKEN), F.lit(1))))
        rows = _runs_of(rows, "_sorted", "_tf").withColumn("doc_len", F.size("_sorted")).withColumn("_tf", F.sort_array("_tf"))
        rows = _runs_of(rows, "_tf", "_times", "_values")
        rows = rows.select("doc_id", "doc_len", "tf", F.arrays_zip(F.col("_values").alias("tf"), F.col("_times").alias("times")).alias("all_tf"))
    else:
        rows = low.select("doc_id", F.regexp_count("_low", F.lit(TOKEN)).alias("doc_len"), counts.alias("tf"))
    rows = rows.repartition("doc_id")
    every = F.count("doc_id") + F.sum(F.col("doc_id").isNull().cast("long"))  # reads all of the exchange's columns
    if norms:
        every = every + F.sum(F.when(F.col("all_tf").isNull(), 1).otherwise(0)) * 0
    total = rows.agg(every.alias("n"), F.count(F.when(F.col("doc_len") > 0, 1)).alias("some"), F.avg("doc_len").alias("average"), F.array(*[F.sum((F.get("tf", F.lit(i)) > 0).cast("long")) for i in range(len(terms))]).alias("df"))
    return rows, total


def _ranked(scored: DataFrame, top_k: int) -> DataFrame:
    found = scored.filter("_score > 0").select("doc_id", F.round("_score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(top_k)


def bm25_search(docs: DataFrame, query: str, top_k: int, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """Documents by the sum of idf * tf weights over the query's distinct terms.

    With ``every``, only documents that hold all of them.
    """
    terms = list(dict.fromkeys(query_tokens(query)))
    if not terms:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    rows, total = _profile(docs, terms, doc_id, text)
    at = lambda name, i: F.get(name, F.lit(i))
    score = _total([idf(F.col("n"), at("df", i)) * bm25_tf(at("tf", i), F.col("doc_len"), F.col("average")) for i in range(len(terms))])
    if every:
        score = F.when(F.array_min("tf") > 0, score).otherwise(0.0)
    return _ranked(rows.crossJoin(F.broadcast(total)).withColumn("_score", score), top_k)


def keyword_search(docs: DataFrame, query: str, limit: int = 500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold every term of the query, by BM25."""
    return bm25_search(docs, query, limit, doc_id, text, every=True)


def text_search(docs: DataFrame, query: str, top_k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cosine of the query's idf-weighted BM25 vector with the documents' BM25 vectors.

    Documents are weighted with the mean length of the corpus; terms that no document holds count
    in the query's norm.
    """
    tokens = query_tokens(query)
    terms = list(dict.fromkeys(tokens))
    if not terms:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    rows, total = _profile(docs, terms, doc_id, text, norms=True)
    mean = F.col("average") * F.col("n") / F.greatest(F.col("some"), F.lit(1))  # texts without tokens aren't in the index
    asked = total.withColumn("average", mean)
    weights = [idf(F.col("some"), F.get("df", F.lit(i))) * bm25_tf(F.lit(tokens.count(t)), F.lit(len(tokens)), F.col("average")) for i, t in enumerate(terms)]
    asked = asked.select("average", F.array(*weights).alias("asked"))
    asked = asked.withColumn("size", F.sqrt(F.aggregate("asked", F.lit(0.0), lambda a, w: a + w * w)))
    both = rows.crossJoin(F.broadcast(asked))
    dot = _total([F.get("asked", F.lit(i)) * F.when(F.get("tf", F.lit(i)) > 0, bm25_tf(F.get("tf", F.lit(i)), F.col("doc_len"), F.col("average"))).otherwise(0.0) for i in range(len(terms))])
    square = F.aggregate("all_tf", F.lit(0.0), lambda a, x: a + x["times"] * F.pow(bm25_tf(x["tf"], F.col("doc_len"), F.col("average")), 2))
    return _ranked(both.withColumn("_score", F.when(F.col("size") >= TINY, dot / (F.col("size") * F.sqrt(square) + TINY)).otherwise(0.0)), top_k)


def earlier_average(lengths: DataFrame, order: str, length: str = "doc_len") -> DataFrame:
    """The mean length of the documents added before each one (its own for the first)."""
    rows = numbered(lengths, order, name="_row", total=length)
    return rows.withColumn("average", F.when(F.col("_row") > 0, F.col("before") / F.col("_row")).otherwise(F.col(length).cast("double"))).drop("_row", "before")


def bm25_vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sparse documents: doc_id, term, weight (tf part only, corpus mean length)."""
    postings = term_counts(docs, doc_id, text)
    mean = docs.agg(F.avg(F.regexp_count(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN))).alias("average"))
    return postings.crossJoin(F.broadcast(mean)).select("doc_id", "term", bm25_tf(F.col("tf"), F.col("doc_len"), F.col("average")).alias("weight"))


def sparse_search(vectors: DataFrame, query: dict, top_k: int) -> DataFrame:
    """Cosine of sparse vectors as postings (doc_id, term, weight) with ``query`` (term -> weight).

    With a column ``norm`` in the postings, only those of the query's terms are exchanged; without
    it, all are, for the norms. Stored vectors are better kept as :func:`sparse_rows`.
    """
    spark = vectors.sparkSession
    size = sum(w * w for w in query.values()) ** 0.5
    if size < TINY:
        return vectors.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    asked = spark.createDataFrame([(k, float(v)) for k, v in query.items()], f"term {vectors.schema['term'].dataType.simpleString()}, asked double")
    dot = F.sum(F.col("weight") * F.col("asked")).alias("dot")
    if "norm" in vectors.columns:
        per_doc = vectors.join(F.broadcast(asked), "term").groupBy("doc_id").agg(dot, F.max("norm").alias("length"))
    else:
        per_doc = vectors.join(F.broadcast(asked), "term", "left").groupBy("doc_id").agg(dot, F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    scored = per_doc.filter(F.col("dot").isNotNull()).select("doc_id", F.round(F.col("dot") / (F.lit(size) * F.when(F.col("length") < TINY, 1.0).otherwise(F.col("length")) + TINY), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(top_k)
