"""Named queries over the shared tables, each with SQL that must give the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import distances as D
from ..functions import keys
from ..functions import text as T
from ..functions.filters import apply_filter
from ..operators import fusion, partitioned, quantize, rerank, search
from ..session import scratch_dir
from ..sources import collection as C
from ..streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_V = "embedding::DOUBLE[]"
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_MANHATTAN = "list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
_SQL_SCORE = {
    "cosine": f"list_cosine_similarity({_V}, {_Q})",
    "dot": f"list_inner_product({_V}, {_Q})",
    "euclidean": f"list_distance({_V}, {_Q})",
    "manhattan": _MANHATTAN.format(a=_V, b=_Q),
}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stored(spark, sf, vec_id: int = 0) -> list[float]:
    row = _table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


# ---- nearest neighbours ------------------------------------------------------------------------


def _knn(metric: str):
    def run(spark, sf):
        vectors = _table(spark, sf, "embeddings")
        return search.knn(vectors, _stored(spark, sf), 10, metric).select("vec_id", "label", "score")

    order = "DESC" if D.larger_is_better(metric) else "ASC"
    query(f"knn_{metric}", f"SELECT vec_id, label, round({_SQL_SCORE[metric]}, 6) AS score FROM embeddings ORDER BY score {order}, vec_id LIMIT 10")(run)


for _metric in _SQL_SCORE:
    _knn(_metric)


@query("knn_filtered", f"SELECT vec_id, label, round({_SQL_SCORE['cosine']}, 6) AS score FROM embeddings WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    return search.knn(_table(spark, sf, "embeddings"), _stored(spark, sf), 10, filter_={"label": {"$in": [1, 3, 5]}}).select("vec_id", "label", "score")


@query("knn_threshold", f"SELECT vec_id, round({_SQL_SCORE['cosine']}, 6) AS score FROM embeddings WHERE round({_SQL_SCORE['cosine']}, 6) >= 0.1 ORDER BY score DESC, vec_id LIMIT 50")
def _(spark, sf):
    return search.knn(_table(spark, sf, "embeddings"), _stored(spark, sf), 50, threshold=0.1).select("vec_id", "score")


@query("knn_distance_threshold", f"SELECT vec_id, round({_SQL_SCORE['euclidean']}, 6) AS score FROM embeddings WHERE round({_SQL_SCORE['euclidean']}, 6) <= 1.3 ORDER BY score, vec_id LIMIT 50")
def _(spark, sf):
    return search.knn(_table(spark, sf, "embeddings"), _stored(spark, sf), 50, "l2", threshold=1.3).select("vec_id", "score")


@query("knn_by_id", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY score DESC, e.vec_id LIMIT 10")
def _(spark, sf):
    return search.knn_by_id(_table(spark, sf, "embeddings"), 7, 10).select("vec_id", "score")


_BATCH_SQL = """
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10"""


@query("knn_batch", _BATCH_SQL)
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.knn_batch(queries, vectors, 10)


def _pairwise(name: str, sql: str):
    """Every 50th row against all rows."""

    def run(spark, sf):
        vectors = _table(spark, sf, "embeddings")
        xs = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("x_id"), F.col("embedding").alias("x"))
        ys = vectors.select(F.col("vec_id").alias("y_id"), F.col("embedding").alias("y"))
        return D.pairwise_distances(xs, ys, name, "x", "y").select("x_id", "y_id", F.round("distance", 6).alias("distance"))

    suffix = "matrix" if name == "manhattan" else name
    query(f"pairwise_{suffix}", f"SELECT x.vec_id AS x_id, y.vec_id AS y_id, round({sql}, 6) AS distance FROM embeddings x, embeddings y WHERE x.vec_id % 50 = 0")(run)


_XY = {"a": "x.embedding::DOUBLE[]", "b": "y.embedding::DOUBLE[]"}
_pairwise("manhattan", _MANHATTAN.format(**_XY))
_pairwise("cosine", "1 - list_cosine_similarity({a}, {b})".format(**_XY))
_pairwise("euclidean", "list_distance({a}, {b})".format(**_XY))
_pairwise("dot", "-list_inner_product({a}, {b})".format(**_XY))


@query("sql_functions", f"SELECT vec_id, round(list_cosine_similarity({_V}, {_Q}), 6) AS cosine, round(list_distance({_V}, {_Q}), 6) AS l2, round({_MANHATTAN.format(a=_V, b=_Q)}, 6) AS l1 FROM embeddings")
def _(spark, sf):
    D.register(spark)
    _table(spark, sf, "embeddings").createOrReplaceTempView("_vectors")
    return spark.sql("""
        WITH v AS (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM _vectors), q AS (SELECT v AS q FROM v WHERE vec_id = 0)
        SELECT vec_id, round(cosine_similarity(v, q), 6) AS cosine, round(euclidean_distance(v, q), 6) AS l2, round(manhattan_distance(v, q), 6) AS l1
        FROM v CROSS JOIN q""")


@query("normalize", f"SELECT vec_id, round(sqrt(list_sum(list_transform({_V}, lambda x: (2 * x) * (2 * x)))), 6) AS before, 1.0::DOUBLE AS after FROM embeddings")
def _(spark, sf):
    doubled = _table(spark, sf, "embeddings").select("vec_id", F.transform(D.doubles(F.col("embedding")), lambda x: 2 * x).alias("v"))
    return doubled.select("vec_id", F.round(D.norm(F.col("v")), 6).alias("before"), F.round(D.norm(D.normalize(F.col("v"))), 6).alias("after"))


_RESCORE = f"""
WITH dims AS (SELECT vec_id, u.i - 1 AS pos, embedding[u.i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) u(i)),
m AS (SELECT pos, greatest(max(abs(x)), 1e-8) / 127 AS scale FROM dims GROUP BY pos),
q AS (SELECT pos, x FROM dims WHERE vec_id = 0),
s AS (SELECT vec_id, sum(greatest(-128, least(127, round_even(dims.x / scale, 0))) * scale * q.x) AS rough FROM dims JOIN m USING (pos) JOIN q USING (pos) GROUP BY vec_id),
c AS (SELECT vec_id FROM s ORDER BY round(rough, 9) DESC, vec_id LIMIT 100)
SELECT vec_id, round({_SQL_SCORE['dot']}, 6) AS score FROM embeddings WHERE vec_id IN (SELECT vec_id FROM c) ORDER BY score DESC, vec_id LIMIT 10"""


@query("rescore", _RESCORE)
def _(spark, sf):
    """Candidates from the int8 codes of all rows, the best of them by their exact score."""
    vectors, asked = _table(spark, sf, "embeddings"), _stored(spark, sf)
    scored = quantize.quantized_dot(quantize.encode_scalar(vectors, quantize.fit_scalar(vectors)), asked)
    candidates = scored.orderBy(F.desc(F.round("score", 9)), "vec_id").limit(100).select("vec_id")
    return search.rescore(F.broadcast(candidates), vectors, asked, 10)


# ---- metadata ----------------------------------------------------------------------------------

_K = "(props->>'$.k')::DOUBLE"
_FILTERS = {
    "eq": ({"k": 42}, f"coalesce({_K} = 42, false)"),
    "ne": ({"k": {"$ne": 42}}, f"NOT coalesce({_K} = 42, false)"),
    "range": ({"k": {"$gte": 10, "$lt": 20}}, f"coalesce({_K} >= 10, false) AND coalesce({_K} < 20, false)"),
    "gt_lte": ({"value": {"$gt": 20.0, "$lte": 60.0}}, "value > 20 AND value <= 60"),
    "in": ({"k": {"$in": [1, 2, 3]}}, f"coalesce({_K} IN (1, 2, 3), false)"),
    "nin": ({"k": {"$nin": [1, 2, 3]}}, f"NOT coalesce({_K} IN (1, 2, 3), false)"),
    "in_empty": ({"k": {"$in": []}}, "false"),
    "nin_empty": ({"k": {"$nin": []}}, "true"),
    "null_target": ({"missing": None}, "true"),
    "regex": ({"event_type": {"$regex": "^c"}}, "regexp_matches(event_type, '^c')"),
    "exists": ({"k": {"$exists": True}, "missing": {"$exists": False}}, "json_exists(props, '$.k')"),
    "and": ({"$and": [{"k": {"$gt": 50}}, {"event_type": "click"}]}, f"coalesce({_K} > 50, false) AND event_type = 'click'"),
    "or": ({"$or": [{"k": {"$lt": 5}}, {"event_type": "view"}], "user_id": {"$lt": 500}}, f"(coalesce({_K} < 5, false) OR event_type = 'view') AND user_id < 500"),
    "not": ({"$not": {"missing": {"$gt": 5}}, "k": {"$lt": 50}}, f"coalesce({_K} < 50, false)"),
}


def _filter(name: str, filter_: dict, sql: str):
    def run(spark, sf):
        return apply_filter(_table(spark, sf, "events"), filter_, "props").select("event_id", "event_type", "value")

    query(f"filter_{name}", f"SELECT event_id, event_type, value FROM events WHERE {sql}")(run)


for _name, (_spec, _sql) in _FILTERS.items():
    _filter(_name, _spec, _sql)


@query("count_filtered", f"SELECT count(*) AS n FROM events WHERE coalesce({_K} < 10, false)")
def _(spark, sf):
    return apply_filter(_table(spark, sf, "events"), {"k": {"$lt": 10}}, "props").agg(F.count("*").alias("n"))


@query("facets", "SELECT props->>'$.k' AS value, count(*) AS count FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 100")
def _(spark, sf):
    return C.facets(_table(spark, sf, "events"), F.try_variant_get(F.try_parse_json("props"), "$.k", "string"))


@query("facets_documents", "SELECT source AS value, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 100")
def _(spark, sf):
    return C.facets(_table(spark, sf, "documents"), F.col("source"))


@query("scroll_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def _(spark, sf):
    return C.scroll(_table(spark, sf, "events").select("event_id", "ts"), 50, 100, "ts", "event_id")


@query("scroll_filtered", "SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def _(spark, sf):
    return C.scroll(_table(spark, sf, "events").select("event_id", "ts", "event_type"), 50, 10, "ts", "event_id", {"event_type": "click"}).select("event_id", "ts")


@query("scroll_total", "SELECT count(*) AS total FROM events WHERE event_type = 'click'")
def _(spark, sf):
    return C.scroll_total(_table(spark, sf, "events"), {"event_type": "click"})


@query("key_fetch", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    """A table of keys of any length."""
    return C.fetch(_table(spark, sf, "embeddings").select("vec_id", "label"), _table(spark, sf, "orders").select(F.col("o_custkey").alias("vec_id")), "vec_id")


@query("masked_names", "SELECT c_custkey, left(c_name, 8) || '…' AS masked FROM customer")
def _(spark, sf):
    return _table(spark, sf, "customer").select("c_custkey", keys.masked(F.col("c_name")).alias("masked"))


@query("vector_keys")
def _(spark, sf):
    return _table(spark, sf, "embeddings").select("vec_id", keys.vector_key(F.col("embedding")).alias("key"))


@query("point_lookup", "SELECT vec_id, label FROM embeddings WHERE vec_id = 5")
def _(spark, sf):
    return C.fetch(_table(spark, sf, "embeddings"), [5], "vec_id").select("vec_id", "label")


@query("multi_fetch", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (1, 5, 9, 400)")
def _(spark, sf):
    return C.fetch(_table(spark, sf, "embeddings"), [1, 5, 9, 400], "vec_id").select("vec_id", "label")


# ---- text --------------------------------------------------------------------------------------

#: The SQL's own list of words without meaning for ranking.
_STOP = (
    "'the', 'a', 'an', 'in', 'on', 'at', 'is', 'it', 'its', 'of', 'for', 'to', 'and', 'or', 'but', 'not', 'with', 'as', 'by', 'from', "
    "'that', 'this', 'was', 'are', 'be', 'been', 'have', 'has', 'had', 'do', 'did', 'will', 'would', 'shall', 'should', 'may', 'might', "
    "'can', 'could', 'there', 'their', 'they', 'them', 'which', 'who', 'whom', 'whose', 'where', 'when'"
)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
_QUERY = "ering tion able heit"
_BM25 = f"""
WITH tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
l AS (SELECT count(*) AS n, avg(len(w)) AS average FROM tok),
q AS (SELECT DISTINCT unnest(string_split('{_QUERY}', ' ')) AS term),
h AS (SELECT doc_id, len(w) AS doc_len, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM tok) JOIN q USING (term) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT doc_id, round(sum(greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / greatest(average, 1)))), 6) AS score
      FROM h JOIN d USING (term), l GROUP BY doc_id)"""


@query("tokenize_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def _(spark, sf):
    return _table(spark, sf, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("bm25_search", _BM25 + " SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def _(spark, sf):
    return T.bm25_search(_table(spark, sf, "documents"), _QUERY, 20)


@query("keyword_search", _BM25.replace(_QUERY, "the ering") + f" SELECT doc_id, score FROM s JOIN tok USING (doc_id) WHERE list_contains(w, 'ering') ORDER BY score DESC, doc_id LIMIT 500")
def _(spark, sf):
    return T.keyword_search(_table(spark, sf, "documents"), "the ering")


@query("keyword_search_all_terms", _BM25.replace(_QUERY, "ering tion") + f" SELECT doc_id, score FROM s JOIN tok USING (doc_id) WHERE list_contains(w, 'ering') AND list_contains(w, 'tion') ORDER BY score DESC, doc_id LIMIT 500")
def _(spark, sf):
    return T.keyword_search(_table(spark, sf, "documents"), "ering tion")


@query(
    "bm25_weights",
    f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents), l AS (SELECT avg(len(w)) AS average FROM tok),
    h AS (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM tok), t AS (SELECT doc_id, doc_len, term, count(*) AS tf FROM h GROUP BY ALL)
    SELECT doc_id, count(*) AS terms, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / greatest(average, 1)))), 4) AS weight FROM t, l GROUP BY doc_id""",
)
def _(spark, sf):
    vectors = T.bm25_vectors(_table(spark, sf, "documents"))
    return vectors.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    "sparse_search",
    f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), v AS (SELECT doc_id, term, count(*)::DOUBLE AS weight FROM t GROUP BY ALL),
    q AS (SELECT * FROM (VALUES ('ering', 2.0), ('tion', 1.0)) q(term, asked))
    SELECT doc_id, round(sum(weight * asked) / (sqrt(5.0) * sqrt(sum(weight * weight)) + 1e-9), 6) AS score
    FROM v LEFT JOIN q USING (term) GROUP BY doc_id HAVING sum(weight * asked) IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20""",
)
def _(spark, sf):
    return T.search_sparse_rows(T.sparse_rows(_table(spark, sf, "documents")), {"ering": 2.0, "tion": 1.0}, 20)


@query(
    "sparse_collection_search",
    f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE lang = 'en'), v AS (SELECT doc_id, term, count(*)::DOUBLE AS weight FROM t GROUP BY ALL),
    q AS (SELECT * FROM (VALUES ('ering', 2.0), ('tion', 1.0)) q(term, asked))
    SELECT doc_id, round(sum(weight * asked) / (sqrt(5.0) * sqrt(sum(weight * weight)) + 1e-9), 6) AS score
    FROM v LEFT JOIN q USING (term) GROUP BY doc_id HAVING sum(weight * asked) IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20""",
)
def _(spark, sf):
    """Stored sparse vectors beside metadata, under a filter."""
    return T.search_sparse_rows(T.sparse_rows(_table(spark, sf, "documents")), {"ering": 2.0, "tion": 1.0}, 20, {"lang": "en"})


@query("sparse_postings", f"SELECT doc_id, len(list_distinct(w)) AS terms, len(w) AS length FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def _(spark, sf):
    rows = T.sparse_rows(_table(spark, sf, "documents"))
    return rows.select("doc_id", F.size("terms").cast("long").alias("terms"), F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).cast("long").alias("length"))


_TEXT_COSINE = f"""
WITH tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
l AS (SELECT count(*) FILTER (len(w) > 0) AS n, avg(len(w)) FILTER (len(w) > 0) AS average FROM tok),
t AS (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM tok),
v AS (SELECT doc_id, term, any_value(doc_len) AS doc_len, count(*) AS tf FROM t GROUP BY doc_id, term),
x AS (SELECT doc_id, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / greatest(average, 1))) AS weight FROM v, l),
a AS (SELECT term, count(*) AS tf FROM (SELECT unnest(['ering', 'tion', 'ering', 'zzqx']) AS term) GROUP BY term),
q AS (SELECT a.term, greatest(0, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) * a.tf * 2.5 / (a.tf + 1.5 * (0.25 + 0.75 * 4 / greatest(average, 1))) AS asked
      FROM a LEFT JOIN (SELECT term, count(*) AS df FROM v GROUP BY term) d ON d.term = a.term, l),
z AS (SELECT sqrt(sum(asked * asked)) AS size FROM q)
SELECT doc_id, round(sum(weight * asked) / (any_value(size) * sqrt(sum(weight * weight)) + 1e-9), 6) AS score
FROM x LEFT JOIN q USING (term), z GROUP BY doc_id HAVING sum(weight * asked) > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query("text_search", _TEXT_COSINE)
def _(spark, sf):
    return T.text_search(_table(spark, sf, "documents"), "ering the tion ering zzqx", 20)


@query("earlier_average", f"SELECT doc_id, round(coalesce(avg(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n), 6) AS average FROM (SELECT doc_id, len({_TOKENS}) AS n FROM documents)")
def _(spark, sf):
    lengths = _table(spark, sf, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).alias("doc_len"))
    return T.earlier_average(lengths, "doc_id").select("doc_id", F.round("average", 6).alias("average"))


# ---- fusion ------------------------------------------------------------------------------------

_DENSE = f"dense AS (SELECT vec_id AS id, round({_SQL_SCORE['cosine']}, 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 100)"
_LISTS = _BM25 + f", {_DENSE}, words AS (SELECT doc_id AS id, score FROM s ORDER BY score DESC, doc_id LIMIT 100)"


def _lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    dense = search.knn(_table(spark, sf, "embeddings"), _stored(spark, sf), 100).select(F.col("vec_id").alias("id"), "score")
    words = T.bm25_search(_table(spark, sf, "documents"), _QUERY, 100).select(F.col("doc_id").alias("id"), "score")
    return dense, words


_RRF = """, u AS (
  SELECT id, {a} / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM dense
  UNION ALL SELECT id, {b} / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM words)
SELECT id, round(sum(part), 6) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 20"""


@query("rrf_fuse", _LISTS + _RRF.format(a=1.0, b=1.0))
def _(spark, sf):
    dense, words = _lists(spark, sf)
    return fusion.rrf_fuse([(fusion.ranked(dense), 1.0), (fusion.ranked(words), 1.0)], 20)


@query("hybrid_rrf", _LISTS + _RRF.format(a="0.7::DOUBLE", b="(1 - 0.7::DOUBLE)"))
def _(spark, sf):
    return fusion.hybrid(*_lists(spark, sf), 20)


_LINEAR = """, a AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM {dense}),
b AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS y FROM {words})
SELECT id, round({w}::DOUBLE * coalesce(x, 0) + (1 - {w}::DOUBLE) * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT 20"""


@query("linear_fuse", _LISTS + _LINEAR.format(dense="dense", words="words", w=0.5))
def _(spark, sf):
    return fusion.linear_fuse(*_lists(spark, sf), 0.5, 20)


@query(
    "hybrid_filtered",
    f"""WITH docs AS (SELECT * FROM documents WHERE lang = 'en'), {_BM25.strip()[5:].replace('FROM documents', 'FROM docs')},
    dense AS (SELECT vec_id AS id, round({_SQL_SCORE['cosine']}, 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM docs) ORDER BY score DESC, id LIMIT 200),
    words AS (SELECT doc_id AS id, score FROM s JOIN tok USING (doc_id) WHERE list_contains(w, 'ering') AND list_contains(w, 'tion') AND list_contains(w, 'able') AND list_contains(w, 'heit') ORDER BY score DESC, id LIMIT 500)"""
    + _RRF.format(a="0.7::DOUBLE", b="(1 - 0.7::DOUBLE)"),
)
def _(spark, sf):
    return fusion.hybrid_search(_table(spark, sf, "embeddings"), _table(spark, sf, "documents"), _stored(spark, sf), _QUERY, 20, filter_={"lang": "en"})


@query("hybrid_linear", _LISTS + ", places AS (SELECT id, 1.0::DOUBLE / row_number() OVER (ORDER BY score DESC, id) AS score FROM words)" + _LINEAR.format(dense="dense", words="places", w=0.7))
def _(spark, sf):
    return fusion.hybrid(*_lists(spark, sf), 20, fusion="linear")


@query("minmax_normalize", "SELECT label, vec_id, round((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w), 6) AS normalized FROM (SELECT label, vec_id, list_sum(embedding::DOUBLE[]) AS s FROM embeddings) WINDOW w AS (PARTITION BY label)")
def _(spark, sf):
    summed = _table(spark, sf, "embeddings").select("label", "vec_id", F.aggregate(D.doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x).alias("s"))
    return summed.select("label", "vec_id", F.round(fusion.min_max(F.col("s"), "label"), 6).alias("normalized"))


@query("mmr_rerank")
def _(spark, sf):
    found = search.knn(_table(spark, sf, "embeddings"), _stored(spark, sf), 100, include_vector=True)
    return rerank.mmr(found.withColumn("query_id", F.lit(0)), 10)


@query("cross_rerank", f"SELECT vec_id, score AS original_score, vec_id % 7 + 0.5::DOUBLE AS score FROM (SELECT vec_id, round({_SQL_SCORE['cosine']}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50) ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    found = search.knn(_table(spark, sf, "embeddings"), _stored(spark, sf), 50).select("vec_id", "score", F.col("vec_id").cast("string").alias("text"))
    return rerank.rerank(found, _remainder, "text", 10).select("vec_id", "original_score", "score")


def _remainder(texts):
    """Stands for a model: any function from texts to scores."""
    return texts.astype("int64") % 7 + 0.5


_remainder.__annotations__ = {}


# ---- quantization ------------------------------------------------------------------------------

_DIMS = "dims AS (SELECT vec_id, u.i - 1 AS pos, embedding[u.i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) u(i))"
_FIT = {
    "int8": "m AS (SELECT pos, greatest(max(abs(x)), 1e-8) / 127 AS scale, 0.0::DOUBLE AS zero FROM dims GROUP BY pos)",
    "uint8": "m AS (SELECT pos, greatest(max(x) - min(x), 1e-8) / 255 AS scale, min(x) AS zero FROM dims GROUP BY pos)",
}
_CLIP = {"int8": "greatest(-128, least(127, {}))", "uint8": "greatest(0, least(255, {}))"}


def _scalar(mode: str):
    code = _CLIP[mode].format("round_even((x - zero) / scale, 0)")

    def fit(spark, sf):
        m = quantize.fit_scalar(_table(spark, sf, "embeddings"), mode)
        return m.select(F.col("pos").cast("long").alias("pos"), F.round("scale", 9).alias("scale"), F.round("zero", 9).alias("zero"))

    def encode(spark, sf):
        vectors = _table(spark, sf, "embeddings")
        encoded = quantize.encode_scalar(vectors, quantize.fit_scalar(vectors, mode), mode)
        return encoded.select("vec_id", F.aggregate("code", F.lit(0).cast("long"), lambda a, x: a + x).alias("codes"))

    def error(spark, sf):
        vectors = _table(spark, sf, "embeddings")
        e = quantize.reconstruction_error(quantize.encode_scalar(vectors, quantize.fit_scalar(vectors, mode), mode))
        return e.select(*(F.round(c, 7).alias(c) for c in e.columns))

    def dot(spark, sf):
        vectors = _table(spark, sf, "embeddings")
        scored = quantize.quantized_dot(quantize.encode_scalar(vectors, quantize.fit_scalar(vectors, mode), mode), _stored(spark, sf))
        return scored.select("vec_id", F.round("score", 6).alias("score"))

    base = f"WITH {_DIMS}, {_FIT[mode]}"
    query(f"sq_{mode}_fit", f"{base} SELECT pos, round(scale, 9) AS scale, round(zero, 9) AS zero FROM m")(fit)
    query(f"sq_{mode}_encode", f"{base} SELECT vec_id, sum({code})::BIGINT AS codes FROM dims JOIN m USING (pos) GROUP BY vec_id")(encode)
    decoded = f"d AS (SELECT vec_id, x, {code} * scale + zero AS y FROM dims JOIN m USING (pos))"
    per_row = "r AS (SELECT vec_id, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c FROM d GROUP BY vec_id)"
    query(f"sq_{mode}_error", f"{base}, {decoded}, {per_row} SELECT round(avg((x - y) * (x - y)), 7) AS mse, round(max(abs(x - y)), 7) AS max_error, (SELECT round(avg(c), 7) FROM r) AS mean_cosine FROM d")(error)
    query(f"sq_{mode}_dot", f"{base}, {decoded.replace('vec_id, x,', 'vec_id, pos, x,')} SELECT d.vec_id, round(sum(d.y * q.x), 6) AS score FROM d JOIN dims q ON q.pos = d.pos AND q.vec_id = 0 GROUP BY d.vec_id")(dot)


for _mode in _FIT:
    _scalar(_mode)


@query("binary_hamming", f"WITH {_DIMS}, b AS (SELECT vec_id, pos, x > 0 AS s FROM dims) SELECT b.vec_id, count(*) FILTER (b.s <> q.s)::INT AS distance, round(1 - 2 * count(*) FILTER (b.s <> q.s) / 64.0::DOUBLE, 6) AS score FROM b JOIN b q ON q.pos = b.pos AND q.vec_id = 0 GROUP BY b.vec_id")
def _(spark, sf):
    words = _table(spark, sf, "embeddings").select("vec_id", quantize.binary_words(F.col("embedding"), 64).alias("w"))
    asked = words.filter("vec_id = 0").select(F.col("w").alias("q"))
    both = words.crossJoin(F.broadcast(asked))
    return both.select("vec_id", quantize.hamming(F.col("w"), F.col("q")).alias("distance"), F.round(quantize.binary_similarity(F.col("w"), F.col("q"), 64), 6).alias("score"))


_PQ = """WITH book AS (SELECT u.s AS sub, vec_id::INT AS code, embedding[u.s * 8 + 1:u.s * 8 + 8]::DOUBLE[] AS centroid FROM embeddings, unnest(range(0, 8)) u(s) WHERE vec_id < 16),
part AS (SELECT vec_id, u.s AS sub, embedding[u.s * 8 + 1:u.s * 8 + 8]::DOUBLE[] AS part FROM embeddings, unnest(range(0, 8)) u(s)),
codes AS (SELECT vec_id, sub, arg_min(code, (round(list_sum(list_transform(list_zip(part, centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), code)) AS code FROM part JOIN book USING (sub) GROUP BY vec_id, sub)"""


@query("pq_encode", _PQ + " SELECT vec_id, sub::INT AS sub, code FROM codes")
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    return quantize.encode_product(vectors, quantize.codebook_from_rows(vectors, 8, 16), 8)


@query("pq_adc", _PQ + " SELECT c.vec_id, round(sum(list_sum(list_transform(list_zip(q.part, b.centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS score FROM codes c JOIN book b ON b.sub = c.sub AND b.code = c.code JOIN part q ON q.sub = c.sub AND q.vec_id = 0 GROUP BY c.vec_id ORDER BY score, c.vec_id LIMIT 20")
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    book = quantize.codebook_from_rows(vectors, 8, 16)
    return quantize.adc_search(quantize.encode_arrays(vectors, book), book, _stored(spark, sf), 20)


@query("pq_decode", _PQ + " SELECT c.vec_id, round(avg(list_sum(list_transform(list_zip(q.part, b.centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS error FROM codes c JOIN book b ON b.sub = c.sub AND b.code = c.code JOIN part q ON q.sub = c.sub AND q.vec_id = c.vec_id GROUP BY c.vec_id")
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    book = quantize.codebook_from_rows(vectors, 8, 16)
    decoded = quantize.decode_arrays(quantize.encode_arrays(vectors, book), book)
    gap = D.euclidean_distance(F.col("embedding"), F.col("decoded"))
    return vectors.join(decoded, "vec_id").select("vec_id", F.round(gap * gap / 8, 6).alias("error"))


@query(
    "pq_error",
    _PQ
    + """, d AS (SELECT q.vec_id, q.part, b.centroid FROM codes c JOIN book b ON b.sub = c.sub AND b.code = c.code JOIN part q ON q.sub = c.sub AND q.vec_id = c.vec_id),
    x AS (SELECT vec_id, p[1] AS x, p[2] AS y FROM (SELECT vec_id, unnest(list_zip(part, centroid)) AS p FROM d)),
    r AS (SELECT vec_id, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c FROM x GROUP BY vec_id)
    SELECT round(avg((x - y) * (x - y)), 7) AS mse, round(max(abs(x - y)), 7) AS max_error, (SELECT round(avg(c), 7) FROM r) AS mean_cosine FROM x""",
)
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    e = quantize.product_error(vectors, quantize.codebook_from_rows(vectors, 8, 16))
    return e.select(*(F.round(c, 7).alias(c) for c in e.columns))


@query("binary_decode", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END))::DOUBLE AS total, CASE WHEN embedding[1] > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS first, CASE WHEN embedding[64] > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS last FROM embeddings")
def _(spark, sf):
    signs = _table(spark, sf, "embeddings").select("vec_id", quantize.decode_binary(quantize.binary_words(F.col("embedding"), 64), 64).alias("s"))
    return signs.select("vec_id", F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(63)).alias("last"))


# ---- partitioned search ------------------------------------------------------------------------

_IVF = "WITH c AS (SELECT vec_id::INT AS list_id, embedding::DOUBLE[] AS centroid FROM embeddings WHERE vec_id < 16), a AS (SELECT vec_id, any_value(embedding) AS embedding, arg_min(list_id, (round(list_sum(list_transform(list_zip(embedding::DOUBLE[], centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), list_id)) AS list_id FROM embeddings, c GROUP BY vec_id)"


@query("ivf_assign", _IVF + " SELECT vec_id, list_id FROM a")
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    return partitioned.assign(vectors, partitioned.centroids_from_rows(vectors, 16)).select("vec_id", "list_id")


@query("ivf_search", _IVF + f", n AS (SELECT list_id FROM c ORDER BY round(list_sum(list_transform(list_zip(centroid, {_Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), list_id LIMIT 4) SELECT vec_id, list_id, round({_SQL_SCORE['cosine']}, 6) AS score FROM a WHERE list_id IN (SELECT list_id FROM n) ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    cells = partitioned.centroids_from_rows(vectors, 16)
    return partitioned.search_cells(partitioned.assign(vectors, cells), cells, _stored(spark, sf), 10, 4).select("vec_id", "list_id", "score")


def _index(spark, sf, kind: str) -> str:
    """A trained index of the whole table, written once for the query that searches it."""
    vectors, path = _table(spark, sf, "embeddings"), scratch_dir(spark)
    partitioned.rebuild(vectors, path, vectors.count(), kind, seed=1)
    return path


_EXACT = f"SELECT vec_id, label, round({_SQL_SCORE['cosine']}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10"


@query("ivf_layout_search")
def _(spark, sf):
    """The ten nearest in the ten nearest cells of a trained, written index."""
    rows, cells = partitioned.read_layout(spark, _index(spark, sf, "ivf"))
    return partitioned.search_cells(rows, cells, _stored(spark, sf), 10, 10).select("vec_id", "label", "score")


@query("ivf_layout_all_cells", _EXACT)
def _(spark, sf):
    rows, cells = partitioned.read_layout(spark, _index(spark, sf, "ivf"))
    return partitioned.search_cells(rows, cells, _stored(spark, sf), 10, partitioned.MOST_CELLS).select("vec_id", "label", "score")


@query("ivfpq_search")
def _(spark, sf):
    """By product codes in the ten nearest cells, the best 200 scored exactly."""
    path = _index(spark, sf, "ivfpq")
    rows, cells = partitioned.read_layout(spark, path)
    return partitioned.search_pq(rows, cells, spark.read.parquet(f"{path}/codebook"), _stored(spark, sf), 10, 10, refine=20).select("vec_id", "label", "score")


@query("collection_search", f"SELECT vec_id, round({_SQL_SCORE['cosine']}, 6) AS score FROM embeddings WHERE label IN (1, 3, 5) AND round({_SQL_SCORE['cosine']}, 6) >= 0.05 ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    return search.search(_table(spark, sf, "embeddings"), _stored(spark, sf), 10, filter_={"label": {"$in": [1, 3, 5]}}, threshold=0.05, ef=64).select("vec_id", "score")


@query("collection_search_mmr")
def _(spark, sf):
    return search.search(_table(spark, sf, "embeddings"), _stored(spark, sf), 10, use_mmr=True, fetch=50).select("vec_id", "score", "rank")


@query("search_by_text")
def _(spark, sf):
    """Texts as hashed token vectors, the nearest to a text."""
    texts = _table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"), _hashed(F.col("text")).alias("embedding"))
    return search.search_by_text(texts, "ering tion able heit", search.hashed_embedding, 10).select("vec_id", "score")


@F.pandas_udf(ArrayType(DoubleType()))
def _hashed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: search.hashed_embedding(t or ""))


# ---- writes ------------------------------------------------------------------------------------


@query("upsert_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 5 = 1")
def _(spark, sf):
    old = _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = old.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    new = old.filter("o_orderkey % 5 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return C.upsert(old, changed.union(new), "o_orderkey")


@query("upsert_counts", "SELECT count(*) FILTER (o_orderkey % 5 = 1) AS inserted, count(*) FILTER (o_orderkey % 5 = 0) AS updated FROM orders")
def _(spark, sf):
    old = _table(spark, sf, "orders").select("o_orderkey")
    return C.upsert_counts(old, old.filter("o_orderkey % 5 = 0").union(old.filter("o_orderkey % 5 = 1").select(-F.col("o_orderkey"))), "o_orderkey")


@query("last_write_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, sf):
    rows = _table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return C.last_wins(rows, "user_id", "at").select("user_id", "event_type")


_LATE = """
WITH old AS (SELECT o_orderkey, o_orderstatus, o_orderdate AS moment FROM orders),
new AS (SELECT o_orderkey, 'late' AS o_orderstatus, o_orderdate - INTERVAL 1 DAY AS moment FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, 'next', o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderkey % 3 = 1 OR o_orderkey % 6 = 0)
SELECT o_orderkey, arg_max(o_orderstatus, moment) AS o_orderstatus FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY o_orderkey"""


@query("last_write_wins_late", _LATE)
def _(spark, sf):
    """Two batches into a stored collection; records older than the stored ones change nothing."""
    old = _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("at"))
    late = old.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("late").alias("o_orderstatus"), F.expr("at - INTERVAL 1 DAY").alias("at"))
    later = old.filter("o_orderkey % 3 = 1 or o_orderkey % 6 = 0").select("o_orderkey", F.lit("next").alias("o_orderstatus"), F.expr("at + INTERVAL 1 DAY").alias("at"))
    store = C.Store(spark, scratch_dir(spark))
    store.create("orders", old, 0, key="o_orderkey", buckets=8)
    for k, batch in enumerate((later, late)):
        store.merge("orders", batch, "at", batch=k)
    return store.read("orders").select("o_orderkey", "o_orderstatus")


@query("patch_metadata", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"k\": -1}' ELSE props END AS props FROM events")
def _(spark, sf):
    old = _table(spark, sf, "events").select("event_id", "props")
    return C.patch(old, old.filter("event_id % 3 = 0").select("event_id", F.lit('{"k": -1}').alias("props")), "event_id", "props")


@query("delete_by_filter", f"SELECT event_id FROM events WHERE NOT coalesce({_K} < 50, false)")
def _(spark, sf):
    return C.delete_by_filter(_table(spark, sf, "events"), {"k": {"$lt": 50}}, "props").select("event_id")


@query("delete_ids", "SELECT vec_id FROM embeddings WHERE label <> 3")
def _(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    return C.delete(vectors, vectors.filter("label = 3"), "vec_id").select("vec_id")


@query("ttl_expire", "SELECT event_id FROM events WHERE ts + to_seconds(event_id % 1000 * 3600) >= (SELECT max(ts) FROM events)")
def _(spark, sf):
    events = _table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.crossJoin(F.broadcast(now)).withColumn("expires_at", C.expiry(F.col("event_id") % 1000 * 3600, F.col("ts")))
    return C.unexpired(rows, F.col("now")).select("event_id")


@query("surrogate_ids", "SELECT vec_id, 1000 + row_number() OVER (ORDER BY vec_id) - 1 AS surrogate FROM embeddings")
def _(spark, sf):
    return C.allocate(_table(spark, sf, "embeddings").select("vec_id"), 1000, "vec_id")


@query("collection_stats", "SELECT 'documents' AS collection, count(*) AS vectors FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def _(spark, sf):
    parts = [_table(spark, sf, n).agg(F.count("*").alias("vectors")).select(F.lit(n).alias("collection"), "vectors") for n in ("documents", "embeddings", "events")]
    return parts[0].union(parts[1]).union(parts[2])


# ---- metrics -----------------------------------------------------------------------------------


@query("latency_rolling_mean", "SELECT event_id, avg(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS rolling FROM events")
def _(spark, sf):
    cents = _table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return ingest.rolling_mean(cents, "cents", "event_id", "event_type").select("event_id", "rolling")


@query("latency_histogram", "SELECT b::DOUBLE AS bound, (SELECT count(*) FROM events WHERE value <= b) AS count FROM (VALUES (1.0), (10.0), (50.0), (100.0)) t(b)")
def _(spark, sf):
    return ingest.histogram(_table(spark, sf, "events"), "value", [1.0, 10.0, 50.0, 100.0])


@query("audit_newest", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(spark, sf):
    rows = _table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return ingest.newest(rows, "at").select("event_id", "event_type")
