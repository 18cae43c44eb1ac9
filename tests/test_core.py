"""Known answers for the vector, filter, text and write operators."""

import math

import pytest
from pyspark.sql import functions as F

from spindrift.functions import distances as D
from spindrift.functions import text as T
from spindrift.functions.filters import apply_filter
from spindrift.operators import fusion, quantize, rerank, search
from spindrift.sources import collection as C
from spindrift.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "metric,a,b,want",
    [
        ("cosine", [1, 2, 3], [-1, -2, -3], 2.0),
        ("cosine", [0, 0, 0], [1, 2, 3], 1.0),
        ("euclidean", [0, 0, 0], [3, 4, 0], 5.0),
        ("L2", [0, 0, 0], [3, 4, 0], 5.0),
        ("manhattan", [1, -2, 3], [4, 2, -1], 11.0),
        ("dot", [1, 2, 3], [4, -5, 6], -12.0),
    ],
)
def test_distances(spark, metric, a, b, want):
    assert value(spark, D.compute_distance(D.literal(a), D.literal(b), metric)) == pytest.approx(want)


def test_unknown_metric():
    with pytest.raises(ValueError):
        D.metric_name("hamming")


def test_normalize_keeps_zeros(spark):
    assert value(spark, D.normalize(D.literal([0, 0, 0]))) == [0, 0, 0]
    assert value(spark, D.normalize(D.literal([3, 4, 0]))) == pytest.approx([0.6, 0.8, 0])


BOATS = [
    ("a", '{"hull": "steel", "length": 31.5, "port": "Kiel", "crew": {"cooks": 2}, "log": null}'),
    ("b", '{"hull": "steel", "length": 112.0, "port": "Oban"}'),
    ("c", '{"hull": "wood", "length": 8.25, "port": "Kristiansund"}'),
    ("d", '{"hull": "glass", "length": 44.0, "port": "Vigo"}'),
    ("e", '{"hull": "wood", "length": 12.0}'),
]


@pytest.mark.parametrize(
    "filter_,want",
    [
        ({"hull": "steel"}, "ab"),
        ({"hull": {"$eq": "steel"}}, "ab"),
        ({"length": {"$gte": 12, "$lt": 44}}, "ae"),
        ({"length": {"$gt": 12, "$lte": 44}}, "ad"),
        ({"port": {"$in": ["Kiel", "Vigo"]}}, "ad"),
        ({"hull": {"$nin": ["wood", "glass"]}}, "ab"),
        ({"port": {"$nin": ["Kiel"]}}, "bcde"),
        ({"port": {"$regex": "^K.*l$"}}, "a"),
        ({"port": {"$regex": "i"}}, "acd"),
        ({"$or": [{"hull": "glass"}, {"port": "Oban"}]}, "bd"),
        ({"hull": "wood", "$or": [{"port": "Vigo"}, {"length": {"$lt": 10}}]}, "c"),
        ({"$and": [{"hull": "steel"}, {"length": {"$gt": 100}}]}, "b"),
        ({"$not": {"port": "Kiel"}}, "bcde"),
        ({"port": None}, "e"),
        ({"port": {"$ne": "Oban"}}, "acde"),
        ({"port": {"$ne": None}}, "abcd"),
        ({"crew.cooks": 2}, "a"),
        ({"log": {"$exists": True}}, "a"),
        ({"port": {"$exists": False}}, "e"),
        ({"port": {"$in": []}}, ""),
        ({"port": {"$nin": []}}, "abcde"),
        ({"port": {"$in": [None, "Kiel"]}}, "ae"),
        ({"$and": []}, "abcde"),
        ({"$or": []}, ""),
        ({}, "abcde"),
        (None, "abcde"),
    ],
)
def test_filters(spark, filter_, want):
    df = spark.createDataFrame(BOATS, "id string, metadata string")
    assert sorted(r.id for r in apply_filter(df, filter_, "metadata").collect()) == list(want)


@pytest.mark.parametrize("bad", [{"a'b": 1}, {"a": {"$near": 1}}, {"$nor": []}, {"a": {"$in": 3}}])
def test_filter_errors(spark, bad):
    with pytest.raises(ValueError):
        apply_filter(spark.createDataFrame(BOATS, "id string, metadata string"), bad, "metadata")


def test_facets_and_scroll(spark):
    df = spark.createDataFrame(BOATS, "id string, metadata string").withColumn("created_at", F.lit(1))
    got = [tuple(r) for r in C.facets(df, F.try_variant_get(F.try_parse_json("metadata"), "$.hull", "string")).collect()]
    assert got == [("steel", 2), ("wood", 2), ("glass", 1)]
    assert [r.id for r in C.scroll(df, 2, 1).collect()] == ["b", "c"]
    assert [r.id for r in C.scroll(df, 5, 1, filter_={"hull": "wood"}, metadata="metadata").collect()] == ["e"]
    assert C.scroll_total(df, {"hull": "wood"}, "metadata").first()[0] == 2


def test_fetch_any_number_of_keys(spark):
    rows = spark.range(3000).withColumn("surrogate", F.col("id") + 7)
    for ids in ([1, 5, 5000], list(range(0, 6000, 2)), spark.createDataFrame([(1,), (1,), (9,)], "id long")):
        want = sorted(set(ids if isinstance(ids, list) else [1, 9]) & set(range(3000)))
        assert sorted(r.id for r in C.fetch(rows, ids).collect()) == want
        assert sorted(tuple(r) for r in C.surrogate_of(rows, ids).collect()) == [(i, i + 7) for i in want]


def test_numbers_and_rolling_means(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(-50, 50)) for i in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "at long, part string, value long").repartition(5)
    got = {r.at: r.surrogate for r in C.allocate(df.select("at"), 100, "at").collect()}
    assert got == {a: 100 + k for k, a in enumerate(sorted(r[0] for r in rows))}
    want, held = {}, {"a": [], "b": []}
    for at, part, value_ in sorted(rows):
        held[part].append(value_)
        last = held[part][-40:]
        want[at] = sum(last) / len(last)
    for block in (40, 64, 10**6):
        got = {r.at: r.rolling for r in ingest.rolling_mean(df, "value", "at", "part", 40, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert C.allocate(df.limit(0).select("at"), 0, "at").count() == 0


def test_keys(spark):
    import hashlib

    import numpy as np

    from spindrift.functions import keys

    df = spark.createDataFrame([([1.5, -2.0], "abcdefghijk"), (None, "abc")], "v array<double>, k string")
    got = [tuple(r) for r in df.select(keys.vector_key(F.col("v")), keys.masked(F.col("k"))).collect()]
    assert got == [(hashlib.md5(np.array([1.5, -2.0], "<f4").tobytes()).hexdigest(), "abcdefgh…"), (None, "abc…")]
    assert keys.filter_key({"a": 1, "b": 2}) == keys.filter_key({"b": 2, "a": 1}) != keys.filter_key({})


def test_tokens(spark):
    text = "Harbour-Master's 3 logs, 2nd ed. #Tide_Table: where the İce WOULD thaw; a b 42"
    got = value(spark, T.tokenize(F.lit(text)))
    assert got == ["harbour", "master", "logs", "2nd", "ed", "tide", "table", "ce", "thaw", "42"]
    assert T.query_tokens(text) == got and len(T.STOP_WORDS) == 49


def test_sparse_search(spark):
    rows = [("p", 7, 3.0), ("p", 8, 4.0), ("q", 8, 1.0), ("q", 9, 1.0), ("r", 5, 2.0)]
    v = spark.createDataFrame(rows, "doc_id string, term int, weight double")
    want = [("p", 0.8), ("q", 0.707107)]
    assert [(r.doc_id, r.score) for r in T.sparse_search(v, {8: 2.0}, 5).collect()] == want
    norms = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    assert [(r.doc_id, r.score) for r in T.sparse_search(v.join(norms, "doc_id"), {8: 2.0}, 5).collect()] == want
    assert T.sparse_search(v, {8: 0.0}, 5).count() == 0


def test_stored_sparse_vectors(spark):
    docs = spark.createDataFrame([(1, "tide tide wind", "en"), (2, "wind", "de"), (3, "of the", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    rows = T.sparse_rows(docs)
    got = {r.doc_id: (r.terms, r.weights, round(r.norm, 6)) for r in rows.collect()}
    assert got == {1: (["tide", "wind"], [2.0, 1.0], 2.236068), 2: (["wind"], [1.0], 1.0), 3: ([], [], 1.0), 4: ([], [], 1.0)}
    found = lambda df, *a: [(r.doc_id, r.score) for r in T.search_sparse_rows(df, {"wind": 2.0}, 5, *a).collect()]
    assert found(rows) == [(2, 1.0), (1, 0.447214)] and found(rows, {"lang": "en"}) == [(1, 0.447214)]
    more = T.add_sparse(rows, T.sparse_rows(spark.createDataFrame([(2, "gale gale", "de"), (5, "wind", "fr"), (6, "", "fr")], docs.schema)))
    assert found(more) == [(5, 1.0), (1, 0.447214)] and T.sparse_size(more).first()[0] == 3
    assert found(T.remove_sparse(more, spark.createDataFrame([(5,)], "doc_id long"))) == [(1, 0.447214)]


def test_searches_without_terms(spark):
    docs = spark.createDataFrame([(1, "tide")], "doc_id long, text string")
    for search_ in (T.bm25_search, T.keyword_search, T.text_search):
        assert search_(docs, "the of a", 5).count() == 0 and search_(docs, "gale", 5).count() == 0
        assert [r.doc_id for r in search_(docs, "tide", 5).collect()] == [1]


def test_fusion(spark):
    lists = [spark.createDataFrame(rows, "id string, score double") for rows in ([("k", 9.0), ("m", 8.0)], [("m", 0.4), ("n", 0.3), ("k", 0.1)])]
    got = [tuple(r) for r in fusion.rrf_fuse([(fusion.ranked(df), w) for df, w in zip(lists, (1, 2), strict=True)], 9).collect()]
    assert got == [("m", round(1 / 62 + 2 / 61, 6)), ("k", round(1 / 61 + 2 / 63, 6)), ("n", round(2 / 62, 6))]
    got = [tuple(r) for r in fusion.linear_fuse(*lists, 0.25, 9).collect()]
    assert got == [("m", 0.75), ("n", 0.5), ("k", 0.25)]


def test_mmr_prefers_other_directions(spark):
    rows = [(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.89, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id int, vec_id long, score double, embedding array<double>")
    assert [r.vec_id for r in rerank.mmr(df, 2).orderBy("rank").collect()] == [1, 3]


def test_quantizers_keep_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    for mode in ("int8", "uint8"):
        e = quantize.reconstruction_error(quantize.encode_scalar(v, quantize.fit_scalar(v, mode), mode)).first()
        assert e.mse < 1e-4 and e.mean_cosine > 0.995
    book = quantize.fit_product(v, 8, 8, 5)
    decoded = quantize.decode_product(quantize.encode_product(v, book, 8), book)
    mse = v.join(decoded, "vec_id").agg(F.avg(F.pow(D.euclidean_distance(F.col("embedding"), F.col("decoded")), 2) / 64)).first()[0]
    assert mse < 0.05
    with pytest.raises(ValueError):
        quantize.fit_product(v, 7)


def test_choices():
    assert [search.index_type(n) for n in (10, 10_000, 100_000)] == ["flat", "ivf", "hnsw"]
    assert search.cells(1) == 4 and search.cells(10_000) == 400 and search.cells(10**9) == 4096
    assert math.isclose(sum(x * x for x in search.hashed_embedding("a text of words")), 1.0)
