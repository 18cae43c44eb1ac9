import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import learned_search as L


def brute(x, ids, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        order = sorted((dist, i) for dist, i in zip(d, ids, strict=True) if i != q)
        out[q] = order[:k]
    return out


def test_balanced_bisection():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((200, 8)) + 6 * rng.standard_normal(8) for _ in range(4)])
    _, a = L.graph(x, 10)
    label = L.partition(a, 4, rng)
    assert sorted(np.bincount(label)) == [200] * 4
    assert a[label[:, None] != label[None, :]].sum() < 0.1 * a.sum()


@pytest.mark.parametrize("table", ["sf0.1"])
def test_recall(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select("vec_id", "embedding").filter("embedding is not null")
    rows = df.collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype="f8")
    got = L.search(df, F.pmod("vec_id", F.lit(20)) == 0).toPandas()
    want = brute(x, ids, [i for i in ids if i % 20 == 0])
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 11))
        for v, s in zip(g["vec_id"], g["score"], strict=True):
            assert abs(s - np.sqrt(((x[ids.index(v)] - x[ids.index(q)]) ** 2).sum())) < 1e-12
        hits += len({i for _, i in want[q]} & set(g["vec_id"]))
    assert got["query_id"].nunique() == len(want) and hits >= 0.9 * 10 * len(want)


def test_edge_rows(spark):
    good = [(i, [float(i), 1.0]) for i in range(0, 30, 5)] + [(7, [5.0, 1.0]), (7, [5.0, 1.0])]
    bad = [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [1.0]), (700, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as part")
    got = {q: g for q, g in L.search(df, F.col("vec_id") % 5 == 0, k=3).toPandas().sort_values("rank").groupby("query_id")}
    assert sorted(got) == [0, 5, 10, 15, 20, 25]
    assert got[5]["vec_id"].tolist() == [7, 7, 0] and got[5]["score"].tolist() == [0.0, 0.0, 5.0]
    assert L.search(df.limit(0), F.lit(True)).count() == 0
