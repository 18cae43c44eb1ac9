"""Queries over the whole table against brute force."""

import duckdb
import numpy as np

from spindrift.plans import registry

SF = "/root/testdata/sf0.001"


def stored():
    found = duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return [i for i, _ in found], np.array([v for _, v in found])


def test_pairwise_queries(spark):
    ids, vectors = stored()
    got = {(r["x_id"], r["y_id"]): r["distance"] for r in registry.QUERIES["pairwise_matrix"](spark, SF).collect()}
    assert set(got) == {(x, y) for x in ids if x % 50 == 0 for y in ids}
    for k in range(0, len(ids), 50):
        want = np.abs(vectors - vectors[k]).sum(1)
        assert np.allclose([got[ids[k], y] for y in ids], want, atol=1e-6)


def test_rescore_quantized(spark):
    ids, vectors = stored()
    score = np.round(vectors @ vectors[0], 6)
    want = sorted(zip(-score, ids, strict=True))[:10]
    got = [(r["vec_id"], r["score"]) for r in registry.QUERIES["rescore"](spark, SF).collect()]
    assert [i for i, _ in got] == [i for _, i in want] and np.allclose([s for _, s in got], [-s for s, _ in want], atol=1e-6)
    assert {i % 3 for i, _ in got} != {0}
