"""Trained, written indexes: recall against exact search, pruned scans, product codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import partitioned as P
from spindrift.operators import quantize as Q
from spindrift.operators import search as S


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((30, 24))
    x = centers[rng.integers(0, 30, 2500)] + 0.3 * rng.standard_normal((2500, 24))
    return spark.createDataFrame([(i, [float(v) for v in row], i % 5) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/i"
    assert P.rebuild(vectors, path, 2500, "ivfpq", m=8, bits=8, seed=2) == "ivfpq"
    return path


def asked(vectors):
    return [(r.vec_id, list(r.embedding)) for r in vectors.filter("vec_id % 250 = 0").collect()]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_of_few_cells(spark, vectors, index, metric):
    rows, cells = P.read_layout(spark, index)
    book = spark.read.parquet(f"{index}/codebook")
    exact = flat = coded = 0
    for _, q in asked(vectors):
        want = {r.vec_id for r in S.knn(vectors, q, 10, metric).collect()}
        exact += len(want)
        flat += len(want & {r.vec_id for r in P.search_cells(rows, cells, q, 10, 20, metric).collect()})
        coded += len(want & {r.vec_id for r in P.search_pq(rows, cells, book, q, 10, 20, metric, refine=10).collect()})
    assert flat >= 0.9 * exact and coded >= 0.9 * exact


def test_other_cells_are_not_read(spark, vectors, index, capsys):
    rows, cells = P.read_layout(spark, index)
    q = asked(vectors)[0][1]
    found = P.search_cells(rows, cells, q, 10, 3)
    found.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(list_id" in plan or "PartitionFilters: [list_id" in plan or "list_id#" in plan.split("PartitionFilters")[1][:80]
    probed = P.nearest_cells(cells, q, 3)
    assert len(probed) == 3 and rows.filter(F.col("list_id").isin(probed)).inputFiles() != []
    assert rows.count() == 2500 and rows.select("list_id").distinct().count() > 100


def test_codes_without_refining_and_with_a_filter(spark, vectors, index):
    rows, cells = P.read_layout(spark, index)
    book = spark.read.parquet(f"{index}/codebook")
    q = asked(vectors)[1][1]
    rough = P.search_pq(rows, cells, book, q, 5, 20, "l2", refine=0).collect()
    assert len(rough) == 5 and rough[0].vec_id == 250 and [r.score for r in rough] == sorted(r.score for r in rough)
    exact = {r.vec_id: sum((a - b) ** 2 for a, b in zip(r.embedding, q)) for r in vectors.collect()}
    assert all(abs(r.score - exact[r.vec_id]) < 0.35 * (1 + exact[r.vec_id]) for r in rough)
    some = P.search_pq(rows, cells, book, q, 10, 40, "cosine", filter_={"label": 3}).collect()
    assert {r.label for r in some} == {3} and len(some) == 10
    with pytest.raises(ValueError):
        P.search_pq(rows, cells, book, q, 5, 3, "manhattan")


def test_small_tables_stay_flat(vectors, tmp_path):
    assert P.rebuild(vectors.limit(50), f"{tmp_path}/i", 50) == "flat"
    assert P.rebuild(vectors.limit(3), f"{tmp_path}/i", 3, "ivf") == "flat"


def test_product_codes(spark, vectors):
    book = Q.fit_product(vectors, 8, 4, 5)
    x = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], dtype="f8")
    table = Q.codebook_array(book)
    codes = {r.vec_id: r.codes for r in Q.encode_arrays(vectors, book).collect()}
    want = np.stack([((x[:, None, 3 * s : 3 * s + 3] - table[s][None]) ** 2).sum(2).argmin(1) for s in range(8)], 1)
    assert [codes[i] for i in range(len(x))] == want.tolist()
    decoded = table[np.arange(8)[None], want].reshape(len(x), -1)
    e = Q.product_error(vectors, book).first()
    assert e.mse == pytest.approx(((x - decoded) ** 2).mean()) and e.max_error == pytest.approx(np.abs(x - decoded).max())
    found = Q.adc_search(Q.encode_arrays(vectors, book), book, x[7], 5).collect()
    gaps = ((decoded - x[7]) ** 2).sum(1)
    assert [r.score for r in found] == pytest.approx(np.sort(gaps)[:5].round(6).tolist(), abs=2e-6)
    again = Q.load_model(spark, Q.dump_model(book))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, book.collect())) and again.dtypes == book.dtypes
    scalar = Q.fit_scalar(vectors, "uint8")
    assert sorted(map(tuple, Q.load_model(spark, Q.dump_model(scalar)).collect())) == sorted(map(tuple, scalar.collect()))


@pytest.mark.parametrize("size", [1, 19, 64, 65, 130])
def test_signs(spark, size):
    rng = np.random.default_rng(size)
    x = rng.standard_normal(size)
    df = spark.createDataFrame([([float(v) for v in x],)], "v array<double>")
    assert df.select(Q.decode_binary(Q.binary_words(F.col("v"), size), size)).first()[0] == np.where(x > 0, 1.0, -1.0).tolist()


def test_collection_search(spark, vectors):
    q = asked(vectors)[0][1]
    plain = [(r.vec_id, r.score) for r in S.search(vectors, q, 5, ef=10).collect()]
    assert plain == [(r.vec_id, r.score) for r in S.knn(vectors, q, 5).collect()]
    varied = S.search(vectors, q, 5, use_mmr=True, mmr_lambda=0.3, fetch=50, filter_={"label": {"$lt": 3}}).collect()
    assert [r["rank"] for r in varied] == [1, 2, 3, 4, 5] and varied[0].vec_id == 0 and all(r.label < 3 for r in varied)
    near = S.search(vectors, q, 5, "l2", use_mmr=True, mmr_lambda=1.0).collect()
    assert [r.vec_id for r in near] == [r.vec_id for r in S.knn(vectors, q, 5, "l2").collect()]
    assert S.search(vectors, q[:-1], 5).count() == 0
    with pytest.raises(ValueError):
        S.search(vectors, q, 5, ef=0)


def test_mmr_against_loops(spark, vectors):
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    q = rows[250]
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    found = S.knn(vectors, q.tolist(), 40).collect()
    free, chosen = [(r.vec_id, r.score) for r in found], []
    while len(chosen) < 8:
        best = max(free, key=lambda c: (c[1] if not chosen else 0.4 * c[1] - 0.6 * max(cosine(rows[c[0]], rows[i]) for i in chosen)))
        chosen.append(best[0])
        free.remove(best)
    got = S.search(vectors, q.tolist(), 8, use_mmr=True, mmr_lambda=0.4, fetch=40).collect()
    assert [r.vec_id for r in got] == chosen
