import random

import numpy as np
import pytest

from spindrift.llm import components as C
from spindrift.llm import near_dedup as N
from spindrift.llm import shingles as S


def words(text):
    return (text or "").encode().translate(S._LOWER).split()


def brute_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent=80):
    sets = {i: brute_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "über", "A", "a"]
    rows = [None, "", " \n\t ", "one", "One", "two words", "two  WORDS", "a b c", "a b c d", "x " * 9, "x " * 400]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(8, 200))
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(rng.choice([" ", "  ", "\n"]).join(copy))
            base = copy if rng.random() < 0.3 else base  # chains, whose ends are far apart
    ids = list(range(3, 3 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "'s' as signature")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_groups(df, 4).collect()}
    assert got == brute(rows, 4)
    kept = {r.doc_id for r in N.dedup(df, 5).collect()}
    assert kept == {i for i, (_, c) in brute(rows, 5).items() if i == c}


def test_edge_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in N.near_groups(df, 4).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("5", 2, "1", False), ("7", 0, "7", True), ("None", 2, "None", True)]
    assert N.near_groups(df.limit(0), 4).count() == 0


def test_slices_and_groups_agree(monkeypatch):
    texts = [t for _, t in corpus(9)] + ["long " * 50 + "y" * 3000 + " end of it"]
    want = [s.tolist() for s in S.shingle_sets(texts, 4)]
    monkeypatch.setattr(S, "SLICE", 97)
    assert [s.tolist() for s in S.shingle_sets(texts, 4)] == want
    assert [len(s) for s in want] == [len(brute_set(t, 4)) for t in texts]


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 1.0):
        errors = []
        for _ in range(30):
            common = rng.integers(0, 2**63, size=int(600 * share), dtype=np.uint64)
            own = [rng.integers(0, 2**63, size=(600 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
            packed = N.pack(N.minima([np.concatenate((common, o)) for o in own]))
            errors.append(N.estimates(packed[:1], packed[1:])[0, 0] - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_of_chains(spark, local):
    links = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(5, 5), (100, 7)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long"), local=local).collect()}
    assert got == {i: i // 20 * 20 for i in range(61) if i // 20 * 20 < 60} | {100: 0}


def test_components_of_a_long_shuffled_chain(spark, monkeypatch):
    rounds = []
    whole = C.cut
    monkeypatch.setattr(C, "cut", lambda df: (rounds.append(1), whole(df))[1])
    n = 10_000
    names = np.random.default_rng(0).permutation(n).tolist()
    links = list(zip(names[:-1], names[1:], strict=True)) + [(n + 5, n + 3), (n + 3, n + 9)]
    df = spark.createDataFrame(links, "a long, b long")
    want = dict.fromkeys(range(n), 0) | dict.fromkeys((n + 3, n + 5, n + 9), n + 3)
    for local in (0, 10**6):
        assert {r.node: r.component for r in C.components(df, local=local).collect()} == want
    assert len(rounds) <= 22


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_of_nothing(spark, local):
    assert C.components(spark.createDataFrame([], "a long, b long"), local=local).count() == 0
    assert C.components(spark.createDataFrame([(1, 1)], "a long, b long"), local=local).count() == 0
