import numpy as np
import pandas as pd
import pytest

from spindrift.llm import mixing as M


def test_targets_stop_and_reshare():
    assert M.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = M.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert M.targets([0, 7], [5, 2]) == [0.0, 7.0]
    assert M.targets([], []) == [] and M.targets([0, 0], [1, 1]) == [0.0, 0.0]


def test_tree_meets_quotas():
    quotas = np.array([1000, 37, 0, 5])
    shares = M.split_tree(quotas, 7, np.random.default_rng(3))
    assert shares.sum(0).tolist() == quotas.tolist()
    assert shares.sum(1).max() - shares.sum(1).min() <= 7


def docs(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 3}" if i % 7 else None) for i in range(600)]
    rows += [(7, None, "s0"), (7, "", "s1"), (None, "a b", "s2"), (8, "a b c", "s1"), (8, "a b c", "s1"), (9, "x " * 9000, "s9")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_draws_are_exact(spark):
    sized = docs(spark).withColumn("size", M.word_count()).withColumn("words_", M.word_count())
    got = M.draw(sized, shards=5).toPandas()
    got["taken"] = [sum(w) for w in got["words"]]
    assert len(got) == 606 and (got["taken"] <= 3 * got["size"]).all()
    assert all(len(w) == len(s) for w, s in zip(got["words"], got["shards"]))
    for _, g in got.groupby(got["source"].fillna("~")):
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5
    again = M.draw(sized.repartition(3), shards=5).toPandas()
    key = lambda d: sorted(map(repr, zip(d["doc_id"].fillna(-1), d["size"], d["words"].map(list), d["shards"].map(list))))
    assert key(got.drop(columns="taken")) == key(again)


def test_mix_of_whole_documents(spark):
    df = docs(spark).selectExpr("*", "'z' as mix_shard", "1 as words")
    got = M.mix(df, shards=4).toPandas()
    assert list(got.columns) == ["doc_id", "text", "source", "mix_shard", "words", "_mix_shard", "mix_place", "mix_words"]
    for _, g in got.groupby("_mix_shard"):
        assert sorted(g["mix_place"]) == list(range(len(g)))
    sizes = pd.Series([len((t or "").split()) for t in got["text"]])
    assert (sizes == got["mix_words"]).all()
    assert M.mix(df.limit(0)).count() == 0


def plain_plan(rows, seed, shards):
    """(source, block) -> [(shard, words)], by loops: the quotas, the tree, the leaves' draws."""
    import hashlib
    import math

    words = {}
    for doc, source, size in rows:
        block = hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:3]
        words.setdefault(source, {}).setdefault(block, 0)
        words[source][block] += size
    sources = sorted(words)
    sizes = [sum(words[s].values()) for s in sources]
    goals = [math.floor(g + 0.5) for g in M.targets(sizes, [M.WEIGHTS[i % 3] for i in range(len(sources))])]
    whole = [g // n * len(words[s]) for g, n, s in zip(goals, sizes, sources)]
    part = [math.ceil(g % n * len(words[s]) / n) for g, n, s in zip(goals, sizes, sources)]
    rng = np.random.default_rng(seed)

    def tree(quotas, leaves):
        if leaves == 1:
            return [quotas]
        left = rng.multivariate_hypergeometric(quotas, sum(quotas) * (leaves // 2) // leaves, method="marginals").tolist()
        return tree(left, leaves // 2) + tree([q - x for q, x in zip(quotas, left)], leaves - leaves // 2)

    shares, out = tree(whole + part, shards), {}
    for k, s in enumerate(sources):
        blocks = sorted(words[s])
        for column, pool, left in ((k, [b for b in blocks for _ in range(goals[k] // sizes[k])], None), (len(sources) + k, blocks, goals[k] % sizes[k])):
            last = 0
            for leaf in range(shards):
                n = shares[leaf][column]
                if n:
                    at = np.random.default_rng([seed, column, leaf]).permutation(len(pool)).tolist()
                    for i in at[:n]:
                        take = words[s][pool[i]] if left is None else min(left, words[s][pool[i]])
                        left = None if left is None else left - take
                        if take or left is None:
                            out.setdefault((s, pool[i]), []).append((leaf, take))
                    pool, last = [pool[i] for i in sorted(at[n:])], leaf
            for i in np.random.default_rng([seed, column]).permutation(len(pool)).tolist():
                take = min(left, words[s][pool[i]])
                left -= take
                if take:
                    out.setdefault((s, pool[i]), []).append((last, take))
    return out


def test_leaves_decide_what_is_taken(spark):
    rows = [(i, f"s{i % 3}", 1 + i * 7919 % 50) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("block", M.F.substring(M.F.md5(M.F.concat_ws(":", M.F.lit("5"), M.F.col("doc_id").cast("string"))), 1, 3))
    got = {}
    for r in M.draw(df, seed=5, shards=6).collect():
        for w, s in zip(r["words"], r["shards"], strict=True):
            got.setdefault((r["source"], r["block"]), {}).setdefault(s, 0)
            got[r["source"], r["block"]][s] += w
    want = {}
    for key, draws in plain_plan(rows, 5, 6).items():
        want[key] = {}
        for s, w in draws:
            want[key][s] = want[key].get(s, 0) + w
    assert got == want
    assert {s for v in got.values() for s in v} == set(range(6))
    blocks = df.groupBy("source", "block").agg(M.F.sum("size").alias("words")).toPandas()
    plans = [M._plan(blocks, M.WEIGHTS, 1.0, seed, shards)[0] for seed, shards in ((1, 6), (1, 6), (2, 6), (1, 9))]
    assert plans[0]["part"].tolist() == plans[1]["part"].tolist()
    assert plans[0]["part"].tolist() != plans[2]["part"].tolist() and plans[0]["part"].tolist() != plans[3]["part"].tolist()
    assert len({p["part"].sum() for p in plans}) == 1


def test_query_has_several_shards(spark):
    got = M.op2_mixing(spark, "/root/testdata/sf0.001").toPandas()
    assert len({s for x in got["shards"] for s in x.split(",") if s}) > 4
    for _, g in got.groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5 and (g["taken"] <= 3 * g["size"]).all()
