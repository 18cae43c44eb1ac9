"""The pipeline against a plain version of its filters, and the mixing and packing of what is left."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from spindrift.llm import packing as P
from spindrift.llm.common import table
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_version(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF).cache()
    assert good.columns == names and 0 < good.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]

    _, gone = brute_lines(rows)
    want = {}
    for d, t in rows:
        left = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        if any(x.split() for x in left):
            want[d] = "\n".join(left)
    lines = stages["line_dedup"](spark, good, SF).cache()
    assert lines.columns == names
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages["near_dedup"](spark, lines, SF).cache()
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in brute_near(list(want.items()), 5).items() if i == c}

    mixed = stages["mixing"](spark, near, SF).cache()
    assert mixed.columns == names
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in near.collect()}

    packed = stages["packing"](spark, mixed, SF).toPandas()
    encode = P.Encoder(P.default_tokenizer())
    want = collections.Counter()
    for r in mixed.collect():
        ids = encode(r.text) + b"\0\0\0\0"
        for s in range(0, len(ids) // 4, 1024):
            want[(r.doc_id, s, zlib.crc32(ids[4 * s : 4 * s + 4096]))] += 1
    assert collections.Counter(zip(packed["doc_id"], packed["start"], packed["ids_crc32"])) == want
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = np.array("the of and harbour sea wind light stone boat rope tide gull fog sand north bell rain dusk wave buoy".split())
    text = lambda n: " ".join(f"{w}{k}" if w not in ("the", "of", "and") else w for w, k in zip(rng.choice(words, n), rng.integers(0, 99, n)))
    rows = [(i, text(40 + i), f"s{i % 3}" if i % 5 else None, "x") for i in range(40)]
    long = text(30_000)
    rows += [(None, text(50), "s0", "y"), (7, rows[7][1], "s1", "z"), (100, long, "s2", None), (101, None, "s0", "n"), (102, "", None, "e"), (103, rows[3][1] + " more", "s1", "c"), (104, "\n\n" + rows[4][1], None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_words string").selectExpr("*", "1 as quality_kept", "2 as gone_lines", "3 as length", "4 as sequence_id")
    df.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").toPandas()
    ids = set(got["doc_id"].dropna().astype(int))
    assert ids <= set(range(41)) | {100} and not ids & {101, 102, 103, 104}
    encode = P.Encoder(P.default_tokenizer())
    if 100 in ids:
        times = len(got[(got["doc_id"] == 100) & (got["start"] == 0)])
        assert got[got["doc_id"] == 100]["length"].sum() == times * (len(encode(long)) // 4 + 1)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
