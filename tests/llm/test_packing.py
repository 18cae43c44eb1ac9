import collections
import random
import zlib

import numpy as np
import pytest

from spindrift.llm import packing as P


def placed(histogram, size):
    fill = collections.defaultdict(dict)
    for length, first, end, sequence, n, offset in P.place(histogram, size):
        for r in range(first, end):
            s, o = sequence + (r - first) % n, offset + length * ((r - first) // n)
            assert o not in fill[s]
            fill[s][o] = length
    return fill


@pytest.mark.parametrize("seed", range(8))
def test_place_is_gapless_and_whole(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 64, 1024])
    histogram = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    fill = placed(histogram, size)
    assert collections.Counter(x for s in fill.values() for x in s.values()) == collections.Counter(histogram)
    for s in fill.values():
        at = 0
        for o in sorted(s):
            assert o == at
            at += s[o]
        assert at <= size
    assert sorted(fill) == list(range(len(fill)))


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    path = P.default_tokenizer()
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    encode = P.Encoder(path)
    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "a \n b", "it's  we'll\n\n x", "é 中文 12 3!? ", "x\n y", "a  b  c", "\n\n a b\n\n c", "<|endoftext|> x", "don't 's", "ß\tü ö", "a\x85 b \x85c", "x\x1c y"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(" \n\tab'sé1!中 ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark):
    rows = [(1, "a b c " * 2000), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "y z")] + [(k, "w " * k) for k in range(10, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as _rank")
    got = P.pack_documents(df).toPandas()
    encode = P.Encoder(P.default_tokenizer())
    want = collections.Counter()
    for doc, text in rows:
        ids = encode(text or "") + b"\0\0\0\0"
        for s in range(0, len(ids) // 4, 1024):
            part = ids[4 * s : 4 * s + 4096]
            want[(doc, s, len(part) // 4, zlib.crc32(part), len(ids) // 4)] += 1
    assert collections.Counter((None if d != d else int(d), *r) for d, *r in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024
    assert P.pack_documents(df.limit(0)).count() == 0


def test_added_tokens_equal_tokenizers(spark):
    from tokenizers import Tokenizer

    path = P.default_tokenizer()
    model = Tokenizer.from_file(path)
    encode = P.Encoder(path, added=True)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "  <|endoftext|>  y\n", "<|endoftext| >", "no token here", ""]
    rng = random.Random(2)
    texts += ["".join(rng.choice([" ", "\n", "a", "'s", "1", "<|endoftext|>", "<|", "|>", "endoftext"]) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)
    df = spark.createDataFrame(list(enumerate(texts[:8])), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in P.pieces(df, path).collect()}
    for k, text in enumerate(texts[:8]):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, P.END_ID], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))


@pytest.mark.parametrize("histogram, sequences", [({400: 1000}, 500), ({10: 1000}, 10), ({1024: 7}, 7), ({1000: 3, 10: 7}, 4), ({513: 2, 511: 2}, 2), ({100: 25}, 3)])
def test_new_sequences_are_filled(histogram, sequences):
    assert len(placed(histogram, 1024)) == sequences


def test_padding_of_narrow_histograms():
    rng = random.Random(5)
    for _ in range(50):
        low = rng.randint(1, 300)
        histogram = {rng.randint(low, low + 60): rng.randint(1, 3000) for _ in range(rng.randint(1, 40))}
        used = sum(k * n for k, n in histogram.items())
        fewest = -(-sum(histogram.values()) // (1024 // min(histogram)))
        assert len(placed(histogram, 1024)) <= max(fewest, -(-used // (1024 - max(histogram)))) + 1


def test_ids_beside_a_null(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b"), (None, "x"), (7, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in P.pack_documents(df).collect()} == {big, None, 7}
    kept = {r.doc_id: r.ids for r in P.pieces(df, P.default_tokenizer(), keep_ids=True).collect()}
    assert kept[7] == [P.END_ID] and len(kept[big]) == 3
