import hashlib
import random

import numpy as np

from spindrift.llm import repeats as R


def brute(rows, length=50):
    """Per row, from a table of every string of ``length`` bytes and the least id that holds it."""
    least = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), dtype=bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i : i + length]] < d:
                    gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)
        out.append((str(d), len(b), int(gone.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghij é\n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([30, 49, 50, 51, 80, 300]))) for _ in range(25)]
    rows = [None, "", "short", "a" * 49, "a" * 50, "a" * 500, "ab" * 300, "ba" * 100]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
            if rng.random() < 0.4:
                a = rng.randint(0, len(p))
                p = p[a:] if rng.random() < 0.5 else p[:a] + rng.choice(letters) + p[a:]
            parts.append(p)
        rows.append("".join(parts))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows, strict=True))
    return rows + [rows[9], (rows[10][0], rows[11][1]), (None, rows[12][1])]


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        data = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abc\0") for _ in range(rng.randint(1, 300))) + b"c"
        order = R.suffix_array(data, 10**6)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        got = R.common_prefixes(data, order, 50)
        for k in range(1, len(order)):
            a, b = data[order[k] :], data[order[k - 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[k] == min(n, 50), (data, order[k], order[k - 1])


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as data")
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove(df).collect())
        assert got == brute(rows)
    assert R.remove(df.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab ") for _ in range(rng.choice([0, 10, 49, 50, 51, 700]))) for _ in range(40)]
    want = sorted(b for t in texts for b in (t[i : i + 50] for i in range(len(t) - 49)))
    monkeypatch.setattr(R, "PIECE_BYTES", 64)
    got = []
    for group in R.pieces(texts):
        data, _, row, first, start, windows = R.runs(group)
        for r, f, s, w in zip(row.tolist(), first.tolist(), start.tolist(), windows.tolist()):
            assert 0 < w <= R.RUN and texts[r][f : f + w + 49] == data[s : s + w + 49]
            got += [data[s + k : s + k + 50] for k in range(w)]
    assert sorted(got) == want


def test_arrays_merge_by_binary_search(monkeypatch):
    rng = random.Random(7)
    pool = [bytes(rng.choice(b"abc\0") for _ in range(120)) for _ in range(6)]
    snippets = sorted({p[a : a + rng.randint(50, 100)] for p in pool for a in range(0, 60, 7)} - {b""})
    snippets = [s for s in snippets if len(s) >= 50]
    least = np.array([rng.randrange(100) for _ in snippets])
    held = {}
    for s, i in zip(snippets, least.tolist()):
        for k in range(len(s) - 49):
            held[s[k : k + 50]] = min(i, held.get(s[k : k + 50], i))
    want = [held[s[k : k + 50]] for s in snippets for k in range(len(s) - 49)]
    for size in (1 << 20, 500, 60):
        monkeypatch.setattr(R, "ARRAY_BYTES", size)
        assert R.least_by_window(snippets, least).tolist() == want


def test_small_arrays_pieces_and_many_shards(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(R, "SHARD_BYTES", (1500, 3000))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove(df).collect())
    assert got == brute(rows)


def test_large_and_negative_ids(spark):
    text = "the quick brown fox jumps over the lazy dog and then some more of it"
    rows = [(2**62 + 1, text), (2**62, "x " + text), (-5, text[:50] + "!"), (None, text)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    kept = {r.doc_id: r.kept for r in R.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[None].decode() == text and kept[2**62 + 1] == b""
