import random
import re

from spindrift.llm import license_scan as L


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(hits)


def distance(a, b):
    """Least edits between ``a`` and any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_base_places():
    rng = random.Random(2)
    bits = ["cc", "by", "CC-BY", "MIT", "license", "License,", "gnu", "General", "public", "apache", "é", "the", "\n", "_", "x"]
    for _ in range(2000):
        text = rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", "  ", "-", ""]) for _ in range(rng.randint(0, 15)))
        n, hits = brute_base(text)
        got = L.scan_text(text)
        assert got[0] == n and sorted(L.phrase_places(L.normalize(text))) == hits and got[1] == len(hits)
        assert got[2:4] == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(got[4].split(",")) <= set(got[5].split(",")) | {""}


def test_notices_with_edits():
    rng = random.Random(3)
    for notice, label in list(L.NOTICES.items()) * 3:
        edits = L.edits_for(notice)
        chars = list(notice)
        for at in rng.sample(range(len(chars)), edits):
            chars[at] = rng.choice(["", "q", chars[at] + "z"])
        norm = L.normalize("some words before " + "".join(chars) + " and after")
        if distance(notice, norm.decode()) <= edits:
            assert label in {s[2] for s in L.notice_spans(norm)}, (notice, norm)
    for text in ["the license of a poet", "public transport is general", "permission granted", "apache helicopters", "creative people"]:
        assert L.notice_spans(L.normalize(text)) == []
    words = L.normalize("a b licenced under the apache license c").split()
    assert [words[a:b] for a, b, label, _ in L.notice_spans(b" ".join(words)) if label == "apache"][0][-1] == b"license"


def test_less_exact_notices_before_a_better_one():
    words = "mozila public license mozilla public license mozilla publik license"
    assert [x[:3] for x in L.notice_spans(L.normalize(words))] == [(0, 3, "mpl"), (3, 6, "mpl"), (6, 9, "mpl")]
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randint(1, 12)
        text = " ".join(rng.choice(["mozilla", "mozila", "mozillla"]) + " public license" for _ in range(n))
        assert [x[:2] for x in L.notice_spans(L.normalize(text)) if x[2] == "mpl"] == [(3 * k, 3 * k + 3) for k in range(n)], text


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "MIT License", "c"), (2, "mit license " * 20000, "d")], "doc_id long, text string, labels string")
    got = {(r.doc_id, r.n_words): r for r in L.scan(df).collect()}
    assert got[(None, 2)].labels == "mit" and got[(None, 2)].score == 1.0 and got[(None, 2)].first_word == 0
    assert got[(2, 40000)].n_base == 20000 and got[(2, 40000)].last_word == 39998
    assert got[(1, 0)].first_word is None and got[(1, 0)].score == 0.0
    assert L.scan(df.limit(0)).count() == 0


def test_ids_beside_a_null(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "mit license"), (None, "x"), (7, None)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.first_word) for r in L.scan(df).collect()} == {(big, 0), (None, None), (7, None)}
