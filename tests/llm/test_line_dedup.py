import random

from spindrift.llm import line_dedup as D


def brute(rows):
    lines = [(d, i, set((x.encode()).split())) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.encode().split()]
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for k, (d, i, w) in enumerate(lines):
        if any((d, i) != (e, j) and 5 * len(w & v) >= 4 * len(w | v) for e, j, v in lines[:k]):
            gone.add((d, i))
    return {(d, i) for d, i, _ in lines}, gone


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["The", "the", "é"]
    pool = [rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 20, 60])) for _ in range(60)]
    rows = [None, "", " \n\t\n", "a", "a\na", "a a\n\x0ba"]
    for _ in range(120):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rng.shuffle(line)
            text.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append("\n".join(text))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def test_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as gone_lines")
    lines, gone = D.removed_lines(df)
    want_lines, want = brute(rows)
    assert {tuple(r) for r in lines.collect()} == want_lines
    assert {tuple(r) for r in gone.collect()} == want
    assert len(want) > 100
    got = {r.doc_id: r.text for r in D.dedup(df).collect()}
    for d, t in rows:
        left = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in want]
        touched = any((d, i) in want for i in range(100))
        if touched and not any(x.split() for x in left):
            assert d not in got
        else:
            assert got[d] == ("\n".join(left) if touched else t)


def test_edge_rows(spark):
    rows = [(1, "a b\nc"), (1, "a b\nc"), (None, "a b"), (2, "a b\nd e"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines, gone = D.removed_lines(df)
    assert [tuple(r) for r in gone.collect()] == [(2, 0)]
    assert sorted(str(r.text) for r in D.dedup(df).collect()) == ["None", "a b", "a b\nc", "a b\nc", "d e"]
    lines, gone = D.removed_lines(df.limit(0))
    assert lines.count() == gone.count() == 0


def test_families(spark, monkeypatch):
    """Many lines that share rare tokens, similar to the earliest one or not."""
    rng = random.Random(4)
    base = [f"r{i}" for i in range(12)]
    rows = []
    for d in range(150):
        line = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            line[rng.randrange(12)] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(line) + "\n" + " ".join(rng.sample(base, 4))))
    monkeypatch.setattr(D, "FAMILY", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in D.removed_lines(df)[1].collect()} == brute(rows)[1]


def test_long_lines_and_odd_spaces(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    other = words[:19_000] + [f"y{i}" for i in range(1_000)]
    less = words[:15_000] + [f"z{i}" for i in range(5_000)]
    rows = [(1, " ".join(words)), (2, "\t".join(other)), (3, "  ".join(less)), (4, " a\tb \x0bc d"), (5, "d  c b\ra "), (6, " \t \r")]
    lines, gone = D.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in lines.collect()} == {(k, 0) for k in range(1, 6)}
    assert {tuple(r) for r in gone.collect()} == {(2, 0), (5, 0)} == brute(rows)[1]


def test_many_keys_are_no_family(spark, monkeypatch):
    """Counters that are full because there are many keys, none of them frequent, mark nothing."""
    rng = random.Random(5)
    rows = [(d, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for d in range(1000)]
    lists, constant = [], D._constant
    monkeypatch.setattr(D, "COUNTERS", 32)
    monkeypatch.setattr(D, "_constant", lambda values: lists.append(values) or constant(values))
    assert D.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))[1].count() == 0
    assert len(lists) == 1 or not any(lists[1])


def test_just_similar_and_just_not(spark):
    """Pairs of lines that differ in as much as is allowed, and in one word more."""
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(600):
        n, more = rng.randint(4, 90), k % 2
        own = rng.randint(0, n // 5)
        other = (n - 5 * own) // 4 + more
        words = [f"{k}_{i}" if rng.random() < 0.8 else f"often{i}" for i in range(n)]
        later = words[own:] + [f"{k}y{i}" for i in range(other)]
        rng.shuffle(later)
        pair = [words, later] if rng.random() < 0.5 else [later, words]
        rows += [(2 * k + i, " ".join(line)) for i, line in enumerate(pair)]
        if not more:
            want.add((2 * k + 1, 0))
    assert brute(rows)[1] >= want
    assert {tuple(r) for r in D.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()} == brute(rows)[1]


def test_tables_grow_with_lines_not_pairs(spark, monkeypatch):
    """A group of lines that are all similar to each other, too small for a family."""
    base = [f"r{i}" for i in range(20)]
    rows = [(d, " ".join([*base[:-1], f"x{d}"])) for d in range(120)]
    sizes, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    gone = D.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))[1]
    assert {tuple(r) for r in gone.collect()} == {(d, 0) for d in range(1, 120)}
    assert max(sizes) <= 4 * len(rows)


def test_nearest_is_not_the_similar_one(spark, monkeypatch):
    """Without parity any meeting is as near as another: lines go by others than the first that is tried."""
    rows, calls, pairs = corpus(2)[:60], [], D._pairs
    monkeypatch.setattr(D, "_parity", lambda tokens: D.F.lit(0).cast("long"))
    monkeypatch.setattr(D, "_pairs", lambda *args: calls.append(args) or pairs(*args))
    gone = D.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))[1]
    assert {tuple(r) for r in gone.collect()} == brute(rows)[1]
    assert calls


def test_only_texts_concerned_are_split_again(spark, monkeypatch):
    rows = [(d, f"a{d} b{d} c{d} d{d} e{d}\nf{d} g{d} h{d} i{d} j{d}") for d in range(300)]
    rows[200] = (200, "x y\nf7 g7 h7 i7 j7 k7")
    split, lines_of = [], D.lines_of
    monkeypatch.setattr(D, "lines_of", lambda docs: split.append(docs.count()) or lines_of(docs))
    gone = D.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))[1]
    assert {tuple(r) for r in gone.collect()} == {(200, 1)}
    assert split[0] == 300 and len(split) > 1 and max(split[1:]) < 30


def test_few_closed_lines_are_not_written_anew(spark, monkeypatch):
    """Closed lines joined where they are read or written, keys met in memory or sorted: the same lines go."""
    rng = random.Random(7)
    base = [f"r{i}" for i in range(20)]
    rows = [(d, " ".join([*base[: rng.choice([12, 19, 20])], *(f"x{d}_{i}" for i in range(rng.choice([0, 1, 2, 8])))])) for d in range(120)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)[1]
    monkeypatch.setattr(D, "FAMILY", 20)
    kept, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: kept.append(df.columns) or cut(df))
    assert {tuple(r) for r in D.removed_lines(df)[1].collect()} == want
    assert sum("prefix" in c for c in kept) == 2
    monkeypatch.setattr(D, "CLOSED", -1)
    monkeypatch.setattr(D, "HASHED", -1)
    assert {tuple(r) for r in D.removed_lines(df)[1].collect()} == want
