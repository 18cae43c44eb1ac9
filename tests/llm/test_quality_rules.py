import random
import re

from spindrift.llm import quality_rules as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The counts, the base verdict and the whole verdict, by plain loops."""
    t = text or ""
    words = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    c = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(x in "#*$%&|<>" for x in t),
        "n_dup_lines": sum(x in lines[:k] for k, x in enumerate(lines)),
        "n_repeat_words": len(covered),
    }
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    stops = sum(w in Q.STOP_WORDS for w in words)
    runs = re.findall(r"[^\W\d_]+", t)
    shouted = sum(len(r) > 1 and all(x.isupper() for x in r) for r in runs)
    n = len(words)
    good = 2 * n <= c["word_chars"] <= 18 * n and c["n_symbols"] <= 0.3 * n and stops >= 0.02 * n and shouted <= 0.3 * n
    good = good and c["n_dup_lines"] <= 0.5 * len(lines) and len(covered) <= 0.3 * n
    return c | {"base_failed": failed, "kept": not failed and good}


def corpus():
    rng = random.Random(8)
    vocabulary = ["the", "of", "and", "Wind", "é", "ALL", "CAPS", "#1", "a*b", "<p>", "x", "harbour", "lighthouse", "und", "que", "\x85", "100%"]
    rows = [None, "", " \n\t\x0b", "one", "the " * 20, "the " * 19, "a b c d e f g h " * 3, "\n\n", "x\nx\nx"]
    for _ in range(150):
        words = rng.choices(vocabulary, k=rng.randint(15, 90))
        if rng.random() < 0.4:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(5, 30)]
        rows.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
    return list(enumerate(rows))


def judged(df):
    out, name, failed, kept = Q.judge(df)
    return out.select("doc_id", f"{name}.*", failed.alias("base_failed"), kept.alias("kept"))


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.asDict() for r in judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, repr(t)
    assert len({got[i]["kept"] for i, _ in rows}) == 2


def test_long_texts_and_rare_repeats(spark):
    rng = random.Random(1)
    words = [f"word{rng.randrange(10**9)}" for _ in range(150_000)]
    text = " ".join(words + words[70_000:70_010] + ["the"] * 3)
    row = judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (150_013, 20, False)


def test_edge_rows(spark):
    good = "the harbour of the town and the sea was calm that day as the boats went out to fish for the market"
    rows = [(1, good, "a", 1), (1, good, "a", 1), (None, good, "b", 2), (2, None, None, None), (3, "", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_counts string, Quality_Words long")
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.filter("length(text) > 0").collect()))
    empty = Q.keep_good(df.limit(0))
    assert empty.columns == df.columns and empty.count() == 0


def test_other_rules(spark):
    df = spark.createDataFrame([(1, "the " * 30), (2, "the harbour and the long grey sea wall of stone " + " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    long_words = (Q.Rule("mean word length", "word_chars", "n_words", low=30.0),)
    assert Q.keep_good(df, rules=long_words).count() == 0
    assert [r.doc_id for r in Q.keep_good(df, rules=()).collect()] == [2]
