"""Secret scans: sliding-window entropy by incremental counts, with an allow list.

Everything is a column expression over one text: base patterns by regular expressions (where a
match starts follows from the lengths of what stands between the matches), and candidate runs of
two character classes, over which a window slides while the counts of its characters are kept up
to date: one character enters, one leaves, and the sum of c log c changes by two table look-ups.
A candidate's span is the run from its first to its last window above the class's threshold, if no
allow-list pattern suppresses the candidate and no base span overlaps it.

Defined results
    null or empty text      no spans
    very long text          one row; work is linear in the text, and quadratic only in the number
                            of matches of one kind in one text (a copy of the list for each)
    repeated rows, null ids every row on its own
    empty table             an empty result
    extra columns           kept by ``scan``, whose own column gets a free name
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, text_or_empty


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns, group 1 the whole match, and the least length of what is kept.
KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""((?:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"  # the runs of [0-9a-f]+ that have 24 characters
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


@dataclass(frozen=True)
class CharClass:
    """Runs of one alphabet; both patterns must be found in a run for its entropy to say anything."""

    name: str
    alphabet: str
    run: str
    needs: tuple[str, ...]
    bits: float


WINDOW = 20
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CLASSES = (
    CharClass("hex", "0123456789ABCDEF", r"([0-9A-F]{20,})", ("[0-9]", "[A-F]"), 3.05),
    CharClass("base64", BASE64, r"([A-Za-z0-9+/_=-]{20,})", ("[0-9]", "[A-Z]", "[a-z]"), 3.85),
)
#: Candidates that look random and aren't secret.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",  # a UUID
    r"(?:EXAMPLE|Example|example|PLACEHOLDER|placeholder|XXXX|xxxx|0123456789|abcdefgh|ABCDEFGH)",
    r"^(?:sha1|sha224|sha256|sha384|sha512|md5)[-=]",  # a digest
    r"^/?(?:[A-Za-z]++[0-9]{0,4}+[/_=-]++)++(?:[A-Za-z]++[0-9]{0,4}+)?$",  # a path or a name of plain words
    r"^(?:[A-Z]?[a-z]{2,}+(?:[0-9]{1,4}+)?)++$",  # CamelCase words and short numbers
)


def _spans(text: Column, pattern: str, value_group: int) -> tuple[Column, Column, Column]:
    """What to put into columns of its own: the matches, their values, and what is between."""
    hit = text.rlike(pattern)
    return (
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))),
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))),
        F.when(hit, F.split(text, pattern, -1)),
    )


def _walk(matches: Column, values: Column, between: Column, kind: int, least: int) -> Column:
    """Spans of the matches whose value has ``least`` characters; positions in code points."""
    start = F.expr(f"named_struct('at', 0L, 'found', cast(array() as {SPAN}))")
    zipped = F.zip_with(F.zip_with(matches, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), F.slice(between, 1, F.size(matches)), lambda x, b: F.struct(x["m"].alias("m"), x["v"].alias("v"), F.length(b).alias("gap")))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        stop = at + F.length(x["m"])
        span = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["v"].alias("value")))
        return F.struct(stop.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.coalesce(F.aggregate(zipped, start, step, lambda acc: acc["found"]), F.expr(f"cast(array() as {SPAN})"))


def _windows(value: Column, group: CharClass) -> Column:
    """First start and last end, in ``value``, of windows with the class's entropy; null if none."""
    n = len(group.alphabet)
    table_ = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    most = WINDOW * (math.log2(WINDOW) - group.bits)  # sum of c log c at the threshold
    place = lambda i: F.instr(F.lit(group.alphabet), F.substring(value, i, F.lit(1))) - 1
    zero = F.struct(
        F.array_repeat(F.lit(0), n).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(acc, i):
        enter = place(i)
        leave = F.when(i > WINDOW, place(i - WINDOW)).otherwise(F.lit(-1))
        entering = F.get(acc["counts"], enter)
        leaving = F.when(leave < 0, 0).otherwise(F.get(acc["counts"], leave) + (leave == enter).cast("int"))
        total = acc["sum"] + F.get(table_, entering + 1) - F.get(table_, entering) - F.get(table_, leaving) + F.when(leaving > 0, F.get(table_, leaving - 1)).otherwise(0.0)
        above = (i >= WINDOW) & (total <= most)
        return F.struct(
            F.transform(acc["counts"], lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int")).alias("counts"),
            total.alias("sum"),
            F.when(acc["first"].isNull() & above, i - WINDOW).otherwise(acc["first"]).alias("first"),
            F.when(above, i).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), zero, step, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def _suspect(value: Column, group: CharClass) -> Column:
    found = F.lit(True)
    for need in group.needs:
        found = found & value.rlike(need)
    for allowed in ALLOWED:
        found = found & ~value.rlike(allowed)
    return found


def _suspects(spans: Column, group: CharClass) -> Column:
    return F.filter(spans, lambda s: _suspect(s["value"], group))


def _with_windows(spans: Column, group: CharClass) -> Column:
    return F.transform(spans, lambda s: F.struct(s.alias("s"), _windows(s["value"], group).alias("w")))


def scan(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with an array of spans (start, kind as in KINDS, stop, value), and the array's name."""
    out, steps = fresh(df, "secret_spans"), []
    whole = text_or_empty(text)
    none = F.expr(f"cast(array() as {SPAN})")
    kinds = [(ASSIGN, 0, 2, 6), (ACCESS, 1, 1, 20), (HEX, 2, 1, 24)] + [(c.run, 3, 1, WINDOW) for c in CLASSES]
    columns: dict[str, Column] = {}
    for k, (pattern, _, group, _) in enumerate(kinds):
        names = [fresh(df, f"secret_{k}_{x}") for x in ("match", "value", "between")]
        columns |= dict(zip(names, _spans(whole, pattern, group), strict=True))
        steps.append(names)
    df = df.withColumns(columns)
    base = fresh(df, "secret_base")
    runs = [fresh(df, f"secret_runs_{c.name}") for c in CLASSES]
    walked = [_walk(*map(F.col, names), kind, least) for names, (_, kind, _, least) in zip(steps, kinds, strict=True)]
    df = df.withColumns({base: F.concat(*walked[:3])} | {name: _suspects(w, c) for name, w, c in zip(runs, walked[3:], CLASSES, strict=True)})
    df = df.drop(*[x for names in steps for x in names])
    found = []
    for name, c in zip(runs, CLASSES, strict=True):
        with_windows = _with_windows(F.col(name), c)
        spans = F.transform(
            F.filter(with_windows, lambda x: x["w"].isNotNull()),
            lambda x: F.struct(
                (x["s"]["start"] + x["w"]["first"]).alias("start"),
                F.lit(3).alias("kind"),
                (x["s"]["start"] + x["w"]["last"]).alias("stop"),
                F.substring(x["s"]["value"], x["w"]["first"] + 1, x["w"]["last"] - x["w"]["first"]).alias("value"),
            ),
        )
        found.append(F.when(F.size(name) > 0, spans).otherwise(none))
    free = F.filter(F.concat(*found), lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.concat(F.col(base), free))))
    return df.drop(base, *runs), out


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the spans' order (start, then kind)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    df, spans = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(written(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col(spans)).alias("spans"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
