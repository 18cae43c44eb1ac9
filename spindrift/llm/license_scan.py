"""License scans: fuzzy search of short notices by exact seeds and bounded-error verification.

A notice of n characters found with at most k edits, cut into k + 1 parts, has one part unchanged
(pigeonhole). A substring search for each part, which most texts don't have, finds all places; only
around these the ``regex`` library's bounded-error matching (``{e<=k}``) looks for the notice
itself and reports its best span. The base phrases, whole words in a row, are exact.

Normalization: A-Z in lower case; words are runs of ASCII letters and digits and of anything
outside ASCII; words are joined by one space. Matching is on UTF-8 bytes, where an edit of a
character outside ASCII counts once for each byte.

Defined results
    null or empty text      0 words, no labels, score 0
    very long text          whole; windows around seeds that touch are searched as one
    repeated rows, null ids every row on its own
    empty table             an empty result
    extra columns           not read
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Phrases of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices as they stand in texts, normalized, with their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "apache software license": "apache",
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the above copyright notice and this permission notice shall be included in": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "this work is licensed under a creative commons": "cc",
    "licensed under cc by": "cc-by",
}
#: One edit is allowed for so many characters of a notice, and so many at most.
CHARACTERS_PER_EDIT = 12
MOST_EDITS = 3


def edits_for(notice: str, per_edit: int = CHARACTERS_PER_EDIT) -> int:
    return min(MOST_EDITS, max(1, len(notice) // per_edit))


_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normalize(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORDS).split())


def phrase_places(norm: bytes) -> list[tuple[int, str]]:
    """(word, label) of every place where a base phrase stands."""
    if b"license" not in norm and b"cc by" not in norm:
        return []
    padded, found = b" " + norm + b" ", []
    for phrase, label in PHRASES.items():
        want = b" " + phrase.encode() + b" "
        at = padded.find(want)
        word, counted = 0, 0
        while at >= 0:
            word, counted = word + padded.count(b" ", counted, at), at
            found.append((word, label))
            at = padded.find(want, at + 1)
    return found


@cache
def _searcher(per_edit: int):
    """The seeds with the notices they belong to, and each notice with its edits and pattern."""
    import regex

    notices, seeds = [], {}
    for notice, label in NOTICES.items():
        edits = edits_for(notice, per_edit)
        cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            seeds.setdefault(notice[a:b].encode(), []).append((len(notices), a))
        notices.append((notice, label, edits, regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")))
    return seeds, notices


def _matches(pattern, text: str, start: int, stop: int):
    """Matches of a window, also those before a better one: a best match search passes over them."""
    parts = [(start, stop)]
    while parts:
        start, stop = parts.pop()
        m = pattern.search(text, start, stop) if start < stop else None
        if m and m.end() > m.start():
            yield m
            parts += [(start, m.start()), (m.end(), stop)]


def notice_spans(norm: bytes, per_edit: int = CHARACTERS_PER_EDIT) -> list[tuple[int, int, str, float]]:
    """(first word, word after the last, label, similarity) of every notice found."""
    seeds, notices = _searcher(per_edit)
    places: dict[int, list[int]] = {}  # notice -> where it might start
    for seed, owners in seeds.items():
        at = norm.find(seed)
        while at >= 0:
            for n, shift in owners:
                places.setdefault(n, []).append(at - shift)
            at = norm.find(seed, at + 1)
    if not places:
        return []
    text = norm.decode("latin-1")
    windows: dict[int, list[list[int]]] = {}
    for n, starts in places.items():
        notice, _, edits, _ = notices[n]
        own = windows.setdefault(n, [])
        for at in sorted(starts):
            start, stop = at - edits, at + len(notice) + edits
            if own and start <= own[-1][1]:
                own[-1][1] = max(own[-1][1], stop)
            else:
                own.append([start, stop])
    found, spaces = [], np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 0x20)
    before = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  spaces in text[:at]
    for n, own in windows.items():
        notice, label, _, pattern = notices[n]
        for start, stop in own:
            for m in _matches(pattern, text, max(0, start), min(len(text), stop)):
                first = before(m.start() + (text[m.start()] == " "))
                found.append((first, before(m.end()) + 1 - (text[m.end() - 1] == " "), label, 1 - sum(m.fuzzy_counts) / len(notice)))
    return sorted(set(found))


def scan_text(text: str | None) -> tuple:
    norm = normalize(text or "")
    base = phrase_places(norm)
    spans = notice_spans(norm)
    words = [w for w, _ in base]
    return (
        norm.count(b" ") + 1 if norm else 0,
        len(base),
        min(words, default=None),
        max(words, default=None),
        ",".join(sorted({x for _, x in base})),
        ",".join(sorted({x for _, x in base} | {s[2] for s in spans})),
        1.0 if base else max((round(s[3], 6) for s in spans), default=0.0),
        ",".join(f"{label}:{a}:{b}" for a, b, label, _ in spans),
    )


#: The columns of a scan and their types.
COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "notice_spans": pa.string()}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["doc_id", *COLUMNS])

    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notice_spans string")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
