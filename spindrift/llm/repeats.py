"""Suffix-array dedup: bytes covered by a string of 50 bytes that also starts in an earlier document.

Which 50-byte windows could be equal is settled by content first. A window's anchor is the least
hash of its 35 grams of 16 bytes, so equal windows have equal anchors, and neighbouring windows
mostly share theirs: a run of windows with one anchor is a snippet of the text, some 70 bytes.

The texts are exchanged once, by shards of documents; all steps below read that one exchange. What
travels between the shards and the buckets of anchors is packed numbers, never places in texts.

1.  Shards send their anchors. Buckets tell which occur in two documents; all windows of the others
    are out.
2.  Shards send what they have of those: anchor, digest of the snippet, least document id. Where all
    snippets of an anchor are the same, its least document id decides for all its windows.
3.  Where they differ (the ends of passages, mostly), shards send the snippets. A bucket puts the
    sorted lists of its shards together by binary search, builds suffix arrays over the distinct
    snippets in numpy (Larsson-Sadakane: groups that are still undecided are refined by the ranks h
    bytes on, with h doubling) and their common prefixes by Kasai's order: along runs of the text
    where the preceding suffix also moves on by one, a prefix is one shorter than the last.
    Neighbours with 50 bytes in common are equal windows; the least document id that holds one
    decides. Arrays are of bounded size; those that share an anchor are merged by binary search of
    one's sorted windows in the other's.
4.  Shards merge the spans that go and cut them out.

Defined results
    null or empty text      no bytes, no spans
    null ids                take no part: nothing is removed, and they remove nothing
    very long text          one row, taken in overlapping pieces
    repeated rows           equal ids don't remove from each other; each row loses its own spans
    empty table             an empty result
    extra columns           not read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .shingles import _RANDOM, _tables, mix

LENGTH, GRAM = 50, 16
#: Bytes of a shard of documents (as many as the table needs, up to MANY; then they grow, up to the
#: second figure), of a suffix array, and of what is hashed at once; windows of a snippet.
SHARD_BYTES, MANY, ARRAY_BYTES, PIECE_BYTES, RUN = (16 << 20, 256 << 20), 4096, 2 << 20, 1 << 18, 64
CODE, DIGEST = 5, 6  # bytes


def words_at(data: bytes, order: str = "<") -> np.ndarray:
    """The eight bytes from each position on, zeros after the end, as numbers."""
    return np.ndarray((len(data),), f"{order}u8", data + bytes(8), 0, (1,)).astype(np.uint64)


def pieces(texts) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, offset, bytes); every window stands in one piece."""
    group, held = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - LENGTH + 1, PIECE_BYTES):
            part = t[at : at + PIECE_BYTES + LENGTH - 1]
            group.append((k, at, part))
            held += len(part)
            if held >= PIECE_BYTES:
                yield group
                group, held = [], 0
    if group:
        yield group


def runs(group: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group's bytes, and of every run of windows with one anchor: anchor, row, first window in
    the row's text, first window in the bytes, windows."""
    data = b"".join(part for _, _, part in group)
    sizes = np.array([len(part) for _, _, part in group])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    n = len(data) - LENGTH + 1
    word = words_at(data)
    low = mix(word[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ mix(word[8:]))[: len(data) - GRAM + 1]
    span, reach = 1, LENGTH - GRAM + 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[:n], low[reach - span :][:n])
    low = low[:n]
    first = np.zeros(n + 1, dtype=bool)  # where a run starts, and where windows that cross pieces do
    first[1:n] = low[1:] != low[:-1]
    crossing = np.concatenate([bounds[1:] - LENGTH + 1, bounds])
    first[crossing[(crossing >= 0) & (crossing <= n)]] = True
    first[n] = False
    starts = np.flatnonzero(first)
    stops = np.concatenate((starts[1:], [n]))
    piece = np.searchsorted(bounds, starts, "right") - 1
    inside = (piece < len(group)) & (starts + LENGTH <= bounds[np.minimum(piece + 1, len(group))])
    starts, stops, piece = starts[inside], stops[inside], piece[inside]
    parts = -(-(stops - starts) // RUN)
    if (parts > 1).any():  # periodic texts: a run every RUN windows
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, stops, piece = np.repeat(starts, parts) + RUN * nth, np.repeat(stops, parts), np.repeat(piece, parts)
        stops = np.minimum(starts + RUN, stops)
    rows, offsets = np.array([k for k, _, _ in group]), np.array([at for _, at, _ in group])
    return data, mix(low[starts]), rows[piece], starts - bounds[piece] + offsets[piece], starts, stops - starts


def digests(data: bytes, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of each snippet, 48 bits of a hash of its bytes."""
    up, down = _tables(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_RANDOM[np.frombuffer(data, dtype=np.uint8)] * up[: len(data)], dtype=np.uint64)))
    size = windows + LENGTH - 1
    return mix((sums[starts + size] - sums[starts]) * down[starts] + size.astype(np.uint64)) >> np.uint64(64 - 8 * DIGEST)


# ---- suffix arrays -------------------------------------------------------------------------------


def suffix_array(data: bytes, depth: int = LENGTH) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes."""
    key, n = words_at(data, ">"), len(data)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, dtype=bool)
    place, rank, h = np.arange(n), np.empty(n, dtype=np.int64), 8
    while h < depth:
        group = np.maximum.accumulate(np.where(new, place, 0))
        rank[order] = group
        open_ = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if not len(open_):
            break
        own, first = order[open_], group[open_]
        second = np.where(own + h < n, rank[np.minimum(own + h, n - 1)], -1)
        both = first * (n + 1) + second + 1
        by = np.argsort(both, kind="stable")
        both = both[by]
        order[open_] = own[by]
        new[open_] = np.concatenate(([True], both[1:] != both[:-1]))
        h *= 2
    return order


def common_prefixes(data: bytes, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """For each place in ``order``: bytes in common with the place before, ``cap`` at most (Kasai's
    order, taken for whole runs of the text at once)."""
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    b = np.frombuffer(data, dtype=np.uint8)
    i = np.arange(n)
    same = (before >= 0) & (b == b[before])
    moves_on = np.zeros(n, dtype=bool)
    moves_on[:-1] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1)
    # From each position, how far the run goes: to a different byte, or to where it ends and a direct comparison starts.
    stop = np.where(~same | ~moves_on, i, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    ends = np.flatnonzero(same & ~moves_on)
    length = np.zeros(n, dtype=np.int64)
    word, left = words_at(data, ">"), ends
    size = np.zeros(len(ends), dtype=np.int64)
    alive = np.arange(len(ends))
    for step in range(0, cap + 8, 8):
        if not len(alive):
            break
        x, y = left[alive] + step, before[left[alive]] + step
        fits = np.maximum(x, y) < n
        d = np.where(fits, word[np.minimum(x, n - 1)] ^ word[np.minimum(y, n - 1)], np.uint64(1 << 63))
        equal = d == 0
        size[alive] += sum((d < np.uint64(1 << bit)).astype(np.int64) for bit in range(0, 64, 8))
        alive = alive[equal]
    length[ends] = np.minimum(size, n - np.maximum(ends, before[ends]))
    out = np.where(stop < n, stop - i + length[np.minimum(stop, n - 1)], 0)
    return np.minimum(out, cap)[order]


def common(keys: list[np.ndarray], least: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted arrays of distinct windows with the least document id of each: the least over all arrays,
    by binary search of each one's windows in the others'."""
    out = [x.copy() for x in least]
    for i, own in enumerate(keys):
        for j, other in enumerate(keys):
            if i != j and len(own) and len(other):
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                out[i] = np.minimum(out[i], np.where(other[at] == own, least[j][at], out[i]))
    return out


class Array:
    """The suffix array of some distinct snippets: their windows in order, in groups of equal ones."""

    def __init__(self, snippets: list[bytes], least: np.ndarray):
        self.data = b"".join(snippets)
        sizes = np.array([len(s) for s in snippets])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(snippets)), sizes)
        self.is_window = np.arange(len(self.data)) - begins[owner] + LENGTH <= sizes[owner]
        order = suffix_array(self.data)
        group = np.cumsum(common_prefixes(self.data, order) < LENGTH) - 1
        kept = self.is_window[order]
        self.order, group = order[kept], group[kept]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        self.group, self.firsts = np.cumsum(first) - 1, np.flatnonzero(first)
        self.least = np.minimum.reduceat(least[owner[self.order]], self.firsts)

    def keys(self) -> np.ndarray:
        """The distinct windows, sorted."""
        all_ = np.ndarray((len(self.data) - LENGTH + 1,), f"S{LENGTH}", self.data, 0, (1,))
        return all_[self.order[self.firsts]]

    def by_window(self) -> np.ndarray:
        """For every window, in the order of the snippets: the least document id that holds it."""
        out = np.empty(len(self.data), dtype=np.int64)
        out[self.order] = self.least[self.group]
        return out[self.is_window]


def least_by_window(snippets: list[bytes], least: np.ndarray) -> np.ndarray:
    """For every window of the distinct ``snippets``, in order: the least document id that holds it.

    Arrays are built over ARRAY_BYTES of snippets at a time and merged."""
    sizes = np.cumsum([len(s) for s in snippets])
    cuts = np.flatnonzero(np.diff(sizes // ARRAY_BYTES, prepend=0))
    bounds = [0, *cuts[cuts > 0].tolist(), len(snippets)]
    arrays = [Array(snippets[a:b], least[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    if len(arrays) > 1:
        for array, found in zip(arrays, common([a.keys() for a in arrays], [a.least for a in arrays]), strict=True):
            array.least = found
    return np.concatenate([a.by_window() for a in arrays])


# ---- what travels --------------------------------------------------------------------------------


def packed(values: np.ndarray, size: int) -> np.ndarray:
    """Numbers as rows of ``size`` big-endian bytes, so that rows sort as the numbers do."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :])


def unpacked(data: bytes, size: int) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, size)
    out = np.zeros((len(rows), 8), dtype=np.uint8)
    out[:, 8 - size :] = rows
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _named(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Anchors as bucket + shards * code; the code is what travels to the bucket."""
    n = np.uint64(shards)
    return (anchor // n & np.uint64((1 << 8 * CODE) - 1)) * n + anchor % n


def _snippet_keys(code: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """(code, digest) as sortable strings of bytes."""
    both = np.concatenate((packed(code, CODE), packed(digest, DIGEST)), 1)
    return np.ascontiguousarray(both).view(f"S{CODE + DIGEST}").reshape(-1)


class Shard:
    """The documents of a shard as arrays of runs, for the steps that follow the anchors."""

    def __init__(self, docs: pa.Table, shards: int):
        self.shards = shards
        self.texts = [x or b"" for x in docs.column("data").to_pylist()]
        self.ids = docs.column("rank").fill_null(0).to_numpy()
        self.takes_part = docs.column("rank").is_valid().to_numpy(zero_copy_only=False)

    def groups(self) -> Iterator[list[tuple[int, int, bytes]]]:
        return pieces(t if p else b"" for t, p in zip(self.texts, self.takes_part, strict=True))

    def anchors(self) -> np.ndarray:
        """Named anchors, once or, if they occur in more documents, twice."""
        found = []
        for group in self.groups():
            _, anchor, row, _, _, _ = runs(group)
            name = _named(anchor, self.shards)
            order = np.lexsort((row, name))
            name, row = name[order], row[order]
            found.append(name[np.concatenate(([True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])))] if len(name) else name)
        names = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return names[np.concatenate(([True, True], names[2:] != names[:-2]))] if len(names) > 2 else names

    def marked(self, names: np.ndarray, digest: bool = True, snippets: bool = False):
        """Of the runs whose anchor is among the sorted ``names``, group by group: name, digest, row,
        first window, windows, and if asked for, the snippets."""
        if not len(names):
            return
        for group in self.groups():
            data, anchor, row, first, start, windows = runs(group)
            name = _named(anchor, self.shards)
            hit = np.flatnonzero(names[np.minimum(np.searchsorted(names, name), len(names) - 1)] == name)
            if len(hit):
                name, row, first, start, windows = name[hit], row[hit], first[hit], start[hit], windows[hit]
                cut_out = [data[s : s + w + LENGTH - 1] for s, w in zip(start.tolist(), windows.tolist(), strict=True)] if snippets else None
                yield name, digests(data, start, windows) if digest else None, row, first, windows, cut_out


def _by_bucket(name: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Buckets with their parts of ``name``, which is sorted by bucket."""
    bucket = name % np.uint64(shards)
    starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=False):
        yield int(bucket[a]), slice(int(a), int(b))


def _table(kinds: dict, rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})


_ANCHORS = {"bucket": pa.int32(), "shard": pa.int32(), "codes": pa.binary()}
_REPEATED = {"shard": pa.int32(), "bucket": pa.int32(), "codes": pa.binary()}
_ENTRIES = {"bucket": pa.int32(), "shard": pa.int32(), "codes": pa.binary(), "digests": pa.binary(), "ids": pa.binary()}
_SNIPPETS = _ENTRIES | {"sizes": pa.binary(), "snippets": pa.binary()}
#: Per code of the shard: whether its snippets differ, else the least id; or per snippet (code and digest) its spans of windows.
_DECIDED = {"shard": pa.int32(), "bucket": pa.int32(), "codes": pa.binary(), "differ": pa.binary(), "digests": pa.binary(), "counts": pa.binary(), "windows": pa.binary(), "ids": pa.binary()}


def _ddl(kinds: dict) -> str:
    return ", ".join(f"{c} {'int' if t == pa.int32() else 'binary'}" for c, t in kinds.items())


def _anchors(shards: int):
    def run(docs: pa.Table) -> pa.Table:
        names = Shard(docs, shards).anchors()
        names = names[np.argsort(names % np.uint64(shards), kind="stable")]
        own = docs.column("shard")[0].as_py()
        return _table(_ANCHORS, [(b, own, packed(names[s] // np.uint64(shards), CODE).tobytes()) for b, s in _by_bucket(names, shards)])

    return run


def _repeated(group: pa.Table) -> pa.Table:
    lists = [unpacked(x, CODE) for x in group.column("codes").to_pylist()]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    if len(twice):
        bucket = group.column("bucket")[0].as_py()
        for shard, codes in zip(group.column("shard").to_pylist(), lists, strict=True):
            codes = np.unique(codes)
            codes = codes[twice[np.minimum(np.searchsorted(twice, codes), len(twice) - 1)] == codes]
            if len(codes):
                rows.append((shard, bucket, packed(codes, CODE).tobytes()))
    return _table(_REPEATED, rows)


def _names(replies: pa.Table, shards: int, kept=lambda k: slice(None)) -> np.ndarray:
    """Sorted names of the anchors in replies to a shard."""
    found = [unpacked(c, CODE)[kept(k)] * np.uint64(shards) + np.uint64(b) for k, (b, c) in enumerate(zip(replies.column("bucket").to_pylist(), replies.column("codes").to_pylist(), strict=True))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _distinct(parts: list, ids: np.ndarray, shards: int) -> tuple:
    """The distinct snippets of a shard by bucket, code and digest: names, digests, least ids, and where they stand in ``parts``."""
    name, digest = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    own = np.concatenate([ids[p[2]] for p in parts])
    order = np.lexsort((own, digest, name, name % np.uint64(shards)))
    name, digest, own = name[order], digest[order], own[order]
    first = np.concatenate(([True], (name[1:] != name[:-1]) | (digest[1:] != digest[:-1])))
    return name[first], digest[first], own[first], order[first]


def _entries(shards: int, snippets: bool):
    """What a shard has of the anchors that buckets have asked for; with the snippets where they differ."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = _SNIPPETS if snippets else _ENTRIES
        if not docs.num_rows or not replies.num_rows:
            return _table(kinds, [])
        if snippets:
            differ = replies.column("differ").to_pylist()
            names = _names(replies, shards, lambda k: np.frombuffer(differ[k], dtype=bool))
        else:
            names = _names(replies, shards)
        shard, own = Shard(docs, shards), docs.column("shard")[0].as_py()
        parts = list(shard.marked(names, snippets=snippets))
        if not parts:
            return _table(kinds, [])
        name, digest, ids, at = _distinct(parts, shard.ids, shards)
        texts = [t for p in parts for t in p[5]] if snippets else []
        rows = []
        for bucket, s in _by_bucket(name, shards):
            row = (bucket, own, packed(name[s] // np.uint64(shards), CODE).tobytes(), packed(digest[s], DIGEST).tobytes(), ids[s].astype("<i8").tobytes())
            if snippets:
                some = [texts[i] for i in at[s].tolist()]
                row += (bytes(map(len, some)), b"".join(some))
            rows.append(row)
        return _table(kinds, rows)

    return run


def _lists(group: pa.Table) -> tuple[list, list, list]:
    columns = (group.column(c).to_pylist() for c in ("codes", "digests", "ids"))
    found = [(unpacked(c, CODE), unpacked(d, DIGEST), np.frombuffer(i, dtype="<i8")) for c, d, i in zip(*columns, strict=True)]
    return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def _agree(group: pa.Table) -> pa.Table:
    """Per code: whether its snippets differ, and if not, the least id."""
    codes, digest, ids = _lists(group)
    every, all_digests, all_ids = np.concatenate(codes), np.concatenate(digest), np.concatenate(ids)
    order = np.argsort(every, kind="stable")
    every, all_digests, all_ids = every[order], all_digests[order], all_ids[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    known, least = every[first], np.minimum.reduceat(all_ids, first)
    differ = np.minimum.reduceat(all_digests, first) != np.maximum.reduceat(all_digests, first)
    rows, bucket = [], group.column("bucket")[0].as_py()
    for shard, own in zip(group.column("shard").to_pylist(), codes, strict=True):
        own = np.unique(own)
        at = np.searchsorted(known, own)
        rows.append((shard, bucket, packed(own, CODE).tobytes(), differ[at].tobytes(), None, None, None, least[at].astype("<i8").tobytes()))
    return _table(_DECIDED, rows)


def _decide(group: pa.Table) -> pa.Table:
    """Per snippet: the spans of its windows that have one least id."""
    codes, digest, ids = _lists(group)
    sizes = [np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in group.column("sizes").to_pylist()]
    texts = group.column("snippets").to_pylist()
    keys = [_snippet_keys(c, d) for c, d in zip(codes, digest, strict=True)]
    # The lists of all shards in one: each is sorted, and finds its place by binary search.
    distinct = np.unique(np.concatenate(keys))
    places = [np.searchsorted(distinct, k) for k in keys]
    snippets: list[bytes] = [b""] * len(distinct)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    for place, size, text, own in zip(places, sizes, texts, ids, strict=True):
        np.minimum.at(least, place, own)
        ends = np.cumsum(size)
        for p, a, b in zip(place.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
            snippets[p] = text[a:b]
    # Whole codes at a time, as long as they are small.
    code = np.frombuffer(distinct.tobytes(), dtype=np.uint8).reshape(-1, CODE + DIGEST)[:, :CODE]
    new = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
    held = np.cumsum([0] + [len(s) for s in snippets])
    bounds, at = [0], 0
    for stop in [*new.tolist(), len(snippets)]:
        if held[stop] - held[bounds[-1]] > ARRAY_BYTES and at > bounds[-1]:
            bounds.append(at)
        at = stop
    bounds.append(len(snippets))
    lowest = np.concatenate([least_by_window(snippets[a:b], least[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)])
    windows = np.diff(held) - LENGTH + 1
    of = np.repeat(np.arange(len(distinct)), windows)
    seg = np.flatnonzero(np.concatenate(([True], (lowest[1:] != lowest[:-1]) | (of[1:] != of[:-1]))))
    seg_windows = np.diff(np.concatenate((seg, [len(lowest)]))).astype(np.uint8)
    counts = np.bincount(of[seg], minlength=len(distinct))
    begin = np.cumsum(counts) - counts
    rows, bucket = [], group.column("bucket")[0].as_py()
    for shard, place, c, d in zip(group.column("shard").to_pylist(), places, codes, digest, strict=True):
        n = counts[place]
        at = np.repeat(begin[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append((shard, bucket, packed(c, CODE).tobytes(), None, packed(d, DIGEST).tobytes(), n.astype(np.uint8).tobytes(), seg_windows[at].tobytes(), lowest[seg[at]].astype("<i8").tobytes()))
    return _table(_DECIDED, rows)


def _spans(shard: Shard, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the bytes that go."""
    n = np.uint64(shard.shards)
    names, differ, least, keys, counts, windows, ids = ([] for _ in range(7))
    for r in replies.to_pylist():
        code = unpacked(r["codes"], CODE)
        if r["digests"] is None:
            names.append(code * n + np.uint64(r["bucket"]))
            differ.append(np.frombuffer(r["differ"], dtype=bool))
            least.append(np.frombuffer(r["ids"], dtype="<i8"))
        else:
            name = code * n + np.uint64(r["bucket"])
            keys.append(np.concatenate((packed(name, 8), packed(unpacked(r["digests"], DIGEST), DIGEST)), 1))
            counts.append(np.frombuffer(r["counts"], dtype=np.uint8))
            windows.append(np.frombuffer(r["windows"], dtype=np.uint8))
            ids.append(np.frombuffer(r["ids"], dtype="<i8"))
    out = [np.zeros((0, 3), dtype=np.int64)]
    if names:
        names, differ, least = np.concatenate(names), np.concatenate(differ), np.concatenate(least)
        order = np.argsort(names)
        names, differ, least = names[order], differ[order], least[order]
        if keys:
            keys = np.ascontiguousarray(np.concatenate(keys)).view(f"S{8 + DIGEST}").reshape(-1)
            counts, windows, ids = np.concatenate(counts).astype(np.int64), np.concatenate(windows).astype(np.int64), np.concatenate(ids)
            begin = np.cumsum(counts) - counts
            order = np.argsort(keys)
            keys, counts, begin = keys[order], counts[order], begin[order]
            before = np.cumsum(windows) - windows  # windows ahead, over all spans
        for name, digest, row, first, size, _ in shard.marked(names):
            at = np.searchsorted(names, name)
            own = shard.ids[row]
            same = ~differ[at] & (least[at] < own)
            out.append(np.stack((row[same], first[same], first[same] + size[same] + LENGTH - 1), 1))
            odd = np.flatnonzero(differ[at])
            if len(odd):
                key = np.ascontiguousarray(np.concatenate((packed(name[odd], 8), packed(digest[odd], DIGEST)), 1)).view(f"S{8 + DIGEST}").reshape(-1)
                place = np.searchsorted(keys, key)
                times = counts[place]
                seg = np.repeat(begin[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                run = np.repeat(odd, times)
                start = first[run] + before[seg] - np.repeat(before[begin[place]], times)
                gone = ids[seg] < own[run]
                out.append(np.stack((row[run][gone], start[gone], (start + windows[seg] + LENGTH - 1)[gone]), 1))
    found = np.concatenate(out)
    return found[:, 0], found[:, 1], found[:, 2]


def merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, stop) rows that overlap or touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[first, 0], np.concatenate((reach[first[1:] - 1], reach[-1:]))), 1)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that are left."""
    data = text_or_empty(text).cast("binary")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = int(max(8, size // min(SHARD_BYTES[1], max(SHARD_BYTES[0], size // MANY))))
    shard = F.pmod(F.xxhash64(F.col(doc_id), data), F.lit(shards)).cast("int").alias("shard")
    rows = docs.select(shard, F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("long").alias("rank"), data.alias("data"))
    by_shard = lambda df: rows.groupBy("shard").cogroup(df.groupBy("shard"))  # noqa: E731  the texts' exchange is the same each time

    anchors = rows.groupBy("shard").applyInArrow(_anchors(shards), _ddl(_ANCHORS))
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated, _ddl(_REPEATED))
    entries = by_shard(repeated).applyInArrow(_entries(shards, False), _ddl(_ENTRIES))
    agreed = entries.groupBy("bucket").applyInArrow(_agree, _ddl(_DECIDED))
    snippets = by_shard(agreed).applyInArrow(_entries(shards, True), _ddl(_SNIPPETS))
    decided = agreed.union(snippets.groupBy("bucket").applyInArrow(_decide, _ddl(_DECIDED)))

    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        part = Shard(own, shards)
        row, start, stop = _spans(part, replies)
        order = np.argsort(row, kind="stable")
        row, start, stop = row[order], start[order], stop[order]
        bounds = np.searchsorted(row, np.arange(len(part.texts) + 1))
        counts, kept = [], []
        for k, whole in enumerate(part.texts):
            spans = merge(np.stack((start[bounds[k] : bounds[k + 1]], stop[bounds[k] : bounds[k + 1]]), 1))
            at, left = 0, []
            for a, b in spans.tolist():
                left.append(whole[at:a])
                at = b
            left = b"".join((*left, whole[at:]))
            counts.append((len(whole), len(whole) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            if keep_text:
                kept.append(left)
        columns = [own.column("doc_id"), *(pa.array([c[i] for c in counts], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
        return pa.table(columns + ([pa.array(kept, pa.binary())] if keep_text else []), names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_shard(decided).applyInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {"op3_repeats": op3_repeats}
ORACLES: dict[str, str] = {}
