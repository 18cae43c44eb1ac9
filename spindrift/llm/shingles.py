"""Word shingles as 64-bit hashes, for many texts at a time in numpy.

Words are hashed without a loop: with t(b) a random number for each byte value, a word's hash is
the sum of t(b) * r**position over its bytes, from prefix sums modulo 2**64, divided by
r**(its start), and mixed. Texts are taken in slices of bounded size that end at white space, so
memory doesn't grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 20
_rng = np.random.default_rng(20240229)
_RANDOM = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACES = b" \t\n\x0b\f\r"
_IS_SPACE = np.array([b in _SPACES for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_powers_cache = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers_cache:
        _powers_cache.clear()
        _powers_cache[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _powers_cache[size]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``data`` (lower-cased in ASCII)."""
    b = np.frombuffer(data.translate(_LOWER), dtype=np.uint8)
    word = np.concatenate(([False], ~_IS_SPACE[b], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, stops = edges[::2], edges[1::2]
    up, down = _tables(len(b))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_RANDOM[b] * up[: len(b)], dtype=np.uint64)))
    return starts, mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        stop = at + SLICE
        if stop < len(text):
            cut = max(text.rfind(bytes([s]), at, stop) for s in _SPACES)
            if cut <= at:  # a word longer than a slice
                later = [x for s in _SPACES if (x := text.find(bytes([s]), stop)) >= 0]
                cut = min(later, default=len(text))
            stop = cut
        yield text[at:stop]
        at = stop


def words_of(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For consecutive groups of texts: word hashes, and the bounds of each text's words in them."""
    group: list[bytes] = []
    held = 0

    def flush():
        starts, hashes = _hash_words(b" ".join(group))
        begins = np.cumsum([0] + [len(g) + 1 for g in group])
        return hashes, np.searchsorted(starts, begins)

    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and held + len(data) > SLICE:
            yield flush()
            group, held = [], 0
        if len(data) > SLICE:
            parts = [_hash_words(s)[1] for s in _slices(data)]
            hashes = np.concatenate(parts)
            yield hashes, np.array([0, len(hashes)])
        else:
            group.append(data)
            held += len(data) + 1
    if group:
        yield flush()


def shingle_sets(texts: Iterable[str | None], size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer words is one shingle, or none."""
    for hashes, bounds in words_of(texts):
        n = max(0, len(hashes) - size + 1)
        full = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            full += hashes[k : n + k] * _FACTORS[k]
        full = mix(full)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(full[a : b - size + 1])
            elif b > a:
                short = (hashes[a:b] * _FACTORS[size : size + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short]))
            else:
                yield np.zeros(0, dtype=np.uint64)
