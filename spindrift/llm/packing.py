"""Packing: shortest-pack-first over the histogram of lengths.

Documents become token ids in one Arrow pass and are cut every ``size`` ids; a whole piece is a
sequence of its own. The other pieces are known to the driver only by their histogram (at most
``size - 1`` numbers): lengths are placed longest first, each into the sequences that are the
shortest so far, and what is recorded is a few ranges "pieces of this length and these ranks stand
in these sequences at this offset". The pieces find their place by their rank among pieces of equal
length, which is counted in hashed buckets whose number grows with the pieces, so that a length
held by a third of all pieces is ranked by many tasks.

Defined results
    null or empty text      one piece: the end id alone
    very long text          whole pieces and one rest; one row of ids at a time
    repeated rows           each row is packed on its own; equal rows tie and are interchangeable
    null ids                packed like others
    empty table             an empty result
    extra columns           not read
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

SIZE = 1024
END_ID = 0
#: Entries that one worker keeps of chunk -> ids; it starts anew beyond that.
CACHE_ENTRIES = 600_000
#: Hashed buckets in which pieces of one length are ranked: so many at least, and one for so many pieces.
BUCKETS, BUCKET_PIECES = 64, 250_000


# ---- tokens ------------------------------------------------------------------------------------

#: The splitting pattern and the byte alphabet of byte-level BPE files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _added(path: str) -> list[str]:
    """The file's added tokens."""
    with open(path, encoding="utf-8") as file:
        return [token["content"] for token in json.load(file).get("added_tokens") or []]


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte string -> id, if the file's merges are in the order of their ids; else None."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    hidden = [b for b in range(256) if b not in set(PRINTABLE)]
    byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = model["vocab"]
    merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merged)}


class Encoder:
    """Text -> ids as little-endian 32-bit bytes, the ids of ``tokenizers`` with the file's model.

    Byte-level BPE never joins across a space that precedes a word, so a text is split at spaces
    and each chunk's ids are kept: most chunks of natural text have been seen. Texts with a space
    before other white space, where that doesn't hold, are encoded as a whole.

    With ``added``, the file's added tokens get their ids where they stand in a text, as
    ``tokenizers`` does with ``add_special_tokens=False``; without, they are spelled out.
    """

    _joint = re.compile(r" (?=\s)| $|^ ")

    def __init__(self, path: str, added: bool = False):
        ranks = _ranks(path)
        self.added = _added(path) if added else []
        if self.added or ranks is None:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = not added
            self.model_ids = lambda text: model.encode(text, add_special_tokens=False).ids
        if ranks is not None:
            import tiktoken

            encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.ids = encoding.encode_ordinary
        else:
            self.ids = self.model_ids
        outer = self

        class Cache(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(chunk) > 200:
                    return outer.whole(chunk)
                self[chunk] = found = outer.whole(chunk)
                return found

        self.cache = Cache()
        self.by_chunk = ranks is not None

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.model_ids(text), dtype="<u4").tobytes()
        if not self.by_chunk or self._joint.search(text):
            return self.whole(text)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        first, *rest = text.split(" ")
        return b"".join([self.whole(first), *map(self.cache.__getitem__, [" " + x for x in rest])])


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Per piece of a document: where it starts, its length, checksum, and the document's ids in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, added=True)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            own, rows, kept = [], [], []
            for k, value in enumerate(batch.column(1)):
                ids = (encode(value.as_py()) if value.is_valid else b"") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    own.append(k)
                    rows.append((start, len(part) // 4, zlib.crc32(part), total))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype("i4"))
            columns = [batch.column(0).take(pa.array(own, pa.int64())), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []), names)

    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    return df.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


# ---- placing -----------------------------------------------------------------------------------


def place(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Shortest pack first: ranges (length, first rank, end rank, first sequence, sequences, offset).

    The piece of that length and rank r, first <= r < end, stands in sequence
    first sequence + (r - first) % sequences, at offset + length * ((r - first) // sequences).
    """
    ranges, packs, next_sequence = [], [], 0  # packs: heap of (filled, first sequence, sequences)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= size:
                filled, first, n = heapq.heappop(packs)
                used = min(n, left)
                if used < n:
                    heapq.heappush(packs, (filled, first + used, n - used))
                # As often as these remain the shortest, all at once.
                shortest = packs[0][0] if packs else size
                times = max(1, min(left // used, (size - filled) // length, 1 + (shortest - filled) // length))
            else:
                # None has room: new sequences, which stay the shortest until they are full.
                used = -(-left // (size // length))
                filled, first, times = 0, next_sequence, left // used
                next_sequence += used
            # The first of the sequences get one piece more, where there are no more sequences to fill.
            more = 0 if filled else left - used * times
            ranges.append((length, rank, rank + used * times + more, first, used, filled))
            rank, left = rank + used * times + more, left - used * times - more
            for at, n, held in ((first, more, filled + length * (times + 1)), (first + more, used - more, filled + length * times)):
                if n and held < size:
                    heapq.heappush(packs, (held, at, n))
    return ranges


def pack(pieces_: DataFrame, size: int = SIZE, buckets: int | None = None) -> DataFrame:
    """``pieces_`` (doc_id, start, length, ids_crc32, ...) with sequence_id and offset."""
    spark = pieces_.sparkSession
    buckets = buckets or max(BUCKETS, pieces_.count() // BUCKET_PIECES)
    salted = pieces_.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = cut(salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    ranges = place(histogram, size)
    places = spark.createDataFrame(ranges, "length long, _first long, _end long, _sequence long, _sequences long, _offset long")
    # A few rows for each length and placing step: bounded by `size`, not by the data.
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    among = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(among) - 1).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))).drop(places["length"])
    step = F.col("_rank") - F.col("_first")
    return placed.withColumn("sequence_id", F.col("_sequence") + F.pmod(step, F.col("_sequences"))).withColumn("offset", F.col("_offset") + F.col("length") * F.floor(step / F.col("_sequences"))).drop("_bucket", "_rank", "_before", "_first", "_end", "_sequence", "_sequences", "_offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Tokenize, cut and pack: a row per piece. The pieces are kept, so texts are encoded once."""
    out = pack(cut(pieces(docs, tokenizer or default_tokenizer(), size=size)), size)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
