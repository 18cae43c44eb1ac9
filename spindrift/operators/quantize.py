"""Scalar, binary and product quantization; models are small tables, codes are columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLOOR = 1e-8
#: Rows of a model: 65,536 dimensions, or 256 parts of 256 codes.
MOST_CODES = 1 << 16


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _extrema(vectors: DataFrame, vector: str) -> DataFrame:
    """pos, low, high: each Arrow batch gives a row for each dimension, so what is exchanged doesn't grow with the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype="i4")), pa.array(x.min(0)), pa.array(x.max(0))], ["pos", "low", "high"])

    parts = vectors.select(vector).filter(F.col(vector).isNotNull()).mapInArrow(run, "pos int, low double, high double")
    return parts.groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def fit_scalar(vectors: DataFrame, mode: str = "int8", vector: str = "embedding") -> DataFrame:
    """pos, scale, zero: one row for each dimension."""
    dims = _extrema(vectors, vector)
    if mode == "int8":
        return dims.select("pos", (F.greatest(-F.col("low"), F.col("high"), F.lit(FLOOR)) / 127).alias("scale"), F.lit(0.0).alias("zero"))
    if mode == "uint8":
        return dims.select("pos", (F.greatest(F.col("high") - F.col("low"), F.lit(FLOOR)) / 255).alias("scale"), F.col("low").alias("zero"))
    raise ValueError(f"unknown mode: {mode}")


def model_row(model: DataFrame) -> DataFrame:
    """The model as one row of two arrays, in the order of the dimensions."""
    packed = model.agg(F.sort_array(F.collect_list(F.struct("pos", "scale", "zero"))).alias("m"))
    return packed.select(F.col("m.scale").alias("scale"), F.col("m.zero").alias("zero"))


def encode_scalar(vectors: DataFrame, model: DataFrame, mode: str = "int8", vector: str = "embedding") -> DataFrame:
    """Adds ``code`` (rounded half to even, clipped) and the model's arrays ``scale`` and ``zero``."""
    low, high = (-128, 127) if mode == "int8" else (0, 255)
    joined = vectors.crossJoin(F.broadcast(model_row(model)))  # one row, as wide as a vector
    shifted = F.zip_with(F.col(vector).cast("array<double>"), "zero", lambda x, z: x - z)
    code = F.zip_with(shifted, F.col("scale"), lambda x, s: F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x / s).cast("int"))).cast("short"))
    return joined.withColumn("code", code)


def decode_scalar(code: Column, scale: Column, zero: Column) -> Column:
    scaled = F.zip_with(code, scale, lambda c, s: c * s)
    return F.zip_with(scaled, zero, lambda x, z: x + z)


def quantized_dot(encoded: DataFrame, query, code: str = "code") -> DataFrame:
    """Adds ``score``: the query's product with the decoded vectors, from the codes."""
    weighted = F.zip_with(F.lit([float(q) for q in query]), F.col("scale"), lambda q, s: q * s)
    shift = F.aggregate(F.zip_with(F.lit([float(q) for q in query]), F.col("zero"), lambda q, z: q * z), F.lit(0.0), lambda a, x: a + x)
    return encoded.withColumn("score", F.aggregate(F.zip_with(F.col(code), weighted, lambda c, w: c * w), F.lit(0.0), lambda a, x: a + x) + shift)


def reconstruction_error(encoded: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: mse, max_error, mean_cosine."""
    pairs = encoded.select(F.col(vector).cast("array<double>").alias("v"), decode_scalar(F.col("code"), F.col("scale"), F.col("zero")).alias("d"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    gaps = F.zip_with("v", "d", lambda x, y: x - y)
    dot = total(F.zip_with("v", "d", lambda x, y: x * y))
    length = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    per_row = pairs.select(
        total(F.transform(gaps, lambda g: g * g)).alias("sq"),
        F.size("v").alias("n"),
        F.array_max(F.transform(gaps, lambda g: F.abs(g))).alias("most"),
        (dot / F.greatest(length("v") * length("d"), F.lit(1e-12))).alias("cosine"),
    )
    return per_row.agg((F.sum("sq") / F.sum("n")).alias("mse"), F.max("most").alias("max_error"), F.avg("cosine").alias("mean_cosine"))


def decode_binary(words: Column, size: int) -> Column:
    """The signs as +1 and -1."""
    word = lambda i: F.get(words, F.floor(i / 64).cast("int"))
    shift = lambda i: F.least(F.lit(64), F.lit(size) - F.floor(i / 64) * 64).cast("int") - 1 - F.pmod(i, F.lit(64)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.call_function("shiftright", word(i), shift(i)).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0))


def binary_words(vector: Column, size: int) -> Column:
    """Signs (x > 0), 64 to a bigint."""
    words = []
    for start in range(0, size, 64):
        bits = F.transform(F.slice(vector, start + 1, 64), lambda x, i: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def binary_similarity(a: Column, b: Column, size: int) -> Column:
    return 1 - 2 * hamming(a, b) / F.lit(float(size))


# ---- product quantization ----------------------------------------------------------------------


def fit_product(vectors: DataFrame, m: int = 8, bits: int = 8, iterations: int = 15, seed: int = 0, vector: str = "embedding", sample: int = 50_000) -> DataFrame:
    """Codebook (sub, code, centroid) by k-means in each part, on at most ``sample`` rows."""
    if bits not in (4, 8):
        raise ValueError("bits must be 4 or 8")
    rows = vectors.select(vector).orderBy(F.xxhash64(F.lit(seed), vector)).limit(sample).collect()
    x = np.array([r[0] for r in rows], dtype="f8")
    if x.shape[1] % m:
        raise ValueError(f"{x.shape[1]} dimensions can't be cut into {m} parts")
    width, rng, out = x.shape[1] // m, np.random.default_rng(seed), []
    for sub in range(m):
        own = x[:, sub * width : (sub + 1) * width]
        k = min(2**bits, len(own))
        centers = own[rng.choice(len(own), k, replace=False)]
        for _ in range(iterations):
            near = ((own**2).sum(1)[:, None] - 2 * own @ centers.T + (centers**2).sum(1)).argmin(1)
            counts = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, own[:, j], k) for j in range(width)], 1)
            empty = counts == 0
            centers = np.where(empty[:, None], own[rng.integers(0, len(own), k)], sums / np.maximum(counts, 1)[:, None])
        out += [(sub, code, [float(v) for v in c]) for code, c in enumerate(centers)]
    return vectors.sparkSession.createDataFrame(out, "sub int, code int, centroid array<double>")


def codebook_from_rows(vectors: DataFrame, m: int, codes: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A fixed codebook: the parts of the rows with ids 0 .. codes - 1."""
    first = vectors.filter(F.col(vec_id) < codes)
    width = F.floor(F.size(vector) / m).cast("int")
    subs = first.select(F.col(vec_id).cast("int").alias("code"), F.col(vector).alias("v"), width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("sub"))
    return subs.select("sub", "code", F.expr("cast(slice(v, sub * w + 1, w) as array<double>)").alias("centroid"))


def codebook_array(codebook: DataFrame) -> np.ndarray:
    """(parts, codes, width) of a codebook table: at most ``m * 2**bits`` rows, by its making."""
    rows = codebook.limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} rows in a codebook")
    m, codes = 1 + max(r["sub"] for r in rows), 1 + max(r["code"] for r in rows)
    out = np.full((m, codes, len(rows[0]["centroid"])), np.inf)
    for r in rows:
        out[r["sub"], r["code"]] = r["centroid"]
    return out


def nearest_codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(rows, parts): the nearest centroid of each part, ties (to nine digits) to the smaller code."""
    m, _, width = book.shape
    out = np.empty((len(x), m), dtype="i2")
    for at in range(0, len(x), 1024):
        for sub in range(m):
            own = x[at : at + 1024, sub * width : (sub + 1) * width]
            gaps = ((own[:, None, :] - book[sub][None, :, :]) ** 2).sum(2)
            out[at : at + 1024, sub] = np.round(gaps, 9).argmin(1)
    return out


def encode_arrays(vectors: DataFrame, codebook: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, codes: an array of one code for each part; no shuffle."""
    book, kind = codebook_array(codebook), vectors.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = nearest_codes(matrix(batch.column(1)), book)
            offsets = np.arange(len(codes) + 1, dtype="i4") * book.shape[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1)))], [vec_id, "codes"])

    return vectors.select(vec_id, vector).mapInArrow(run, f"`{vec_id}` {kind}, codes array<short>")


def encode_product(vectors: DataFrame, codebook: DataFrame, m: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, sub, code: a row for each part."""
    codes = encode_arrays(vectors, codebook, vec_id, vector)
    return codes.select(vec_id, F.posexplode("codes").alias("sub", "code")).select(vec_id, "sub", F.col("code").cast("int").alias("code"))


def decode_arrays(codes: DataFrame, codebook: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """vec_id, decoded, from (vec_id, codes)."""
    book, kind = codebook_array(codebook), codes.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(1)).astype("i4")
            decoded = book[np.arange(book.shape[0])[None, :], own].reshape(len(own), -1) if len(own) else np.zeros((0, 0))
            offsets = np.arange(len(own) + 1, dtype="i4") * decoded.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(decoded.reshape(-1)))], [vec_id, "decoded"])

    return codes.select(vec_id, "codes").mapInArrow(run, f"`{vec_id}` {kind}, decoded array<double>")


def decode_product(codes: DataFrame, codebook: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """vec_id, decoded, from a row for each part."""
    arrays = codes.groupBy(vec_id).agg(F.sort_array(F.collect_list(F.struct("sub", "code"))).alias("p"))
    return decode_arrays(arrays.select(vec_id, F.col("p.code").alias("codes")), codebook, vec_id)


def distance_table(book: np.ndarray, query) -> np.ndarray:
    """(parts, codes): squared distances of the query's parts."""
    parts = np.asarray(query, dtype="f8").reshape(book.shape[0], 1, book.shape[2])
    return ((parts - book) ** 2).sum(2)


def table_sum(codes: Column, table: np.ndarray) -> Column:
    """The sum of a table's entries at an array of codes, as a column expression."""
    width = table.shape[1]
    flat = F.lit([float(v) if np.isfinite(v) else None for v in table.reshape(-1)])
    return F.aggregate(F.transform(codes, lambda c, i: F.get(flat, (i * width + c).cast("int"))), F.lit(0.0), lambda a, v: a + v)


def adc_search(codes: DataFrame, codebook: DataFrame, query, top_k: int, vec_id: str = "vec_id") -> DataFrame:
    """Squared distances of (vec_id, codes) to the query from a table of part distances; no shuffle but the top k."""
    table = distance_table(codebook_array(codebook), query)
    return codes.select(vec_id, F.round(table_sum(F.col("codes"), table), 6).alias("score")).orderBy("score", vec_id).limit(top_k)


def product_error(vectors: DataFrame, codebook: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: mse, max_error, mean_cosine of decoded codes; nothing is exchanged but a row for each batch."""
    book = codebook_array(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                d = book[np.arange(book.shape[0])[None, :], nearest_codes(x, book)].reshape(len(x), -1)
                cosine = (x * d).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(d, axis=1), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (float(((x - d) ** 2).sum()), x.size, float(np.abs(x - d).max()), float(cosine.sum()), len(x))], ["sq", "n", "most", "cosine", "rows"])

    parts = vectors.select(vector).mapInArrow(run, "sq double, n long, most double, cosine double, rows long")
    return parts.agg((F.sum("sq") / F.sum("n")).alias("mse"), F.max("most").alias("max_error"), (F.sum("cosine") / F.sum("rows")).alias("mean_cosine"))


# ---- models as text ----------------------------------------------------------------------------


def dump_model(model: DataFrame) -> str:
    """A fitted model (scalar or product) as JSON: its columns and rows, which are few."""
    rows = sorted(([v for v in r] for r in model.limit(MOST_CODES + 1).collect()), key=lambda r: r[:2])
    if len(rows) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} rows in a model")
    return json.dumps({"columns": [[c, t] for c, t in model.dtypes], "rows": rows})


def load_model(spark: SparkSession, text: str) -> DataFrame:
    held = json.loads(text)
    return spark.createDataFrame([tuple(r) for r in held["rows"]], ", ".join(f"{c} {t}" for c, t in held["columns"]))
