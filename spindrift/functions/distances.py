"""Vector arithmetic as column expressions. All sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Norms below this count as zero.
EPSILON = 1e-10
#: Larger is better for these; smaller for the others.
SIMILARITIES = {"cosine", "dot"}
#: Queries of a pairwise table: so many vectors are known to be small enough to be sent to all tasks.
MOST_QUERIES = 20_000
METRICS = ("cosine", "dot", "euclidean", "l2", "manhattan")


def literal(vector) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """Unit length; vectors of (nearly) no length stay as they are."""
    return F.when(norm(v) > EPSILON, F.transform(doubles(v), lambda x: x / norm(v))).otherwise(doubles(v))


def to_float32(v: Column) -> Column:
    return v.cast("array<float>")


def prepare_vector(v: Column, unit: bool = False) -> Column:
    return to_float32(normalize(v) if unit else v)


def cosine_similarity(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """In [-1, 1]; 0 if either vector has no length."""
    na, nb = norm(a), norm(b)
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_product(a, b) / (na * nb)))
    return F.when((na < epsilon) | (nb < epsilon), F.lit(0.0)).otherwise(ratio)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


_DISTANCES = {
    "cosine": cosine_distance,
    "euclidean": euclidean_distance,
    "l2": euclidean_distance,
    "manhattan": manhattan_distance,
    "dot": lambda a, b: -dot_product(a, b),
}


def metric_name(metric: str) -> str:
    name = metric.lower()
    if name not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return name


def compute_distance(a: Column, b: Column, metric: str) -> Column:
    """Smaller is nearer, for every metric."""
    return _DISTANCES[metric_name(metric)](a, b)


def score(a: Column, b: Column, metric: str) -> Column:
    """What a search reports: similarity for cosine and dot, else the distance."""
    name = metric_name(metric)
    if name == "cosine":
        return cosine_similarity(a, b)
    return dot_product(a, b) if name == "dot" else compute_distance(a, b, name)


def larger_is_better(metric: str) -> bool:
    return metric_name(metric) in SIMILARITIES


def pairwise_distances(xs: DataFrame, ys: DataFrame, metric: str, x: str, y: str) -> DataFrame:
    """Every row of ``xs``, a stated query set, with every row of ``ys`` and their distance.

    ``ys`` may be a whole table: it is read where it lies, and the queries, ``MOST_QUERIES`` at most,
    come to it as blocks."""
    asked = xs.limit(MOST_QUERIES + 1).count()
    if asked > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; split them")
    return ys.crossJoin(F.broadcast(xs)).withColumn("distance", compute_distance(F.col(x), F.col(y), metric))


def register(spark: SparkSession) -> None:
    """The kernels as SQL functions of the session."""
    total = "aggregate({0}, 0D, (s, x) -> s + x)"
    square = total.format("transform(v, x -> x * x)")
    arrays = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    bodies = {
        "dot_product": (arrays, total.format("zip_with(a, b, (x, y) -> x * y)")),
        "euclidean_distance": (arrays, f"sqrt({total.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')})"),
        "manhattan_distance": (arrays, total.format("zip_with(a, b, (x, y) -> abs(x - y))")),
        "vector_norm": ("v ARRAY<DOUBLE>", f"sqrt({square})"),
        "cosine_similarity": (arrays, f"CASE WHEN vector_norm(a) < {EPSILON} OR vector_norm(b) < {EPSILON} THEN 0D ELSE greatest(-1D, least(1D, dot_product(a, b) / (vector_norm(a) * vector_norm(b)))) END"),
    }
    for name, (arguments, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
