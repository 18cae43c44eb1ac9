"""Keys made from values: digests of vectors and filters, and masked secrets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SHOWN = 8


@F.pandas_udf(StringType())
def _md5(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else hashlib.md5(np.asarray(v, dtype="<f4").tobytes()).hexdigest())


def vector_key(vector: Column) -> Column:
    """MD5 of a vector's 32-bit floats."""
    return _md5(vector.cast("array<float>"))


def filter_key(filter_: Mapping | None) -> str:
    """Eight digits of the MD5 of a filter, whatever the order of its keys."""
    return hashlib.md5(json.dumps(filter_ or {}, sort_keys=True).encode()).hexdigest()[:8]


def masked(key: Column) -> Column:
    """The first characters of a key; the others don't show."""
    return F.concat(F.left(key, F.lit(SHOWN)), F.lit("…"))
