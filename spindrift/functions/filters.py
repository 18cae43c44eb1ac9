"""A filter language over metadata: nested dicts compiled into one Column.

Logic is two-valued: a leaf on a missing field is false, except ``$ne``, ``$nin`` and a null
target. Keys that are columns are used as such, so they are pushed to the scan; other keys are
paths into a JSON or VARIANT metadata column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = re.compile(r"[a-zA-Z0-9_.-]+")
Resolver = Callable[[str, object], tuple[Column, Column]]


def _checked(key: str) -> str:
    if not _KEY.fullmatch(key):
        raise ValueError(f"unsafe key: {key!r}")
    return key


def _kind(target) -> str:
    if isinstance(target, (list, tuple)):
        target = next((x for x in target if x is not None), None)
    return "boolean" if isinstance(target, bool) else "double" if isinstance(target, (int, float)) else "string"


def resolver(df: DataFrame, metadata: str | None = None) -> Resolver:
    """key, target -> (value, whether the key is present)."""
    kind = df.schema[metadata].dataType.simpleString() if metadata else ""

    def resolve(key: str, target) -> tuple[Column, Column]:
        if key in df.columns:
            return F.col(key), F.col(key).isNotNull()
        if metadata is None:
            raise ValueError(f"no column and no metadata for key {key!r}")
        path = "$." + _checked(key)
        parsed = F.col(metadata) if kind == "variant" else F.try_parse_json(F.col(metadata))
        return F.try_variant_get(parsed, path, _kind(target)), F.try_variant_get(parsed, path, "variant").isNotNull()

    return resolve


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in(value: Column, targets) -> Column:
    found = F.lit(False)
    if known := [x for x in targets if x is not None]:
        found = _true(value.isin(known))
    return found | value.isNull() if len(known) < len(targets) else found


def _leaf(op: str, target, value: Column, present: Column) -> Column:
    if op == "$eq":
        return value.isNull() if target is None else _true(value == F.lit(target))
    if op == "$ne":
        return ~_leaf("$eq", target, value, present)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        other = F.lit(target)
        return _true({"$gt": value > other, "$gte": value >= other, "$lt": value < other, "$lte": value <= other}[op])
    if op in ("$in", "$nin"):
        if not isinstance(target, (list, tuple)):
            raise ValueError(f"{op} takes a list")
        found = _in(value, target)
        return found if op == "$in" else ~found
    if op == "$regex":
        return _true(value.cast("string").rlike(target))
    if op == "$exists":
        return present if target else ~present
    raise ValueError(f"unknown operator: {op}")


def compile_filter(filter_: Mapping | None, resolve: Resolver) -> Column:
    """The filter as one boolean column that is never null; an empty filter is true."""
    terms = []
    for key, target in (filter_ or {}).items():
        if key == "$and":
            terms.append(reduce(lambda a, b: a & b, (compile_filter(f, resolve) for f in target), F.lit(True)))
        elif key == "$or":
            terms.append(reduce(lambda a, b: a | b, (compile_filter(f, resolve) for f in target), F.lit(False)))
        elif key == "$not":
            terms.append(~compile_filter(target, resolve))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator: {key}")
        else:
            _checked(key)
            tests = target if isinstance(target, Mapping) else {"$eq": target}
            for op, value in tests.items():
                terms.append(_leaf(op, value, *resolve(key, None if op == "$exists" else value if op != "$regex" else "")))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def apply_filter(df: DataFrame, filter_: Mapping | None, metadata: str | None = None) -> DataFrame:
    return df.filter(compile_filter(filter_, resolver(df, metadata))) if filter_ else df
