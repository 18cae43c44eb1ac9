"""Operators for large training corpora. Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "mixing",
    "html_text",
    "learned_search",
    "license_scan",
    "line_dedup",
    "near_dedup",
    "quality_rules",
    "repeats",
    "secret_scan",
    "packing",
)


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
