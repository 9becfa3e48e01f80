"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_defects, languages, near_duplicates, packing, page_noise, ranking, splitting, tokenizer

_MODULES = (answer_defects, page_noise, near_duplicates, ranking, splitting, tokenizer, packing, languages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in vars(m).items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in getattr(m, "SQL", {}).items()}
