"""Bounded samples by the hash of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNIT = 1 << 30


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of distinct keys, those of least hash among a share of the table that has about half as many more.

    The share follows from the table's count, so tasks pass on about ``1.5 * rows`` rows in all, however
    many tasks there are.
    """
    total = df.count()
    h = F.pmod(F.xxhash64(*keys), F.lit(_UNIT))
    share = min(1.0, (1.5 * rows + 100) / max(1, total))
    return df.where(h < int(share * _UNIT)).dropDuplicates(keys).orderBy(h, *keys).limit(rows)
