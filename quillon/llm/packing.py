"""Filling containers of fixed capacity: best-two-fit over the histogram of sizes.

Sizes are whole tokens up to the capacity, so the packing needs the number of items per size, not the
items: the driver packs a histogram of at most ``capacity`` rows, whatever the corpus holds, and fills as
many containers alike as the counts allow, which uses up at least one size each time.  The items then
find their containers by their rank among the items of equal size.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import durable

from .tokenizer import count_tokens

#: Largest capacity whose histogram the driver takes; packing one in which every size occurs takes the driver minutes there, seconds at a quarter of it.
MOST_CAPACITY = 1 << 16
#: Pieces of one size that one task ranks.
SLICE_ROWS = 50_000


class _Sizes:
    """Sizes still unpacked, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def largest(self, limit: int, used: dict[int, int]) -> int | None:
        """The largest size up to ``limit`` of which more is left than ``used`` takes."""
        i = bisect.bisect_right(self.order, limit) - 1
        while i >= 0 and self.count[self.order[i]] <= used.get(self.order[i], 0):
            i -= 1
        return self.order[i] if i >= 0 else None

    def take(self, used: dict[int, int]) -> int:
        times = min(self.count[s] // n for s, n in used.items())
        for s, n in used.items():
            self.count[s] -= n * times
            if not self.count[s]:
                del self.count[s]
                del self.order[bisect.bisect_left(self.order, s)]
        return times

    def two(self, least: int, limit: int, used: dict[int, int]) -> tuple[int, int] | None:
        """The two unpacked sizes whose sum is the largest in (least, limit]."""
        best, found = least, None
        i, j = 0, bisect.bisect_right(self.order, limit) - 1
        free = lambda s, n: self.count[s] - used.get(s, 0) >= n
        while i <= j:
            a, b = self.order[i], self.order[j]
            if a + b > limit:
                j -= 1
                continue
            if a + b > best and (free(a, 2) if i == j else free(a, 1) and free(b, 1)):
                best, found = a + b, (a, b)
                if best == limit:
                    break
            i += 1
        return found


def pack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(containers, {size: items of it in each})`` for a histogram of sizes in 1..capacity.

    Each container is filled greedily with the largest size that fits; then, as long as it gets fuller,
    its smallest item makes way for two unpacked items that fit the gap so widened more tightly.
    """
    left, out = _Sizes(counts), []
    while left.order:
        used: dict[int, int] = {}
        gap = capacity
        while gap and (s := left.largest(gap, used)) is not None:
            n = min(left.count[s] - used.get(s, 0), gap // s)
            used[s] = used.get(s, 0) + n
            gap -= s * n
        while gap:
            s = min(used)
            if (pair := left.two(s, s + gap, used)) is None:
                break
            used[s] -= 1
            if not used[s]:
                del used[s]
            for x in pair:
                used[x] = used.get(x, 0) + 1
            gap -= sum(pair) - s
        out.append((left.take(used), used))
    return out


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``rank`` of each piece among those of its size, from 0: ranks in salted slices plus the slices before.

    There are as many slices as keep one of them to about ``SLICE_ROWS`` rows, were all pieces of one size.
    """
    slices = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece"), F.lit(max(256, -(-total // SLICE_ROWS)))).cast("int"))
    own = slices.withColumn("own", F.row_number().over(W.partitionBy("size", "slice").orderBy("id", "piece")) - 1)
    counts = slices.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return own.join(before, ["size", "slice"]).select("id", "piece", "size", (F.col("own") + F.col("before")).alias("rank"))


def fill_containers(sizes: DataFrame, capacity: int) -> DataFrame:
    """``container, id, piece, start, size`` of the rows of ``sizes(id, n)`` (ids distinct, n whole).

    ``container`` counts from 0.  An item over the capacity is cut into full containers and a rest, which
    is packed like an item (``piece`` from 0, ``start`` the piece's offset); no other item is split.  Items
    of size 0 (null or negative counts as 0) take no room and are spread over the containers; where there
    is no container, they share container 0.  An empty table gives no rows.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError(f"a capacity of 1 to {MOST_CAPACITY} is needed")
    spark = sizes.sparkSession
    clean = durable(sizes.select("id", F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(0)).cast("long").alias("n")))
    whole = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    pieces = clean.select("id", "n", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    pieces = pieces.select("id", "piece", F.least(F.col("n") - F.col("piece") * F.lit(capacity).cast("long"), F.lit(capacity)).cast("long").alias("size"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("size").count().collect()}  # at most capacity + 1 rows
    patterns = pack({s: n for s, n in histogram.items() if s > 0}, capacity)
    runs, base, seen = [], 0, dict.fromkeys(histogram, 0)
    for times, used in patterns:
        for s, n in used.items():
            runs.append((s, seen[s], base, n))
            seen[s] += n * times
        base += times
    containers = max(base, 1)
    runs.sort()
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 4))

    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        t, s, r = table.value, size.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64)
        if not len(t):
            return pa.array(r % containers)
        span = np.int64(1) << 41
        at = np.maximum(np.searchsorted(t[:, 0] * span + t[:, 1], s * span + r, "right") - 1, 0)
        return pa.array(np.where(s == 0, r % containers, t[at, 2] + (r - t[at, 1]) // t[at, 3]))

    where = F.arrow_udf(place, "bigint")
    return _ranked(pieces, sum(histogram.values())).select(
        where("size", "rank").alias("container"), "id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "size"
    )


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    limits = spark.read.parquet(f"{sf_dir}/size_limits.parquet")
    return limits.where("scope = 'container' and unit = 'tokens'").agg(F.min("max_size")).first()[0]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each document or of each piece of an oversized one, sizes in tokens of the 50k vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = count_tokens(docs).withColumnsRenamed({"doc_id": "id", "n_tokens": "n"})
    return fill_containers(sizes, _capacity(spark, sf_dir)).withColumnsRenamed({"container": "container_id", "id": "doc_id", "start": "first_token", "size": "n_tokens"})


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of their room that is left unused."""
    capacity = _capacity(spark, sf_dir)
    per = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    total = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("tokens").alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused_share"))
