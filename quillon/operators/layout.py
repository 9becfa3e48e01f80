"""Column layout of a page from the horizontal positions of its characters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins a page width, share of the mean density below which a bin is empty, least bins of a gap, characters of a complex page.
BINS, EMPTY_SHARE, LEAST_BINS, COMPLEX_CHARS = 50, 0.1, 2, 1000


def histogram(chars: DataFrame) -> DataFrame:
    """``page, bin, n`` for all bins of every page of ``chars(page, x, width)``.

    Positions left of the page count in the first bin, right of it in the last; null positions and pages
    without a width are left out.
    """
    x = chars.where(F.col("x").isNotNull() & (F.col("width") > 0))
    b = F.least(F.greatest(F.floor(F.col("x") * BINS / F.col("width")), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = x.groupBy("page", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # a page has at most BINS counted bins, so the array of them is small
    packed = counts.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return packed.select("page", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), "m").select("page", "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("long").alias("n"))


def smoothed(hist: DataFrame) -> DataFrame:
    """The histogram with ``smooth``, the mean of a bin and its neighbours (fewer at the edges)."""
    return hist.withColumn("smooth", F.avg("n").over(W.partitionBy("page").orderBy("bin").rowsBetween(-1, 1)))


def gaps(hist: DataFrame) -> DataFrame:
    """``page, first_bin, last_bin``: maximal runs of bins at most ``EMPTY_SHARE`` of the mean, of ``LEAST_BINS`` or more."""
    page = W.partitionBy("page")
    marked = smoothed(hist).withColumn("low", F.col("smooth") <= F.lit(EMPTY_SHARE) * F.sum("n").over(page) / BINS)
    run = F.col("bin") - F.row_number().over(W.partitionBy("page", "low").orderBy("bin"))
    runs = marked.withColumn("run", run).where("low").groupBy("page", "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))
    return runs.where(F.col("last_bin") - F.col("first_bin") + 1 >= LEAST_BINS).select("page", "first_bin", "last_bin")


def layouts(hist: DataFrame) -> DataFrame:
    """``page, layout_type, column_count, extraction_method``."""
    found = gaps(hist).groupBy("page").agg(F.count(F.lit(1)).alias("g"))
    sized = hist.groupBy("page").agg(F.sum("n").alias("chars")).join(found, "page", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    many, complex_ = F.col("g") > 0, F.col("chars") > COMPLEX_CHARS
    return sized.select(
        "page",
        F.when(many, "multi_column").when(complex_, "complex").otherwise("single_column").alias("layout_type"),
        (F.col("g") + 1).cast("int").alias("column_count"),
        F.lit("coordinate_based").alias("extraction_method"),
    )


def column_pairs(gap_rows: DataFrame, widths: DataFrame) -> DataFrame:
    """``page, column, left, right``: consecutive pairs of the sorted distinct edges 0, gap ends and page width."""
    edges = gap_rows.join(widths, "page").select("page", "width", F.array((F.col("first_bin") * F.col("width") / BINS), F.when(F.col("last_bin") == BINS - 1, F.col("width")).otherwise((F.col("last_bin") + 1) * F.col("width") / BINS)).alias("e"))
    own = edges.groupBy("page", "width").agg(F.flatten(F.collect_list("e")).alias("e"))
    sorted_ = own.withColumn("e", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("width")), "e"))))
    n = F.size("e")
    each = sorted_.where(n >= 2).select("page", "e", F.posexplode(F.sequence(F.lit(0), n - 2, F.lit(2))).alias("k", "i"))
    return each.select("page", (F.col("k") + 1).alias("column"), F.get("e", F.col("i")).alias("left"), F.get("e", F.col("i") + 1).alias("right"))


def page_layout(x: list[float], width: float) -> tuple[str, int, str, list[tuple[float, float]]]:
    """``layout_type, column_count, extraction_method`` of one page from its characters' positions, and its columns.

    What ``layouts`` and ``column_pairs`` find for many pages, for a reader that has the page in hand; a page without
    characters or width is a standard one of one column.
    """
    if not x or not width or width <= 0:
        return "single_column", 1, "standard", []
    n = np.bincount(np.clip(np.floor(np.asarray(x, float) * BINS / width), 0, BINS - 1).astype(int), minlength=BINS)
    around = np.convolve(n, np.ones(3)), np.convolve(np.ones(BINS), np.ones(3))
    low = np.concatenate(([False], around[0][1:-1] / around[1][1:-1] <= EMPTY_SHARE * n.sum() / BINS, [False]))
    first, last = np.flatnonzero(low[1:] & ~low[:-1]), np.flatnonzero(low[:-1] & ~low[1:]) - 1
    found = [(int(a), int(b)) for a, b in zip(first, last) if b - a + 1 >= LEAST_BINS]
    if not found:
        return "complex" if len(x) > COMPLEX_CHARS else "single_column", 1, "coordinate_based", []
    edges = sorted({0.0, float(width), *[a * width / BINS for a, _ in found], *[float(width) if b == BINS - 1 else (b + 1) * width / BINS for _, b in found]})
    return "multi_column", len(found) + 1, "coordinate_based", [(edges[i], edges[i + 1]) for i in range(0, len(edges) - 1, 2)]
