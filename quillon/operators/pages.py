"""Pages, combined documents and the page intervals of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import filled

#: Pages joined into one row of a combined document.
BLOCK_PAGES = 500
#: Characters of a document in one bucket of the interval join.
BUCKET_CHARS = 8192


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per (doc_id, page); repeated rows hold the same page, a late one may fill a null in."""
    names = [c for c in ("text", "layout_type", "column_count", "extraction_method") if c in pages.columns]
    return pages.groupBy("doc_id", "page").agg(*[F.max(c).alias(c) for c in names])


def running_total(df: DataFrame, key: str, order: str, value: Column, name: str, slices: int = 256) -> DataFrame:
    """``name``: sum of ``value`` over the earlier rows of the key, by a whole number ``order``.

    Totals of slices of ``slices`` consecutive numbers are summed first, so that a window never holds more
    than one slice of a hot key and one row per slice.
    """
    cut = df.withColumn("_v", value).withColumn("_slice", F.floor(F.col(order) / slices).cast("long"))
    per = cut.groupBy(key, "_slice").agg(F.sum("_v").alias("_s"))
    before = per.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum("_v").over(W.partitionBy(key, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_in", inside).join(before, [key, "_slice"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_v", "_slice", "_before", "_in")


def marked(page: Column, text: Column) -> Column:
    return F.concat(F.lit("\n--- PAGE "), page.cast("string"), F.lit(" ---\n"), text, F.lit("\n"))


def page_bounds(pages: DataFrame) -> DataFrame:
    """``doc_id, page, start, end``: half-open intervals of the non-blank pages in the combined document."""
    kept = pages.where(filled(F.col("text")))
    size = F.length(marked(F.col("page"), F.col("text"))).cast("long")
    return running_total(kept.withColumn("_n", size), "doc_id", "page", F.col("_n"), "start").select("doc_id", "page", "start", (F.col("start") + F.col("_n")).alias("end"))


def combine_pages(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """``doc_id, block, start, text``: the pages of a document with their markers, joined in blocks.

    The texts of a document's blocks in order are its combined text; a block has at most ``block_pages``
    page numbers, so a document of any length stays in rows of bounded size.
    """
    kept = pages.where(filled(F.col("text"))).withColumn("block", F.floor((F.col("page") - 1) / block_pages).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct("page", marked(F.col("page"), F.col("text")).alias("t"))))
    blocks = kept.groupBy("doc_id", "block").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))
    sized = blocks.withColumn("_n", F.length("text").cast("long"))
    return running_total(sized, "doc_id", "block", F.col("_n"), "start").select("doc_id", "block", "start", "text")


def covered_pages(intervals: DataFrame, bounds: DataFrame) -> DataFrame:
    """``doc_id, chunk, pages``: sorted pages that each interval (doc_id, chunk, start, end) overlaps; none: page 1.

    Both sides are dealt to the buckets of the document that they touch, so the join is an equi-join whose
    keys stay small in a document of any length.
    """

    def dealt(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col("start"), F.col("end") - 1)
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / BUCKET_CHARS), F.floor(last / BUCKET_CHARS))))

    c, p = dealt(intervals).alias("c"), dealt(bounds).alias("p")
    on = (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c._b") == F.col("p._b")) & (F.col("c.start") < F.col("p.end")) & (F.col("c.end") > F.col("p.start"))
    hits = c.join(p, on).groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.chunk").alias("chunk")).agg(F.array_sort(F.collect_set("p.page")).alias("pages"))
    return intervals.select("doc_id", "chunk").join(hits, ["doc_id", "chunk"], "left").withColumn("pages", F.coalesce("pages", F.array(F.lit(1))))
