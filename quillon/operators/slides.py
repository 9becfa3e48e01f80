"""Text of slides from their flattened shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import filled, strip

#: The label of each kind of shape, in the order in which a shape is taken for one.
LABELS = {"table": "Table", "chart": "Chart", "image": "Image", "group": "Group", "text": "Text Frame", "other": "Other"}


def slide_texts(shapes: DataFrame) -> DataFrame:
    """``doc_id, slide, text`` from ``shapes(doc_id, slide, ord, kind, type_info, text)``; slides without text are left out.

    A shape's text stands under its label and type; shapes of other kinds than a table, chart or image
    count only if they have text.
    """
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("kind")]
    info = F.when(F.coalesce(F.col("type_info"), F.lit("")) != "", F.concat(F.lit(" (type: "), "type_info", F.lit(")"))).otherwise("")
    kept = shapes.where(F.col("kind").isin("table", "chart", "image") | filled(F.col("text")))
    part = F.concat(label, info, F.lit(":\n"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("t"))))
    slides = kept.groupBy("doc_id", "slide").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))
    return slides.where(filled(F.col("text"))).select("doc_id", "slide", strip(F.col("text")).alias("text"))


def shape_counts(shapes: DataFrame) -> DataFrame:
    """``doc_id, tables, charts, images, other_objects``."""
    count = lambda k: F.count_if(F.col("kind") == k).alias
    return shapes.groupBy("doc_id").agg(count("table")("tables"), count("chart")("charts"), count("image")("images"), count("other")("other_objects"))
