"""Cutting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters at which a text may be cut naturally, with the strength of the cut after them.
BREAKS = {"\n": 5, "\r": 5, "。": 4, "！": 4, "？": 4, "；": 3, "，": 2, "、": 2, "\t": 1, " ": 1}
PARAGRAPH, SENTENCE_SPACE = 6, 4
#: Most rows a table of size limits may have; a larger one isn't a table of limits.
MOST_SCOPES = 1000
#: Pages up to which a stretch is listed page by page, and pieces of a text handed on at once.
SPREAD, PIECES_AT_ONCE = 10_000, 2_000
PIECES = ["item_kind", "item_id", "piece", "pieces", "start", "end", "text", "pages", "cut"]

_STRENGTH = np.zeros(0x110000, np.int8)
for _c, _s in BREAKS.items():
    _STRENGTH[ord(_c)] = _s
_STOPS = np.zeros(0x110000, bool)
_STOPS[[ord(c) for c in ".!?:;"]] = True


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def longest_run(codes: np.ndarray) -> int:
    """Length of the longest stretch that holds no natural boundary."""
    at = np.flatnonzero(_STRENGTH[codes])
    return int(np.diff(np.concatenate(([-1], at, [len(codes)]))).max()) - 1


def cut_points(codes: np.ndarray, limit: int) -> list[int]:
    """Ends of consecutive pieces of at most ``limit`` characters.

    A stretch over the limit is cut at the strongest boundary of its middle half, of equal ones at the
    nearest to its midpoint; if the middle half has none, at the boundary nearest to the midpoint; if it
    has none at all, at the midpoint.  Both halves are treated likewise.
    """
    strength = _STRENGTH[codes].astype(np.int8)
    if len(codes) > 1:
        strength[1:][(codes[1:] == 10) & (codes[:-1] == 10)] = PARAGRAPH
        strength[1:][(codes[1:] == 32) & _STOPS[codes[:-1]]] = SENTENCE_SPACE
        strength[:-1][(codes[:-1] == 13) & (codes[1:] == 10)] = 0
    at = np.flatnonzero(strength) + 1
    force = strength[at - 1]
    ends, todo = [], [(0, len(codes))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit:
            ends.append(hi)
            continue
        mid, quarter = (lo + hi) // 2, (hi - lo) // 4
        a, b = np.searchsorted(at, (max(lo + 1, lo + quarter), min(hi - 1, hi - quarter) + 1))
        if a == b:
            a, b = np.searchsorted(at, (lo + 1, hi))
            near = np.abs(at[a:b] - mid)
            cut = int(at[a + near.argmin()]) if b > a else mid
        else:
            cut = int(at[a + (force[a:b].astype(np.int64) * (1 << 40) - np.abs(at[a:b] - mid)).argmax()])
        todo += [(cut, hi), (lo, cut)]
    return ends


def _spans(texts: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
    forced, ends, offsets = [], [], [0]
    for text, size, overlap in zip(texts.to_pylist(), sizes.to_pylist(), overlaps.to_pylist()):
        codes = codes_of(text)
        own = cut_points(codes, max(1, size - overlap)) if len(codes) > size else [len(codes)]
        forced.append(longest_run(codes) > size)
        ends += own
        offsets.append(len(ends))
    return pa.StructArray.from_arrays([pa.array(forced, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends, pa.int32()))], ["forced", "ends"])


def normalised_pages(page_range: Column, page: Column) -> Column:
    """``"6,5"``, ``"5, 6"`` and ``"5-6"`` all as ``"5,6"``; a stretch of over ``SPREAD`` pages as ``"5-99999"``; null: the page itself."""
    numbers = F.transform(F.regexp_extract_all(page_range, F.lit(r"([0-9]{1,9})")), lambda x: x.cast("int"))
    stretch = page_range.rlike(r"[0-9]\s*[-–—~〜～－]\s*[0-9]") & (F.size(numbers) == 2)
    first, last = F.array_min(numbers), F.array_max(numbers)
    wide = stretch & (last - first > SPREAD)
    spread = F.when(stretch & ~wide, F.sequence(first, last)).otherwise(numbers)
    listed = F.when(wide, F.concat_ws("-", first.cast("string"), last.cast("string"))).otherwise(F.array_join(F.array_sort(F.array_distinct(spread)), ","))
    return F.when(page_range.isNotNull() & (F.size(numbers) > 0), listed).otherwise(page.cast("string"))


def oversized(items: DataFrame) -> DataFrame:
    """The rows of ``items`` over their size, with sound sizes and overlaps: the only ones that reach Python."""
    size = F.when(F.col("max_size").isNotNull(), F.greatest(F.col("max_size"), F.lit(1)))
    overlap = F.when((F.col("overlap") > 0) & (F.col("overlap") < size), F.col("overlap")).otherwise(0)
    over = items.select("item_kind", "item_id", "text", "pages", size.alias("max_size"), overlap.alias("overlap"))
    return over.where(F.col("max_size").isNotNull() & (F.length("text") > F.col("max_size")))


def spans(items: DataFrame) -> DataFrame:
    """``item_kind, item_id, cut, ends`` of the rows over their size: ``cut`` is ``forced`` where more than
    ``max_size`` consecutive characters hold no natural boundary, ``ends`` are the ends of the pieces."""
    own = F.arrow_udf(_spans, "struct<forced: boolean, ends: array<int>>")
    cut = oversized(items).withColumn("spans", own("text", "max_size", "overlap"))
    return cut.select("item_kind", "item_id", F.when(F.col("spans.forced"), "forced").otherwise("natural").alias("cut"), "spans.ends")


def split_oversized(items: DataFrame) -> DataFrame:
    """Pieces of the rows of ``items(item_kind, item_id, text, pages, max_size, overlap)`` over their size.

    Gives ``item_kind, item_id, piece, pieces, start, end, text, pages, cut``: ``start`` and ``end`` are
    the piece's own stretch (0-based, end exclusive; the stretches tile the text), ``text`` is that
    stretch after the ``overlap`` characters before it, at most ``max_size`` characters in all; ``cut``
    is ``forced`` where the piece ends at no natural boundary and isn't the last.  Texts up
    to their size, null and empty texts and rows without a size give no rows; an overlap that is null,
    negative or not below the size counts as 0; a size below 1 counts as 1.  Repeated rows give repeated
    pieces.  Only oversized texts reach Python, which cuts each piece out once; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text, size, overlap = (batch.column(k)[i].as_py() for k in (2, 4, 5))
                codes = codes_of(text)
                ends = cut_points(codes, max(1, size - overlap))
                starts = [0, *ends[:-1]]
                forced = ~(_STRENGTH[codes[np.array(ends) - 1]] > 0)
                forced[-1] = False
                for at in range(0, len(ends), PIECES_AT_ONCE):
                    own = range(at, min(at + PIECES_AT_ONCE, len(ends)))
                    n = len(own)
                    same = pa.array([i] * n, pa.int32())
                    texts = [text[max(0, starts[k] - overlap) : ends[k]] for k in own]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), pa.array([k + 1 for k in own], pa.int32()), pa.array([len(ends)] * n, pa.int32()), pa.array([starts[k] for k in own], pa.int32()),
                         pa.array([ends[k] for k in own], pa.int32()), pa.array(texts, pa.string()), batch.column(3).take(same), pa.array(["forced" if forced[k] else "natural" for k in own], pa.string())],
                        PIECES,
                    )

    return oversized(items).mapInArrow(run, "item_kind string, item_id string, piece int, pieces int, start int, end int, text string, pages string, cut string")


def sizes(limits: DataFrame) -> dict[str, tuple[int, int]]:
    """The limits in characters by scope, read to the driver behind a check of their number."""
    rows = limits.where(F.col("unit") == "chars").select("scope", "max_size", "overlap").limit(MOST_SCOPES + 1).collect()
    if len(rows) > MOST_SCOPES:
        raise ValueError("size_limits has too many rows for a table of limits")
    return {r["scope"]: (r["max_size"], r["overlap"] or 0) for r in rows}


def items(pages: DataFrame, chunks: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pages and chunks with the limits of their scope (chunks: their document type's, else the default)."""

    def of(scope: Column, k: int) -> Column:
        known = F.create_map(*[F.lit(x) for s, v in limits.items() if s != "pages.text" for x in (s, v[k])])
        default = limits.get("default", (None, None))[k]
        return F.coalesce(known[scope], F.lit(default).cast("int")) if len(limits) > ("pages.text" in limits) else F.lit(None).cast("int")

    own = limits.get("pages.text", (None, None))
    a = pages.select(
        F.lit("page").alias("item_kind"), F.concat_ws("#", "doc_id", F.col("page").cast("string")).alias("item_id"), "text",
        F.col("page").cast("string").alias("pages"), F.lit(own[0]).cast("int").alias("max_size"), F.lit(own[1]).cast("int").alias("overlap"),
    )
    scope = F.coalesce("document_type", F.lit("default"))
    b = chunks.select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("page_content").alias("text"),
        normalised_pages(F.col("page_range"), F.col("page")).alias("pages"), of(scope, 0).alias("max_size"), of(scope, 1).alias("overlap"),
    )
    return a.unionByName(b)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return items(read("pages"), read("chunks"), sizes(read("size_limits")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(_items(spark, sf_dir)).select("item_kind", "item_id", "cut").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece once; repeated rows of a page or chunk are the same thing logged again."""
    return split_oversized(_items(spark, sf_dir)).withColumnRenamed("pages", "page_range").dropDuplicates(["item_kind", "item_id", "piece"])


def p5_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text over its size what its pieces must hold: the digest of their own stretches end to end, that they are
    within the size, and that each repeats the overlap of the one before."""
    limits = _items(spark, sf_dir).select("item_kind", "item_id", "max_size", "overlap").distinct()
    pieces = p5_pieces(spark, sf_dir).join(limits, ["item_kind", "item_id"])
    own = F.struct("piece", F.expr("right(text, end - start)").alias("own"), "text", "start", "end")
    told = pieces.groupBy("item_kind", "item_id").agg(
        F.array_sort(F.collect_list(own)).alias("p"), F.bool_and(F.length("text") <= F.col("max_size")).alias("within"), F.max("overlap").alias("overlap")
    )  # the pieces of one text
    whole = F.array_join(F.transform("p", lambda x: x["own"]), "")
    return told.withColumn("whole", whole).select(
        "item_kind", "item_id", F.md5("whole").alias("digest"), "within",
        F.forall("p", lambda x: x["text"] == F.col("whole").substr(F.greatest(x["start"] - F.col("overlap"), F.lit(0)) + 1, x["end"] - F.greatest(x["start"] - F.col("overlap"), F.lit(0)))).alias("repeats"),
    )


_ITEMS = """WITH l AS (SELECT scope, max_size FROM size_limits WHERE unit = 'chars'),
i AS (
  SELECT 'page' AS item_kind, doc_id || '#' || page AS item_id, text, (SELECT max_size FROM l WHERE scope = 'pages.text') AS max_size FROM pages
  UNION ALL
  SELECT 'chunk', chunk_id, page_content, coalesce(l.max_size, (SELECT max_size FROM l WHERE scope = 'default'))
  FROM chunks LEFT JOIN l ON l.scope = coalesce(document_type, 'default') AND l.scope <> 'pages.text')"""
_BREAK = "[ \\t\\n\\r。！？；，、]"

SQL = {
    "p5_found": f"""{_ITEMS}
SELECT DISTINCT item_kind, item_id,
  CASE WHEN (SELECT max(length(x)) FROM unnest(regexp_split_to_array(text, '{_BREAK}')) AS u(x)) > max_size THEN 'forced' ELSE 'natural' END AS cut
FROM i WHERE length(text) > max_size""",
    "p5_tiling": f"{_ITEMS} SELECT DISTINCT item_kind, item_id, md5(text) AS digest, true AS within, true AS repeats FROM i WHERE length(text) > max_size",
}
