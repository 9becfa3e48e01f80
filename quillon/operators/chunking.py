"""From pages to chunks: window and recursive splitting and the branches by kind of document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import COLUMN_MARK, TOKEN, columns_of, filled, sheet_name, strip, without_page_marks

from .pages import combine_pages, covered_pages, page_bounds, running_total

#: Tokens of a chunk and tokens carried over to the next.
CHUNK_TOKENS, OVERLAP_TOKENS = 400, 100
#: Separators from coarse to fine; pieces that none of them makes small enough are cut between tokens.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "；", "; ", "，", ", ", " ")

#: Characters at the end of a block of which the next may repeat the overlap.
TAIL_CHARS = 8192

#: Kinds of one token: how RE2, Java and Python name the scripts differs, the counter's pattern does not.
_TOKEN = regex.compile(TOKEN)


def window_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """``key, chunk, text``: windows of ``size`` white-space tokens, each starting ``size - overlap`` after the last."""
    step = size - overlap
    tokens = F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")
    n = F.size("_t")
    last = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int") - 1
    each = df.select(key, tokens.alias("_t")).where(n > 0).select(key, "_t", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    return each.select(key, (F.col("_i") + 1).alias("chunk"), F.array_join(F.slice("_t", F.col("_i") * step + 1, size), " ").alias("text"))


Span = tuple[int, int]


def _pieces(text: str, size: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, int]]:
    """``(start, end, tokens)`` of the pieces that tile a text: parts between separators, split on by finer ones while over the size."""

    def inside(lo: int, hi: int, level: int) -> Iterator[tuple[int, int, int]]:
        n = count(text[lo:hi])
        if n <= size or lo == hi:
            yield lo, hi, n
        elif level == len(SEPARATORS):
            ends = [m.end() for m in _TOKEN.finditer(text, lo, hi)]
            at = lo
            for k in range(size - 1, len(ends) + size - 1, size):
                end = ends[k] if k < len(ends) - 1 else hi
                yield at, end, count(text[at:end])
                at = end
        else:
            sep, at = SEPARATORS[level], lo
            while at < hi:
                hit = text.find(sep, at, hi)
                end = hi if hit < 0 else hit + len(sep)
                yield from inside(at, end, level + 1)
                at = end

    yield from inside(0, len(text), 0)


def split_spans(text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] | None = None, before: str = "") -> list[Span]:
    """Spans of the chunks of a text, each of at most ``size`` tokens: pieces merged in order while they fit.

    A chunk begins with as many of the last chunk's pieces as have ``overlap`` tokens or fewer.  ``before`` is the end of
    what stands before the text: its last pieces, split until they fit the overlap, are carried into the first chunk,
    whose span then starts below 0.
    """
    count = count or _count
    out: list[Span] = []
    held: list[tuple[int, int, int]] = []
    if before:
        tail = [(lo - len(before), hi - len(before), n) for lo, hi, n in _pieces(before, max(1, overlap), count)]
        while tail and sum(x[2] for x in held) + tail[-1][2] <= overlap:
            held.insert(0, tail.pop())
    total, new = sum(x[2] for x in held), 0
    for lo, hi, n in _pieces(text, size, count):
        if held and total + n > size:
            if new:
                out.append((held[0][0], held[-1][1]))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[2]
            new = 0
        held.append((lo, hi, n))
        total += n
        new += 1
    if held and new:
        out.append((held[0][0], held[-1][1]))
    return out


def _count(text: str) -> int:
    return len(_TOKEN.findall(text))


def split_recursively(text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] | None = None) -> list[str]:
    """The chunks of ``split_spans``, stripped."""
    return [text[a:b].strip() for a, b in split_spans(text, size, overlap, count)]


def recursive_chunks(text: Column, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Array of chunks of a text (null: none), by ``split_recursively`` in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([split_recursively(t, size, overlap) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


_PART = pa.struct([("part", pa.int32()), ("chunk", pa.int32()), ("total", pa.int32()), ("text", pa.string())])
_PLACED = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def _chunked_parts(parts: Column) -> Column:
    """Of the parts of a page: ``part, chunk, total, text`` of every chunk, numbered within its part before blank ones are left out."""

    def run(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            own = []
            for i, part in enumerate(page or [], 1):
                cut = split_recursively(part) if part and part.strip() else []
                own += [{"part": i, "chunk": k, "total": len(cut), "text": t} for k, t in enumerate(cut, 1) if t]
            out.append(own)
        return pa.array(out, pa.list_(_PART))

    return F.arrow_udf(run, "array<struct<part: int, chunk: int, total: int, text: string>>")(parts)


def typed_chunks(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Chunks of the pages of sheets (``excel``), slides (``pptx``) and PDF files (``pdf``) by ``document_type``, in one pass.

    A sheet or slide is one chunk.  A PDF page is chunked by its layout (missing layout fields count as one standard
    column): as one text, or column by column where several columns are marked.  ``keep`` are further columns carried.
    """
    kind, text = F.col("document_type"), F.col("text")
    p = pages.where(filled(text) & kind.isin("excel", "pptx", "pdf")).withColumns(
        {"column_count": F.coalesce("column_count", F.lit(1)), "layout_type": F.coalesce("layout_type", F.lit("single_column")), "extraction_method": F.coalesce("extraction_method", F.lit("standard"))}
    )
    many = F.col("layout_type") == "multi_column"
    branch = F.when(kind == "excel", "excel_full_sheet").when(kind == "pptx", "pptx_full_slide").when(F.col("column_count") <= 1, "pdf_single_column").when(many & F.contains(text, F.lit(COLUMN_MARK)), "pdf_multi_column").when(many, "pdf_multi_column_merged").otherwise("pdf_complex_layout")
    p = p.withColumn("content_type", branch)
    is_ = lambda *names: F.col("content_type").isin(*names)
    whole = is_("excel_full_sheet", "pptx_full_slide")
    parts = F.when(is_("pdf_multi_column"), columns_of(text)).when(~whole, F.array(text))
    cut = p.withColumn("_c", _chunked_parts(parts))
    alone = F.array(F.struct(F.lit(1).alias("part"), F.lit(1).alias("chunk"), F.lit(1).alias("total"), strip(text).alias("text")))
    each = cut.withColumn("_c", F.when(whole, alone).otherwise(F.col("_c"))).select("*", F.posexplode("_c").alias("_p", "_t"))
    columns = is_("pdf_multi_column")
    null = lambda t: F.lit(None).cast(t)
    return each.select(
        "doc_id", "page", strip(F.col("_t.text")).alias("page_content"), F.when(columns, F.col("_p") + 1).otherwise(F.col("_t.chunk")).alias("chunk"),
        F.when(columns, F.size("_c")).otherwise(F.col("_t.total")).alias("total_chunks"), "content_type",
        F.when(columns, F.col("_t.part")).alias("column"), F.when(columns, F.col("_t.chunk")).alias("column_chunk"),
        F.when(is_("pdf_multi_column", "pdf_multi_column_merged"), F.col("column_count")).alias("column_count"),
        F.when(is_("pdf_single_column"), "single_column").when(is_("pdf_complex_layout"), "complex").when(~whole, "multi_column").alias("layout_type"),
        F.when(is_("pdf_single_column"), F.col("extraction_method")).when(is_("pdf_complex_layout"), "fallback").alias("extraction_method"),
        F.when(is_("excel_full_sheet"), "full_sheet_per_chunk").when(is_("pptx_full_slide"), "full_slide_per_chunk").alias("chunking_strategy"),
        F.when(is_("excel_full_sheet"), sheet_name(text)).alias("sheet_name"), F.when(is_("pptx_full_slide"), F.col("page")).otherwise(null("int")).alias("slide_number"), *(keep or []),
    )


def split_columns(pages: DataFrame) -> DataFrame:
    """``doc_id, page, column, text``: the non-blank parts between column marks, numbered before blank ones are left out."""
    each = pages.select("doc_id", "page", F.posexplode(columns_of(F.col("text"))).alias("_i", "_t"))
    return each.where(filled(F.col("_t"))).select("doc_id", "page", (F.col("_i") + 1).alias("column"), strip(F.col("_t")).alias("text"))


def cross_page_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of whole documents with the pages each covers, numbered through the document.

    A long document is read block by block (see ``combine_pages``): a chunk ends where a block does, and the next
    begins with the overlap from the block before.  The splitter tells where each chunk stands, and that interval is
    joined with the pages' intervals.
    """

    def run(texts: pa.Array, starts: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for text, start, tail in zip(texts.to_pylist(), starts.to_pylist(), before.to_pylist()):
            own = []
            for a, b in split_spans(text, before=tail or ""):
                raw = (tail or "")[a:] + text[:b] if a < 0 else text[a:b]
                lead = len(raw) - len(raw.lstrip())
                own.append({"start": start + a + lead, "end": start + a + lead + len(raw.strip()), "text": raw.strip()})
            out.append(own)
        return pa.array(out, pa.list_(_PLACED))

    blocks = combine_pages(pages)
    tail = F.lag(F.right("text", F.lit(TAIL_CHARS))).over(W.partitionBy("doc_id").orderBy("block"))  # a row for every BLOCK_PAGES pages
    cut = blocks.withColumn("_b", tail).withColumn("_c", F.arrow_udf(run, "array<struct<start: bigint, end: bigint, text: string>>")("text", "start", "_b")).select("doc_id", "block", "_c")
    sized = cut.withColumn("_n", F.size("_c"))
    numbered = running_total(sized, "doc_id", "block", F.col("_n"), "_prior")
    totals = sized.groupBy("doc_id").agg(F.sum("_n").cast("int").alias("total_chunks"))
    each = numbered.select("doc_id", "block", "_prior", F.posexplode("_c").alias("_p", "_t")).where(filled(F.col("_t.text")))
    placed = each.select("doc_id", "block", (F.col("_prior") + F.col("_p") + 1).cast("int").alias("chunk"), F.col("_t.start").alias("start"), F.col("_t.end").alias("end"), F.col("_t.text").alias("_text"))
    pages_of = covered_pages(placed.select("doc_id", "chunk", "start", "end"), page_bounds(pages))
    joined = placed.join(pages_of, ["doc_id", "chunk"]).join(totals, "doc_id")
    spans = F.size("pages") > 1
    return joined.select(
        "doc_id", F.get("pages", F.lit(0)).alias("page"), strip(without_page_marks(F.col("_text"))).alias("page_content"), "block", "chunk", "total_chunks",
        F.lit("cross_page_text").alias("content_type"), F.when(spans, F.array_join("pages", ",")).alias("page_range"), spans.alias("spans_pages"), "start", "end",
    )


def chunk_documents(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """All chunks of all documents, by the kind of their report; failed reports give none.

    ``reports(doc_id, document_type, filename, sha1_name)`` has one row a document; documents of another
    kind than pdf, pptx and excel are chunked across pages.
    """
    facts = ["document_type", "source_file", "sha1_name"]
    own = reports.select("doc_id", "document_type", F.col("filename").alias("source_file"), "sha1_name").where("document_type <> 'failed'")
    known = F.col("document_type").isin("excel", "pptx", "pdf")
    out = typed_chunks(pages.join(own.where(known), "doc_id"), facts)
    across = cross_page_chunks(pages.join(own.where(~known).select("doc_id"), "doc_id", "left_semi")).drop("start", "end")
    return out.unionByName(across.join(own.where(~known), "doc_id"), True)


def keyed(chunks: DataFrame) -> DataFrame:
    """Chunks with ``vec_id``, a number made of what tells a chunk apart."""
    return chunks.withColumn("vec_id", F.xxhash64("doc_id", "page", F.coalesce("block", F.lit(-1).cast("long")), F.coalesce("column", F.lit(0)), "chunk"))
