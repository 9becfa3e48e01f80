"""The registered queries of the core and their SQL, over whole tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import replies, scores, text
from quillon.operators import chunking, knn, layout, models, pages, retrieval, slides
from quillon.plans.pipeline import Pipeline
from quillon.session import durable, shared_folder
from quillon.sources import files
from quillon.sources.store import Store
from quillon.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The queries of a search are the rows whose id this divides.
ASKED = 50


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rules(rules, column: str) -> str:
    for pattern, to in rules:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


class _Template(str):
    """SQL with one place for an expression; other braces belong to patterns."""

    def format(self, expression: str) -> str:  # type: ignore[override]
        return self.replace("{}", expression)


_SP = text.SPACE
_STRIP = _Template(f"regexp_replace({{}}, '^{_SP}+|{_SP}+$', '', 'g')")
_FILLED = _Template(f"regexp_matches({{}}, '[^{_SP[1:-1]}]')")
_PAGES = "p AS (SELECT doc_id, page, max(text) AS text, max(layout_type) AS layout_type, max(column_count) AS column_count FROM pages GROUP BY doc_id, page)"
_MARKED = "chr(10) || '--- PAGE ' || page || ' ---' || chr(10) || text || chr(10)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.distinct_pages(table(spark, sf_dir, "pages"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a report: of those ingested twice the values of the greater."""
    r = table(spark, sf_dir, "reports")
    return r.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("file_path", "sha1_name", "filename", "document_type", "pages_amount", "tables_amount")])


_REPORTS = "r AS (SELECT doc_id, max(file_path) AS file_path, max(sha1_name) AS sha1_name, max(filename) AS filename, max(document_type) AS document_type, max(pages_amount) AS pages_amount, max(tables_amount) AS tables_amount FROM reports GROUP BY doc_id)"

# ---- cleaning


@query(f"WITH {_PAGES} SELECT doc_id, page, {_rules(text.NUMBER_RULES, 'text')} AS text FROM p WHERE text IS NOT NULL")
def clean_numbers(spark, sf_dir):
    return _pages(spark, sf_dir).where("text is not null").select("doc_id", "page", text.clean_numbers(F.col("text")).alias("text"))


@query(f"WITH {_PAGES} SELECT doc_id, page, {_rules(text.SPACING_RULES, 'text')} AS text FROM p WHERE text IS NOT NULL")
def clean_spacing(spark, sf_dir):
    return _pages(spark, sf_dir).where("text is not null").select("doc_id", "page", text.clean_spacing(F.col("text")).alias("text"))


@query("SELECT doc_id, translate(text, '＄％（）', '$%()') AS text FROM documents WHERE text IS NOT NULL")
def clean_symbols(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.clean_symbols(F.col("text")).alias("text"))


_DIRTY = "'NT$ ' || l_quantity::INT || ' , ' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || ' . ' || l_linenumber || ' ％ － 5' || chr(10) || '1 o 5 exam-' || chr(10) || 'ple   （x）'"


def _dirty() -> F.Column:
    n = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    return F.concat(F.lit("NT$ "), F.col("l_quantity").cast("int").cast("string"), F.lit(" , "), n, F.lit(" . "), F.col("l_linenumber").cast("string"), F.lit(" ％ － 5\n1 o 5 exam-\nple   （x）"))


@query(f"SELECT DISTINCT translate({_rules((*text.NUMBER_RULES, *text.SPACING_RULES), _DIRTY)}, '＄％（）', '$%()') AS text, {_DIRTY} AS raw FROM lineitem")
def clean_dirty_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(_dirty().alias("raw")).distinct().select(text.clean_text(F.col("raw")).alias("text"), "raw")


@query(f"WITH {_PAGES} SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE {_FILLED.format('text')}) AS kept, sum(length({_STRIP.format('text')}))::BIGINT AS chars FROM p GROUP BY doc_id")
def clean_pages_report(spark, sf_dir):
    t = F.col("text")
    return _pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(text.filled(t)).alias("kept"), F.sum(F.length(text.strip(t)).cast("long")).alias("chars"))


# ---- files and reports


@query(
    """SELECT doc_id, lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '(\\.[^.]+)$', 1)) AS suffix,
  CASE lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '(\\.[^.]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.pptx' THEN 'pptx' WHEN '.ppt' THEN 'pptx' WHEN '.xlsx' THEN 'excel' WHEN '.xls' THEN 'excel' END AS reader,
  regexp_extract(file_path, '[^/]*$') AS name, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') AS stem
FROM (SELECT DISTINCT doc_id, file_path FROM reports)"""
)
def route_by_extension(spark, sf_dir):
    p = F.col("file_path")
    return table(spark, sf_dir, "reports").select("doc_id", "file_path").distinct().select("doc_id", text.suffix(p).alias("suffix"), files.route(p).alias("reader"), text.basename(p).alias("name"), text.stem(p).alias("stem"))


@query(
    f"""WITH {_PAGES}, f AS (SELECT DISTINCT file_path, doc_id FROM reports), n AS (SELECT file_path, count(p.page) AS n FROM f LEFT JOIN p ON p.doc_id = f.doc_id GROUP BY file_path),
t AS (SELECT n, CASE WHEN n > 0 AND lower(file_path) LIKE '%.pdf' THEN 'pdf' ELSE 'failed' END AS document_type FROM n)
SELECT document_type, count(*) AS files, sum(CASE document_type WHEN 'pdf' THEN n ELSE 0 END)::BIGINT AS pages, count(*) FILTER (WHERE document_type = 'failed') AS reasons FROM t GROUP BY document_type"""
)
def ingest_counts(spark, sf_dir):
    """Files made of the reports' pages, read back: a simple PDF under each path, so that files of other kinds are broken ones."""
    page = F.concat(F.lit("<< /Length 9 >>\nstream\nBT (page "), F.col("page").cast("string"), F.lit(") Tj ET\nendstream\n"))
    made = table(spark, sf_dir, "reports").select("file_path", "doc_id").distinct().join(_pages(spark, sf_dir).select("doc_id", page.alias("s")), "doc_id", "left")
    content = made.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.collect_list("s"), "").cast("binary").alias("content"))
    parsed = files.parse_files(content)
    return parsed.groupBy("document_type").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("pages")).alias("pages"), F.count("error").alias("reasons"))


@query(
    f"""WITH {_PAGES}, {_REPORTS}, n AS (SELECT doc_id, count(*) FILTER (WHERE {_FILLED.format('text')}) AS kept FROM p GROUP BY doc_id)
SELECT coalesce(r.doc_id, n.doc_id) AS doc_id, r.document_type, coalesce(r.pages_amount, 0) AS stated, coalesce(n.kept, 0) AS kept, r.doc_id IS NULL AS report_missing FROM r FULL JOIN n ON r.doc_id = n.doc_id"""
)
def report_pages(spark, sf_dir):
    """Reports against their pages: what each states, what there is, and which have no report."""
    n = _pages(spark, sf_dir).groupBy("doc_id").agg(F.count_if(text.filled(F.col("text"))).alias("kept"))
    r = _reports(spark, sf_dir).select("doc_id", "document_type", "pages_amount", F.lit(True).alias("known"))
    j = r.join(n, "doc_id", "full")
    return j.select("doc_id", "document_type", F.coalesce("pages_amount", F.lit(0)).alias("stated"), F.coalesce("kept", F.lit(0)).alias("kept"), F.col("known").isNull().alias("report_missing"))


# ---- pages and documents


@query(
    f"""WITH {_PAGES}, k AS (SELECT doc_id, page, length({_MARKED}) AS n FROM p WHERE {_FILLED.format('text')}),
s AS (SELECT doc_id, page, n, sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS e FROM k) SELECT doc_id, page, (e - n)::BIGINT AS start, e::BIGINT AS "end" FROM s"""
)
def page_bounds(spark, sf_dir):
    return pages.page_bounds(_pages(spark, sf_dir))


@query(
    f"""WITH {_PAGES}, b AS (SELECT doc_id, (page - 1) // 500 AS block, string_agg({_MARKED}, '' ORDER BY page) AS text FROM p WHERE {_FILLED.format('text')} GROUP BY ALL)
SELECT doc_id, block, text, (sum(length(text)) OVER (PARTITION BY doc_id ORDER BY block) - length(text))::BIGINT AS start FROM b"""
)
def combine_pages(spark, sf_dir):
    return pages.combine_pages(_pages(spark, sf_dir))


@query(
    f"""WITH {_PAGES}, b AS (SELECT doc_id, (page - 1) // 500 AS block, string_agg({_MARKED}, '' ORDER BY page) AS text FROM p WHERE {_FILLED.format('text')} GROUP BY ALL)
SELECT doc_id, block, regexp_replace(text, '\\n--- PAGE [0-9]+ ---\\n', chr(10), 'g') AS text FROM b"""
)
def strip_page_markers(spark, sf_dir):
    return pages.combine_pages(_pages(spark, sf_dir)).select("doc_id", "block", text.without_page_marks(F.col("text")).alias("text"))


@query(
    f"""WITH {_PAGES}, k AS (SELECT doc_id, page, length({_MARKED}) AS n FROM p WHERE {_FILLED.format('text')}),
s AS (SELECT doc_id, page, n, sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS e FROM k), d AS (SELECT doc_id, max(e) AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, i AS chunk, i * 1000 AS a, least(i * 1000 + 1200, n) AS z FROM d, unnest(range(0, ((n + 999) // 1000)::BIGINT)) AS u(i))
SELECT c.doc_id, c.chunk::BIGINT AS chunk, list_sort(list(s.page)) AS pages FROM c JOIN s ON c.doc_id = s.doc_id AND c.a < s.e AND c.z > s.e - s.n GROUP BY ALL"""
)
def chunk_page_range(spark, sf_dir):
    """Pages under each stretch of 1,200 characters, one every 1,000, of each combined document."""
    bounds = pages.page_bounds(_pages(spark, sf_dir))
    total = bounds.groupBy("doc_id").agg(F.max("end").alias("n"))
    each = total.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 1000) - 1)).alias("chunk"))
    spans = each.select("doc_id", "chunk", (F.col("chunk") * 1000).alias("start"), F.least(F.col("chunk") * 1000 + 1200, F.col("n")).alias("end"))
    return pages.covered_pages(spans, bounds)


@query("SELECT doc_id, page, arg_max(text, ingested_at) AS text FROM (SELECT DISTINCT doc_id, page, text, ingested_at FROM pages WHERE text IS NOT NULL) GROUP BY doc_id, page")
def page_content_map(spark, sf_dir):
    return retrieval.page_content_map(table(spark, sf_dir, "pages").where("text is not null"))


@query("SELECT page, arg_max(text, doc_id || chr(0) || text) AS text FROM pages WHERE text IS NOT NULL GROUP BY page")
def page_content_map_compat(spark, sf_dir):
    return retrieval.page_content_map(table(spark, sf_dir, "pages").where("text is not null"), compat=True)


# ---- chunks


@query(
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, t, unnest(range(0, greatest(ceil((len(t) - 100) / 300.0), 1)::BIGINT)) AS i FROM t WHERE len(t) > 0)
SELECT doc_id, (i + 1)::INT AS chunk, array_to_string(t[1 + 300 * i : 300 * i + 400], ' ') AS text FROM c"""
)
def window_chunks(spark, sf_dir):
    return chunking.window_chunks(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


_TOKENS = _Template("len(regexp_extract_all({}, '" + text.TOKEN.replace("sc=", "") + "'))")


@query(
    f"""WITH {_PAGES} SELECT doc_id, page, CASE WHEN {_TOKENS.format('text')} <= 400 THEN {_STRIP.format('text')} END AS alone, true AS within, true AS found, true AS ends FROM p WHERE {_FILLED.format('text')}"""
)
def recursive_chunks(spark, sf_dir):
    """Of each page: its chunk where it is the only one, that all are within the size and in the page, and that they begin and end with it."""
    p = _pages(spark, sf_dir).where(text.filled(F.col("text"))).select("doc_id", "page", text.strip(F.col("text")).alias("t"), chunking.recursive_chunks(F.col("text")).alias("c"))
    counted = p.withColumn("n", F.transform("c", text.token_count))
    first, last = F.get("c", F.lit(0)), F.element_at("c", -1)
    ends = (F.left("t", F.length(first)) == first) & (F.right("t", F.length(last)) == last)
    return counted.select("doc_id", "page", F.when(F.size("c") == 1, first).alias("alone"), F.forall("n", lambda n: n <= 400).alias("within"), F.forall("c", lambda x: F.contains(F.col("t"), x)).alias("found"), ends.alias("ends"))


@query(
    f"""WITH {_PAGES}, {_REPORTS} SELECT p.doc_id, p.page, {_STRIP.format('text')} AS page_content,
CASE document_type WHEN 'excel' THEN 'excel_full_sheet' ELSE 'pptx_full_slide' END AS content_type, CASE document_type WHEN 'pptx' THEN p.page END AS slide_number,
CASE document_type WHEN 'excel' THEN coalesce({_STRIP.format("replace(list_filter(string_split(text, chr(10)), lambda x: x[1:6] = 'Sheet:')[1], 'Sheet:', '')")}, 'Unknown Sheet') END AS sheet_name
FROM p JOIN r ON p.doc_id = r.doc_id WHERE document_type IN ('excel', 'pptx') AND {_FILLED.format('text')}"""
)
def whole_page_chunks(spark, sf_dir):
    typed = _pages(spark, sf_dir).join(_reports(spark, sf_dir).select("doc_id", "document_type"), "doc_id")
    return chunking.typed_chunks(typed.where(F.col("document_type").isin("excel", "pptx"))).select("doc_id", "page", "page_content", "content_type", "slide_number", "sheet_name")


@query(
    f"""WITH {_PAGES}, c AS (SELECT doc_id, page, string_split(text, '||COLUMN||') AS c FROM p WHERE text IS NOT NULL), e AS (SELECT doc_id, page, unnest(c) AS t, generate_subscripts(c, 1) AS column_no FROM c)
SELECT doc_id, page, column_no::INT AS column_no, {_STRIP.format('t')} AS text, row_number() OVER (PARTITION BY doc_id, page ORDER BY column_no)::INT AS chunk, count(*) OVER (PARTITION BY doc_id, page) AS total FROM e WHERE {_FILLED.format('t')}"""
)
def split_columns(spark, sf_dir):
    page = W.partitionBy("doc_id", "page")
    each = chunking.split_columns(_pages(spark, sf_dir).where("text is not null")).withColumnRenamed("column", "column_no")
    return each.withColumn("chunk", F.row_number().over(page.orderBy("column_no"))).withColumn("total", F.count(F.lit(1)).over(page))


@query(
    f"""WITH p AS (SELECT doc_id, page, max(text) AS text, max(layout_type) AS layout_type, max(column_count) AS column_count, max(extraction_method) AS extraction_method FROM pages GROUP BY doc_id, page), {_REPORTS},
t AS (SELECT p.*, document_type, filename, sha1_name, coalesce(column_count, 1) AS k, coalesce(layout_type, 'single_column') AS l FROM p JOIN r ON p.doc_id = r.doc_id WHERE document_type IN ('excel', 'pptx', 'pdf') AND {_FILLED.format('text')}),
b AS (SELECT *, CASE WHEN document_type = 'excel' THEN 'excel_full_sheet' WHEN document_type = 'pptx' THEN 'pptx_full_slide' WHEN k <= 1 THEN 'pdf_single_column' WHEN l = 'multi_column' AND contains(text, '||COLUMN||') THEN 'pdf_multi_column' WHEN l = 'multi_column' THEN 'pdf_multi_column_merged' ELSE 'pdf_complex_layout' END AS content_type FROM t)
SELECT doc_id, page, content_type, document_type, filename AS source_file, sha1_name, CASE content_type WHEN 'pdf_single_column' THEN 'single_column' WHEN 'pdf_complex_layout' THEN 'complex' WHEN 'pdf_multi_column' THEN 'multi_column' WHEN 'pdf_multi_column_merged' THEN 'multi_column' END AS layout_type,
CASE content_type WHEN 'pdf_single_column' THEN coalesce(extraction_method, 'standard') WHEN 'pdf_complex_layout' THEN 'fallback' END AS extraction_method, CASE WHEN content_type LIKE 'pdf_multi%' THEN k END AS column_count,
CASE content_type WHEN 'pptx_full_slide' THEN page END AS slide_number, CASE content_type WHEN 'pdf_multi_column' THEN len(list_filter(string_split(text, '||COLUMN||'), lambda x: {_FILLED.format('x')})) ELSE 1 END AS parts, true AS found, true AS numbered FROM b"""
)
def document_chunks(spark, sf_dir):
    """The chunks of each page of all reports: their kind and layout, that all are in the page, and that they are numbered through."""
    pages_, c = _pages(spark, sf_dir), chunking.chunk_documents(_pages(spark, sf_dir), _reports(spark, sf_dir))
    joined = c.join(pages_.select("doc_id", "page", "text"), ["doc_id", "page"])
    same = ["content_type", "document_type", "source_file", "sha1_name", "layout_type", "extraction_method", "column_count", "slide_number"]
    numbered = (F.count_distinct("chunk") == F.count(F.lit(1))) & (F.max("chunk") <= F.max("total_chunks"))
    return joined.groupBy("doc_id", "page", *same).agg(F.count_distinct(F.coalesce("column", F.lit(1))).alias("parts"), F.bool_and(F.contains("text", "page_content")).alias("found"), numbered.alias("numbered"))


@query(
    f"""WITH {_PAGES}, d AS (SELECT doc_id, string_agg({_MARKED}, '' ORDER BY page) AS text, list(page ORDER BY page) AS pages FROM p WHERE {_FILLED.format('text')} GROUP BY doc_id)
SELECT doc_id, pages, length(regexp_replace(text, '{_SP}+$', ''))::BIGINT AS last_end, 1::BIGINT AS first_start, true AS within, true AS numbered, true AS ordered FROM d"""
)
def cross_page_chunks(spark, sf_dir):
    """Of each document chunked across its pages: the pages covered, where its chunks begin and end, their size, numbers and order."""
    c = chunking.cross_page_chunks(_pages(spark, sf_dir))
    own = F.when(F.col("page_range").isNull(), F.array("page")).otherwise(F.transform(F.split("page_range", ","), lambda x: x.cast("int")))
    marks = 100  # a chunk's page marks count, but aren't in its content
    agg = c.withColumn("own", own).groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("pages"), F.max("end").alias("last_end"), F.min("start").alias("first_start"), F.bool_and(text.token_count(F.col("page_content")) <= 400 + marks).alias("within"),
        ((F.count_distinct("chunk") == F.max("total_chunks")) & (F.max("chunk") == F.max("total_chunks"))).alias("numbered"), F.array_sort(F.collect_list(F.struct("chunk", "start", "end"))).alias("o"),
    )
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size("o") - 1, F.lit(1))), lambda i: (i >= F.size("o")) | ((F.get("o", i)["start"] > F.get("o", i - 1)["start"]) & (F.get("o", i)["start"] <= F.get("o", i - 1)["end"] + 40)))
    return agg.select("doc_id", "pages", "last_end", "first_start", "within", "numbered", ordered.alias("ordered"))


@query("SELECT content_type, coalesce(document_type, 'unknown') AS document_type, count(DISTINCT chunk_id) AS chunks, count(DISTINCT doc_id) AS documents FROM chunks GROUP BY ALL")
def chunk_types(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").withColumn("document_type", F.coalesce("document_type", F.lit("unknown")))
    return c.groupBy("content_type", "document_type").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


# ---- layout: users' event values stand for the positions of a page's characters

_CHARS = "w AS (SELECT user_id AS page, max(value) AS width FROM events GROUP BY user_id), x AS (SELECT user_id AS page, value AS x, width FROM events JOIN w ON user_id = page WHERE value IS NOT NULL AND width > 0)"
_HIST = f"""{_CHARS}, c AS (SELECT page, least(greatest(floor(x * 50 / width), 0), 49)::INT AS bin, count(*) AS n FROM x GROUP BY ALL),
h AS (SELECT g.page, b AS bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT page FROM c) g CROSS JOIN unnest(range(0, 50)) AS u(b) LEFT JOIN c ON c.page = g.page AND c.bin = b),
m AS (SELECT page, bin, n, avg(n) OVER (PARTITION BY page ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth, sum(n) OVER (PARTITION BY page) AS total FROM h),
l AS (SELECT page, bin, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS run FROM m WHERE smooth <= 0.1 * total / 50),
g AS (SELECT page, min(bin)::INT AS first_bin, max(bin)::INT AS last_bin FROM l GROUP BY page, run HAVING count(*) >= 2)"""


def _histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("value").alias("x"))
    return layout.histogram(e.join(e.groupBy("page").agg(F.max("x").alias("width")), "page"))


@query(f"WITH {_HIST} SELECT page, bin::INT AS bin, n FROM h")
def column_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query(f"WITH {_HIST} SELECT page, bin::INT AS bin, round(smooth, 6) AS smooth FROM m")
def smoothed_histogram(spark, sf_dir):
    return layout.smoothed(_histogram(spark, sf_dir)).select("page", "bin", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {_HIST} SELECT page, first_bin, last_bin FROM g")
def column_gaps(spark, sf_dir):
    return layout.gaps(_histogram(spark, sf_dir))


@query(
    f"""WITH {_HIST}, k AS (SELECT page, count(*) AS g FROM g GROUP BY page), t AS (SELECT page, sum(n) AS chars FROM h GROUP BY page)
SELECT t.page, CASE WHEN coalesce(g, 0) > 0 THEN 'multi_column' WHEN chars > 1000 THEN 'complex' ELSE 'single_column' END AS layout_type, (coalesce(g, 0) + 1)::INT AS column_count, 'coordinate_based' AS extraction_method FROM t LEFT JOIN k ON t.page = k.page"""
)
def layout_types(spark, sf_dir):
    return layout.layouts(_histogram(spark, sf_dir))


@query(
    """WITH t AS (SELECT event_type AS page, count(*) AS chars FROM events GROUP BY event_type)
SELECT page, CASE WHEN chars > 1000 THEN 'complex' ELSE 'single_column' END AS layout_type, 1 AS column_count, 'coordinate_based' AS extraction_method FROM t"""
)
def full_layout_types(spark, sf_dir):
    """Events of each type as the characters of a page without gaps: many make it a complex one."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("page"), ((F.col("event_id") * 7919) % 1000).cast("double").alias("x"), F.lit(1000.0).alias("width"))
    return layout.layouts(layout.histogram(e))


@query(
    f"""WITH {_HIST}, y AS (SELECT g.page, width, list([first_bin * width / 50, CASE WHEN last_bin = 49 THEN width ELSE (last_bin + 1) * width / 50 END]) AS y FROM g JOIN w ON g.page = w.page GROUP BY g.page, width),
e AS (SELECT page, list_sort(list_distinct(list_concat([0.0, width], flatten(y)))) AS e FROM y),
i AS (SELECT page, e, unnest(range(0, len(e) - 1, 2)) AS i FROM e) SELECT page, (i // 2 + 1)::INT AS column_no, round(e[i + 1], 6) AS "left", round(e[i + 2], 6) AS "right" FROM i"""
)
def column_pairs(spark, sf_dir):
    widths = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(F.max("value").alias("width"))
    pairs = layout.column_pairs(layout.gaps(_histogram(spark, sf_dir)), widths)
    return pairs.select("page", F.col("column").alias("column_no"), F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


# ---- sheets, tables and slides


@query("SELECT n_regionkey AS sheet, 'Sheet: ' || r_name || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name")
def sheet_text(spark, sf_dir):
    """Nations as the rows of a sheet for each region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    grid = text.format_table(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cells"]))
    return n.groupBy(F.col("n_regionkey").alias("sheet"), "r_name").agg(grid.alias("g")).select("sheet", F.concat(F.lit("Sheet: "), "r_name", F.lit("\n"), "g").alias("text"))


@query("SELECT p_brand, p_size, string_agg(p_name || ' | ' || p_type || ' | ' || CASE WHEN p_retailprice < 1000 THEN '' ELSE p_brand END, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand, p_size")
def table_format(spark, sf_dir):
    """Parts of each brand and size as a table, with null cells."""
    cells = F.array("p_name", F.concat(F.lit(" "), "p_type"), F.when(F.col("p_retailprice") >= 1000, F.col("p_brand")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("cells")))), lambda x: x["cells"])
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(text.format_table(rows).alias("text"))


_SHAPES = """s AS (SELECT o_custkey % 97 AS doc_id, (o_custkey % 13)::INT AS slide, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'text' ELSE 'other' END AS kind,
CASE WHEN o_totalprice > 300000 THEN NULL WHEN o_totalprice > 200000 THEN '  ' ELSE o_orderpriority END AS text FROM orders)"""


def _shapes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "table").when(F.col("o_orderstatus") == "O", "text").otherwise("other")
    body = F.when(F.col("o_totalprice") > 300000, None).when(F.col("o_totalprice") > 200000, "  ").otherwise(F.col("o_orderpriority"))
    return o.select((F.col("o_custkey") % 97).alias("doc_id"), (F.col("o_custkey") % 13).cast("int").alias("slide"), F.col("o_orderkey").alias("ord"), kind.alias("kind"), F.lit("X").alias("type_info"), body.alias("text"))


@query(
    f"""WITH {_SHAPES}, k AS (SELECT doc_id, slide, string_agg(CASE kind WHEN 'table' THEN 'Table' WHEN 'text' THEN 'Text Frame' ELSE 'Other' END || ' (type: X):' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY ord) AS t
FROM s WHERE kind = 'table' OR trim(coalesce(text, '')) <> '' GROUP BY ALL) SELECT doc_id, slide, {_STRIP.format('t')} AS text FROM k"""
)
def slide_texts(spark, sf_dir):
    """Orders as the shapes of slides."""
    return slides.slide_texts(_shapes(spark, sf_dir))


@query(f"WITH {_SHAPES} SELECT doc_id, count(*) FILTER (WHERE kind = 'table') AS tables, 0::BIGINT AS charts, 0::BIGINT AS images, count(*) FILTER (WHERE kind = 'other') AS other_objects FROM s GROUP BY doc_id")
def shape_counts(spark, sf_dir):
    return slides.shape_counts(_shapes(spark, sf_dir))


# ---- search

_DIST = "sum((list_extract(q.embedding, i)::DOUBLE - list_extract(v.embedding, i)::DOUBLE) ** 2)"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % ASKED == 0)


@query("SELECT v.vec_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 6) AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id LIMIT 30")
def knn_topk(spark, sf_dir):
    """The 30 nearest vectors to the first."""
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()
    return knn.top_k(e, q[0] if q else []).withColumn("distance", F.round("distance", 6))


_BATCH = """d AS (SELECT q.vec_id AS qid, v.vec_id, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2 AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id)::INT AS rank FROM d QUALIFY rank <= 30)"""


@query(f"WITH {_BATCH} SELECT qid, rank, vec_id, round(distance, 6) AS distance FROM k")
def knn_batch(spark, sf_dir):
    return knn.knn_batch(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("SELECT 30 * count(DISTINCT chunk_id) AS wanted, true AS enough FROM chunks WHERE substr(chunk_id, 3)::BIGINT % 50 = 0")
def knn_lists_recall(spark, sf_dir):
    """Whether a quarter of the inverted lists of all passages' vectors holds at least 0.9 of the 30 nearest that the exact search finds."""
    own = table(spark, sf_dir, "chunks").groupBy(F.substring("chunk_id", 3, 20).cast("long").alias("vec_id")).agg(F.max("page_content").alias("t"))
    e = durable(own.select("vec_id", models.embedded(F.col("t")).alias("embedding")))
    asked = e.where(F.col("vec_id") % ASKED == 0)
    near, exact = knn.knn_lists(e, asked, knn.Lists.fit(e, 64), 16), knn.knn_batch(e, asked)
    both = exact.join(near.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


def _hits(spark, sf_dir):
    """The logged candidates of each question, once each, with the document of their file."""
    r = table(spark, sf_dir, "reranked")
    plain = ["text", "page", "page_range", "spans_pages", "distance", "source_file", "document_type", "llm_score"]
    return r.groupBy("qid", F.col("rank_no").alias("rank")).agg(*[F.max(c).alias(c) for c in plain], F.max(F.col("metadata")["chunk_id"]).alias("chunk_id"))


_HITS = "h AS (SELECT qid, rank_no AS rank, max(text) AS text, max(page) AS page, max(page_range) AS page_range, max(spans_pages) AS spans_pages, max(distance) AS distance, max(source_file) AS source_file, max(document_type) AS document_type, max(llm_score) AS llm_score, max(metadata['chunk_id']) AS chunk_id FROM reranked GROUP BY ALL)"
_ENDS = "list_transform(regexp_split_to_array(x, '[-‐‑–—~〜～－]'), lambda y: try_cast(trim(y) AS INT))"
_LISTED = f"flatten(list_transform(string_split(page_range, ','), lambda x: CASE WHEN len({_ENDS}) = 2 AND {_ENDS}[1] IS NOT NULL AND {_ENDS}[2] IS NOT NULL THEN range(least({_ENDS}[1], {_ENDS}[2]), greatest({_ENDS}[1], {_ENDS}[2]) + 1)::INT[] ELSE list_filter({_ENDS}, lambda y: y IS NOT NULL) END))"
_COVER = f"CASE WHEN coalesce(spans_pages, false) AND page_range IS NOT NULL AND len({_LISTED}) > 0 THEN list_sort(list_distinct({_LISTED})) ELSE [page] END"
_PARENTS = f"{_HITS}, v AS (SELECT *, {_COVER} AS pages FROM h), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY qid, {{}}pages ORDER BY rank) = 1), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS position FROM f)"


@query(f"WITH {_HITS} SELECT qid, rank, coalesce(page, 0) AS page, 1 AS chunk, coalesce(source_file, '') AS source_file, coalesce(document_type, 'unknown') AS document_type FROM h")
def hit_projection(spark, sf_dir):
    hits = retrieval.project_hits(_hits(spark, sf_dir).withColumn("chunk", F.lit(None).cast("int")))
    return hits.select("qid", "rank", "page", "chunk", "source_file", "document_type")


@query(f"WITH {_PARENTS.format('source_file, ')} SELECT qid, rank, pages, position FROM o")
def parent_pages(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("doc_id", F.col("source_file"))
    return retrieval.parent_pages(hits).select("qid", "rank", "pages", "position")


@query(f"WITH {_PARENTS.format('')} SELECT qid, rank, pages, position FROM o")
def parent_pages_compat(spark, sf_dir):
    return retrieval.parent_pages(_hits(spark, sf_dir), compat=True).select("qid", "rank", "pages", "position")


def _with_doc(spark, sf_dir):
    docs = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"))
    return _hits(spark, sf_dir).join(docs, "chunk_id")


_DOCS = "c AS (SELECT chunk_id, max(doc_id) AS doc_id FROM chunks GROUP BY chunk_id)"


@query(
    f"""WITH {_HITS}, {_DOCS}, {_PAGES}, j AS (SELECT h.*, c.doc_id FROM h JOIN c ON h.chunk_id = c.chunk_id), v AS (SELECT *, {_COVER} AS pages FROM j),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY qid, doc_id, pages ORDER BY rank) = 1), e AS (SELECT qid, rank, doc_id, len(pages) AS k, unnest(pages) AS pg FROM f),
t AS (SELECT qid, rank, pg, CASE WHEN k = 1 THEN coalesce(p.text, '') WHEN {_FILLED.format('p.text')} THEN '[Page ' || pg || ']' || chr(10) || p.text END AS t FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.page = e.pg)
SELECT qid, rank, coalesce(string_agg(t, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY pg), '') AS text FROM t GROUP BY qid, rank"""
)
def parent_content(spark, sf_dir):
    parents = retrieval.parent_pages(_with_doc(spark, sf_dir))
    return retrieval.parent_content(parents, _pages(spark, sf_dir))


# ---- reranking

_PLACED = f"{_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS n FROM h), b AS (SELECT *, (n // 2)::INT AS batch, (n % 2)::INT AS slot FROM n), z AS (SELECT *, count(*) OVER (PARTITION BY qid, batch)::INT AS blocks FROM b)"


@query(f"WITH {_PLACED} SELECT qid, rank, batch, slot, blocks FROM z")
def rerank_batches(spark, sf_dir):
    return retrieval.batches(_hits(spark, sf_dir)).select("qid", "rank", "batch", "slot", "blocks")


@query("SELECT doc_id, CASE WHEN length(text) > CASE WHEN doc_id % 3 = 0 THEN 1200 ELSE 800 END THEN text[1 : CASE WHEN doc_id % 3 = 0 THEN 1200 ELSE 800 END] || '...' ELSE text END AS block FROM documents")
def truncate_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("blocks", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2))
    return retrieval.blocks(d).select("doc_id", "block")


@query(f"WITH {_PLACED}, t AS (SELECT *, CASE WHEN blocks = 1 THEN 1200 ELSE 800 END AS m FROM z) SELECT qid, batch, max(blocks) AS blocks, string_agg(chr(10) || 'Block ' || (slot + 1) || ':' || chr(10) || CASE WHEN length(text) > m THEN text[1 : m] || '...' ELSE coalesce(text, '') END || chr(10), '' ORDER BY slot) AS prompt FROM t GROUP BY ALL")
def block_prompts(spark, sf_dir):
    return retrieval.block_prompts(retrieval.batches(_hits(spark, sf_dir)))


_SIM = "greatest(0.0, least(1.0, CASE WHEN distance = -1 THEN 1.0 ELSE 1 / (1 + coalesce(distance, 0.5)) END))"


@query(f"WITH {_HITS} SELECT qid, rank, round({_SIM}, 6) AS similarity FROM h")
def similarity_scores(spark, sf_dir):
    return _hits(spark, sf_dir).select("qid", "rank", F.round(scores.similarity(F.col("distance")), 6).alias("similarity"))


def _scored(spark, sf_dir):
    """Candidates scored by their logged replies: one list of scores for each batch."""
    placed = retrieval.batches(_hits(spark, sf_dir))
    lists = placed.groupBy("qid", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "llm_score"))), lambda x: x["llm_score"]).alias("scores"))
    return retrieval.with_scores(placed, lists)


_ROUND = _Template("round(({})::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE")  # half up from the shortest decimal form
_SCORED = f"{_HITS}, s AS (SELECT *, {_ROUND.format(f'0.7::DOUBLE * coalesce(llm_score, 0.5) + (1 - 0.7::DOUBLE) * {_SIM}')} AS combined_score FROM h)"
_METRICS = """(CASE WHEN sum(u) < 0 THEN -1 ELSE 1 END) * ((2 * abs(sum(u)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_score, max(combined_score) AS max_score, min(combined_score) AS min_score,
(max(u) - min(u)) / 10000.0 AS score_range, count(*) AS final_results"""
_BEST = f"{_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined_score DESC NULLS LAST, rank)::INT AS position FROM s QUALIFY position <= 10)"


@query(f"WITH {_SCORED} SELECT qid, rank, combined_score FROM s")
def combined_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("qid", "rank", "combined_score")


@query(f"WITH {_BEST} SELECT qid, rank, position, combined_score FROM o")
def rerank_topn(spark, sf_dir):
    return retrieval.best(_scored(spark, sf_dir)).select("qid", "rank", "position", "combined_score")


@query(f"WITH {_BEST} SELECT qid, string_agg('Document ' || position || ' (Page ' || page || ', ' || source_file || '):' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY position) AS context FROM o GROUP BY qid")
def assemble_context(spark, sf_dir):
    return retrieval.context(retrieval.best(_scored(spark, sf_dir)))


@query(f"WITH {_BEST}, m AS (SELECT *, round(combined_score * 10000)::HUGEINT AS u FROM o) SELECT qid, {_METRICS} FROM m GROUP BY qid")
def retrieval_metrics(spark, sf_dir):
    return retrieval.retrieval_metrics(retrieval.best(_scored(spark, sf_dir)))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN [(event_id % 100) / 100.0] WHEN 1 THEN [(event_id % 10) / 10.0, 1.0] WHEN 4 THEN [0.25, 0.5] WHEN 5 THEN [0.75] WHEN 6 THEN [0.25, 0.5] ELSE [0.5, 0.5] END::DOUBLE[] AS scores FROM events")
def parse_rankings(spark, sf_dir):
    """Replies of seven shapes made from the events, for two blocks each: JSON whole, fenced and amid text, scores in words, no object, none."""
    i = F.col("event_id")
    whole = F.concat(F.lit('{"block_rankings": [{"reasoning": "r", "relevance_score": '), ((i % 100) / 100.0).cast("string"), F.lit("}]}"))
    near = F.concat(F.lit("Score: 0."), (i % 10).cast("string"), F.lit(" relevance 7"))
    fenced = F.lit('Sure:\n```json\n{"block_rankings": [{"reasoning": "r", "relevance_score": 0.75}]}\n```\nDone.')
    amid = F.lit('I say {"block_rankings": [{"reasoning": "r", "relevance_score": 0.25}]} now')
    shapes = F.when(i % 7 == 0, whole).when(i % 7 == 1, near).when(i % 7 == 2, "no idea").when(i % 7 == 3, "[1, 2]").when(i % 7 == 4, "maybe .25 of 3").when(i % 7 == 5, fenced).otherwise(amid)
    return table(spark, sf_dir, "events").select("event_id", replies.parse_rankings(shapes, F.lit(2)).alias("scores"))


_REPLIES = """a AS (SELECT answer_id, max(final_answer) AS f, max(confidence_level) AS c FROM structured_answer GROUP BY answer_id),
r AS (SELECT answer_id, answer_id % 4 AS k, f, c, CASE answer_id % 4 WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || to_json({'final_answer': f})::VARCHAR || chr(10) || '```' WHEN 2 THEN 'raw ' || f WHEN 3 THEN '[1, 2]' END AS t FROM a),
x AS (SELECT *, regexp_extract(t, '(?s)```json\\s*(\\{.*?\\})\\s*```', 1) AS x1, regexp_extract(t, '(?s)```\\s*(\\{.*?\\})\\s*```', 1) AS x2, regexp_extract(t, '(?s)(\\{.*?\\})', 1) AS x3 FROM r),
j AS (SELECT *, CASE WHEN k NOT IN (1, 2) THEN NULL WHEN x1 <> '' AND json_valid(x1) THEN x1 WHEN x2 <> '' AND json_valid(x2) THEN x2 WHEN x3 <> '' AND json_valid(x3) THEN x3 END AS part FROM x)"""


@query(
    f"""WITH {_REPLIES} SELECT answer_id, CASE WHEN k = 0 THEN f WHEN k = 3 THEN t WHEN part IS NULL THEN left(coalesce(t, ''), 1000) WHEN json_exists(part, '$.final_answer') THEN json_extract_string(part, '$.final_answer') ELSE left(t, 500) END AS final_answer,
CASE WHEN k = 0 THEN c WHEN part IS NOT NULL THEN coalesce(json_extract_string(part, '$.confidence_level'), 'low') ELSE 'low' END AS confidence_level,
CASE WHEN k = 0 THEN 'Summary not available' WHEN k = 3 THEN 'Error in structured processing' WHEN part IS NOT NULL THEN 'Extracted response' ELSE 'Fallback parsing used due to malformed JSON' END AS reasoning_summary FROM j"""
)
def parse_answers(spark, sf_dir):
    """All answers put into whole JSON, into JSON amid text, into plain text and into JSON that is no object, and read back."""
    a = table(spark, sf_dir, "structured_answer").groupBy("answer_id").agg(F.max("final_answer").alias("f"), F.max("confidence_level").alias("c"))
    options = {"ignoreNullFields": "false"}
    whole = F.to_json(F.struct(F.col("f").alias("final_answer"), F.col("c").alias("confidence_level")), options)
    amid = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.col("f").alias("final_answer")), options), F.lit("\n```"))
    k = F.col("answer_id") % 4
    got = a.select("answer_id", replies.parse_answer(F.when(k == 0, whole).when(k == 1, amid).when(k == 2, F.concat(F.lit("raw "), "f")).otherwise("[1, 2]")).alias("a"))
    return got.select("answer_id", "a.final_answer", "a.confidence_level", "a.reasoning_summary")


# ---- tokens, batches and the store


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '" + text.TOKEN.replace("sc=", "") + "'))::INT AS tokens FROM documents")
def token_counts(spark, sf_dir):
    """Built-in token counts of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice - 100000 <= 0 THEN 0.0 ELSE round(o_custkey / (o_totalprice - 100000), 2) END AS rate FROM orders")
def throughput(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scores.throughput(F.col("o_custkey"), F.col("o_totalprice") - 100000).alias("rate"))


@query("SELECT count(*) AS document_count, 'hashed' AS embedding_model FROM embeddings")
def store_stats(spark, sf_dir):
    """What a store tells of its index, the vectors saved in one and read back."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.save("index", table(spark, sf_dir, "embeddings"))
    return store.stats().select("document_count", "embedding_model")


@query()
def text_embeddings(spark, sf_dir):
    """Hashed vectors of all distinct chunks."""
    c = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.max("page_content").alias("t"))
    return c.select("chunk_id", models.embedded(F.col("t")).alias("embedding"))


# ---- end to end


def _signs(texts: list[str]) -> list[list[float]]:
    """A text's length and how often it has some signs, as a vector that SQL can compute too."""
    return [[float(len(t)), *(float(t.count(c)) for c in "e1，年")] for t in texts]


def _by_length(prompt: str) -> str:
    return json.dumps({"block_rankings": [{"reasoning": "length", "relevance_score": len(t) % 100 / 100} for t in models.blocks_of(prompt)[1]]})


def _first_line(prompt: str) -> str:
    return json.dumps({"final_answer": prompt.rpartition(models.CONTEXT_LABEL)[2].split("\n")[0]}, ensure_ascii=False)


_SIGNS = _Template("[length({})::DOUBLE, " + ", ".join(f"(length({{}}) - length(replace({{}}, '{c}', '')))::DOUBLE" for c in "e1，年") + "]")
_BLOCK = "CASE WHEN length(text) > CASE WHEN blocks = 1 THEN 1200 ELSE 800 END THEN text[1 : CASE WHEN blocks = 1 THEN 1200 ELSE 800 END] || '...' ELSE text END"


@query(
    f"""WITH {_PAGES}, q AS (SELECT substr(qid, 2)::BIGINT AS qid, max(question) AS question FROM structured_answer WHERE qid IS NOT NULL GROUP BY 1),
c AS (SELECT substr(chunk_id, 3)::BIGINT AS vec_id, max(doc_id) AS doc_id, max(page) AS page, max(page_range) AS page_range, max(spans_pages) AS spans_pages, max(source_file) AS source_file, max(page_content) AS t FROM chunks GROUP BY chunk_id),
d AS (SELECT q.qid, c.vec_id, list_distance({_SIGNS.format("coalesce(c.t, '')")}, {_SIGNS.format("coalesce(q.question, '')")}) ** 2 AS raw FROM q, c), e AS (SELECT qid, vec_id, round(raw) AS distance FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id)::INT AS rank FROM e QUALIFY rank <= 30),
h AS (SELECT k.qid, k.rank, k.distance, c.doc_id, coalesce(c.page, 0) AS page, c.page_range, c.spans_pages, coalesce(c.source_file, '') AS source_file FROM k JOIN c ON k.vec_id = c.vec_id),
v AS (SELECT *, {_COVER} AS pages FROM h), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY qid, doc_id, pages ORDER BY rank) = 1), u AS (SELECT qid, rank, doc_id, len(pages) AS k, unnest(pages) AS pg FROM f),
t AS (SELECT qid, rank, pg, CASE WHEN k = 1 THEN coalesce(p.text, '') WHEN {_FILLED.format('p.text')} THEN '[Page ' || pg || ']' || chr(10) || p.text END AS t FROM u LEFT JOIN p ON p.doc_id = u.doc_id AND p.page = u.pg),
x AS (SELECT qid, rank, coalesce(string_agg(t, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY pg), '') AS text FROM t GROUP BY qid, rank),
n AS (SELECT f.*, x.text, row_number() OVER (PARTITION BY f.qid ORDER BY f.rank) - 1 AS n FROM f JOIN x ON f.qid = x.qid AND f.rank = x.rank), z AS (SELECT *, count(*) OVER (PARTITION BY qid, n // 2)::INT AS blocks FROM n),
l AS (SELECT *, length(regexp_replace({_BLOCK}, '^\n+|\n+$', '', 'g')) % 100 / 100 AS llm_score FROM z), s AS (SELECT *, {_ROUND.format("0.7::DOUBLE * llm_score + (1 - 0.7::DOUBLE) * (1 / (1 + distance))")} AS combined_score FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined_score DESC, rank)::INT AS position, round(combined_score * 10000)::HUGEINT AS u FROM s QUALIFY position <= 10)
SELECT qid, max(CASE position WHEN 1 THEN 'Document 1 (Page ' || page || ', ' || source_file || '):' END) AS answer, 'medium' AS confidence_level, {_METRICS} FROM o GROUP BY qid"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions asked of all chunks, end to end: vectors, search, parent pages, ranking prompts and their replies, scores, context, answering prompts, answers and figures."""
    asked = table(spark, sf_dir, "structured_answer").where("qid is not null").groupBy(F.substring("qid", 2, 20).cast("long").alias("qid")).agg(F.max("question").alias("question"))
    own = ["doc_id", "page", "page_range", "spans_pages", "source_file", "document_type", "page_content"]
    chunks = table(spark, sf_dir, "chunks").groupBy(F.substring("chunk_id", 3, 20).cast("long").alias("vec_id")).agg(*[F.max(c).alias(c) for c in own])
    index = chunks.withColumn("embedding", models.embedded(F.col("page_content"), _signs))
    p = Pipeline(spark, shared_folder(spark), embed=_signs, score=_by_length, generate=_first_line)
    results = durable(p.search(asked, index, _pages(spark, sf_dir)))
    answers = p.respond(asked, results).select("qid", F.col("a.final_answer").alias("answer"), F.col("a.confidence_level").alias("confidence_level"))
    return answers.join(retrieval.retrieval_metrics(results), "qid")


@query()
def answer_questions(spark, sf_dir):
    """All logged questions answered from their logged candidates by the stand-ins for scorer and generator."""
    asked = table(spark, sf_dir, "structured_answer").groupBy("qid").agg(F.max("question").alias("question"))
    placed = retrieval.batches(_hits(spark, sf_dir).join(asked.select("qid"), "qid", "left_semi"))
    got = models.replied(retrieval.rerank_prompts(placed, asked), models.overlap)
    best = durable(retrieval.best(retrieval.with_scores(placed, got.select("qid", "batch", replies.parse_rankings(F.col("reply"), F.col("blocks")).alias("scores")))))
    read = Pipeline(spark, shared_folder(spark)).respond(asked.join(best.select("qid").distinct(), "qid", "left_semi"), best)
    total = F.col("input_tokens") + F.col("output_tokens")
    return read.join(retrieval.retrieval_metrics(best), "qid").select("qid", F.col("a.final_answer").alias("answer"), F.col("a.confidence_level").alias("confidence_level"), "avg_score", "max_score", "final_results", total.alias("total_tokens"))
