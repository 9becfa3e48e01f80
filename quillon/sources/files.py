"""Reading report files: slide decks and spreadsheets from their XML, PDF by whichever reader is installed."""

from __future__ import annotations

import importlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import COLUMN_MARK, basename, clean_text, filled, stem, strip, suffix
from quillon.operators.layout import page_layout
from quillon.operators.slides import LABELS

#: Suffixes and the reader each goes to.
ROUTES = {".pdf": "pdf", ".pptx": "pptx", ".ppt": "pptx", ".xlsx": "excel", ".xls": "excel"}
#: Headings of what is appended to a page's text.
LAYOUT_HEADING, TABLES_HEADING = "=== Layout Preserved ===", "=== Tables ==="
#: How a shape's type is written after its label.
SHAPE_TYPES = {
    "auto": "AUTO_SHAPE (1)", "chart": "CHART (3)", "freeform": "FREEFORM (5)", "group": "GROUP (6)", "line": "LINE (9)", "picture": "PICTURE (13)", "placeholder": "PLACEHOLDER (14)", "text box": "TEXT_BOX (17)", "table": "TABLE (19)",
}

PARSED = (
    "path string, document_type string, pages array<struct<page: int, text: string, layout_type: string, column_count: int, extraction_method: string>>, tables_amount int, pictures_amount int, error string"
)

#: A page's number and text, and of a PDF page its layout type, columns and way of extraction.
Page = tuple[int, str] | tuple[int, str, str | None, int | None, str | None]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _words(node: ElementTree.Element) -> str:
    lines = []
    for p in (x for x in node.iter() if _local(x.tag) == "p"):
        lines.append("".join((t.text or "") if _local(t.tag) == "t" else "\n" for t in p.iter() if _local(t.tag) in ("t", "br")))
    return "\n".join(lines).strip()


def grid(rows: list[list[object]]) -> str:
    """Stripped cells joined by `` | ``, empty rows left out; missing cells are empty."""
    return "\n".join(" | ".join("" if c is None else str(c).strip() for c in r) for r in rows if r)


class Slide:
    """Text and counts of one slide's XML."""

    def __init__(self, xml: bytes, charts: Callable[[str], list[str]] = lambda _: []):
        self.counts = dict.fromkeys(("table", "chart", "image", "other"), 0)
        self._charts = charts
        tree = next((x for x in ElementTree.fromstring(xml).iter() if _local(x.tag) == "spTree"), None)
        self.text = "" if tree is None else self._all(tree)

    def _all(self, node: ElementTree.Element) -> str:
        kinds = ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")
        return "\n\n".join(t for t in (self._shape(x) for x in node if _local(x.tag) in kinds) if t)

    def _shape(self, x: ElementTree.Element) -> str:
        tag, inside = _local(x.tag), {_local(y.tag): y for y in x.iter()}
        name = inside["cNvPr"].get("name", "") if "cNvPr" in inside else ""

        def titled(kind: str, type_: str | None, text: str) -> str:
            return f"{LABELS[kind]} (type: {'None' if type_ is None else SHAPE_TYPES['placeholder' if placed and kind != 'group' else type_]}):\n{text}"

        placed = "ph" in inside
        if "tbl" in inside and tag == "graphicFrame":
            self.counts["table"] += 1
            rows = [[_words(c) for c in r if _local(c.tag) == "tc"] for r in inside["tbl"] if _local(r.tag) == "tr"]
            return titled("table", "table", grid(rows))
        if "chart" in inside and tag == "graphicFrame":
            self.counts["chart"] += 1
            link = next((v for k, v in inside["chart"].attrib.items() if _local(k) == "id"), "")
            lines = self._charts(link)
            return titled("chart", "chart", "\n".join(lines) or "Chart (basic info not extractable)")
        if tag == "pic":
            self.counts["image"] += 1
            size = inside.get("ext")
            lines = [f"Name: {name}"] * bool(name) + ([f"Dimensions: {size.get('cx')} x {size.get('cy')}"] if size is not None and size.get("cx") else [])
            return titled("image", "picture", "\n".join(lines) or "Image")
        if tag == "grpSp":
            text = self._all(x)
            return titled("group", "group", text) if text else ""
        box = inside["cNvSpPr"].get("txBox") in ("1", "true") if "cNvSpPr" in inside else False
        type_ = "line" if tag == "cxnSp" else "text box" if box else "freeform" if "custGeom" in inside else "auto" if "prstGeom" in inside else "placeholder" if placed else None
        if "txBody" in inside:
            text = _words(inside["txBody"])
            return titled("text", type_, text) if text else ""
        self.counts["other"] += 1
        return titled("other", type_, f"Object: {name}") if name else ""


def _chart_lines(xml: bytes) -> list[str]:
    root = ElementTree.fromstring(xml)
    plot = next((x for x in root.iter() if _local(x.tag) == "plotArea"), None)
    out = []
    title = next((x for x in root.iter() if _local(x.tag) == "title"), None)
    if title is not None and (t := _words(title)):
        out.append(f"Title: {t}")
    kinds = [_local(x.tag) for x in (plot if plot is not None else []) if _local(x.tag).endswith("Chart")]
    if kinds:
        out.append(f"Chart Type: {kinds[0]}")
    series = [x for x in root.iter() if _local(x.tag) == "ser"]
    if series:
        out.append(f"Data Series: {len(series)} series")
        for i, s in enumerate(series, 1):
            tx = next((x for x in s if _local(x.tag) == "tx"), None)
            value = None if tx is None else next((v.text for v in tx.iter() if _local(v.tag) == "v"), None)
            if value:
                out.append(f"Series {i}: {value}")
    for tag, label in (("catAx", "Category Axis"), ("valAx", "Value Axis")):
        axis = next((x for x in root.iter() if _local(x.tag) == tag), None)
        head = None if axis is None else next((x for x in axis if _local(x.tag) == "title"), None)
        if head is not None and (t := _words(head)):
            out.append(f"{label}: {t}")
    return out


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = part.rsplit("/", 1)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(rels)):
        target = r.get("Target", "")
        bits = [] if target.startswith("/") else folder.split("/")
        for b in target.strip("/").split("/"):
            bits = bits[:-1] if b == ".." else [*bits, b]
        out[r.get("Id", "")] = "/".join(bits)
    return out


def read_pptx(content: bytes) -> tuple[list[tuple[int, str]], int, int]:
    """Non-blank slides as (number, text), tables and images."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()}
        slides = sorted((n for n, m in parts.items() if m), key=lambda n: int(parts[n][1]))
        if "ppt/presentation.xml" in z.namelist():  # it tells the slides' order, and which parts are shown
            links = _targets(z, "ppt/presentation.xml")
            shown = [x for x in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(x.tag) == "sldId"]
            named = [links.get(v) for x in shown for k, v in x.attrib.items() if k.startswith("{") and _local(k) == "id"]
            slides = [n for n in named if n in z.namelist()]
        pages, tables, images = [], 0, 0
        for number, part in enumerate(slides, 1):
            links = _targets(z, part)
            slide = Slide(z.read(part), lambda i, links=links: _chart_lines(z.read(links[i])) if links.get(i) in z.namelist() else [])
            tables, images = tables + slide.counts["table"], images + slide.counts["image"]
            if slide.text.strip():
                pages.append((number, slide.text.strip()))
        return pages, tables, images


def read_xlsx(content: bytes) -> tuple[list[tuple[int, str]], int, int]:
    """Sheets that hold cells as consecutively numbered pages, the number of all sheets, and 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = _targets(z, "xl/workbook.xml")
        sheets = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        pages = []
        for s in sheets:
            part = links.get(next((v for k, v in s.attrib.items() if _local(k) == "id"), ""), "")
            rows = _cells(z.read(part), shared) if part in z.namelist() else []
            if rows:
                pages.append((len(pages) + 1, f"Sheet: {s.get('name')}\n{grid(rows)}".strip()))
        return pages, len(sheets), 0


def _cells(xml: bytes, shared: list[str]) -> list[list[object]]:
    rows: list[list[object]] = []
    for r in (x for x in ElementTree.fromstring(xml).iter() if _local(x.tag) == "row"):
        row: list[object] = []
        for c in (x for x in r if _local(x.tag) == "c"):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters[0]))) - 1 if letters else len(row)
            row += [None] * (at + 1 - len(row))
            value = next((x.text for x in c if _local(x.tag) == "v"), None)
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
            row[at] = value
        if any(v not in (None, "") for v in row):
            rows.append(row)
    return rows


def read_pdf(content: bytes) -> tuple[list[Page], int, int]:
    """Non-blank pages by the readers that are installed, each tried where the one before fails; with none installed, by the
    plain text operators of the file."""
    failed: Exception | None = None
    for name, read in (("pdfplumber", _plumbed), ("pypdf", _pypdf)):
        try:
            module = importlib.import_module(name)
        except ImportError:
            continue
        try:
            return [p for p in read(module, content) if p[1].strip()], 0, 0
        except Exception as e:  # the next reader may know better
            failed = e
    if failed:
        raise failed
    return [(n, t) for n, t in enumerate(plain_pdf(content), 1) if t.strip()], 0, 0


def _pypdf(pypdf, content: bytes) -> list[Page]:
    pages = pypdf.PdfReader(io.BytesIO(content)).pages
    return [(n, (p.extract_text() or "").strip()) for n, p in enumerate(pages, 1)]


def _plumbed(pdfplumber, content: bytes) -> list[Page]:
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [_plumbed_page(n, p) for n, p in enumerate(pdf.pages, 1)]


def _plumbed_page(number: int, page) -> Page:
    """A page's text (column by column where it has several), its layout-preserved text if that differs, and its tables."""
    try:
        kind, count, how, columns = page_layout([c["x0"] for c in page.chars if "x0" in c], page.width)
        parts = [_cropped(page, left, right) for left, right in columns]
        parts = [f"{COLUMN_MARK} {t}" for t in parts if t.strip()]
    except Exception:  # positions that make no sense: one column
        kind, count, how, parts = "single_column", 1, "standard", []
    parts = parts or [t for t in [page.extract_text() or ""] if t]
    for heading, more in ((LAYOUT_HEADING, _preserved), (TABLES_HEADING, _tables)):
        try:
            found = [t for t in more(page) if t and t not in parts]
        except Exception:  # only this part is lost
            found = []
        parts += [heading, *found] if found else []
    return number, "\n\n".join(parts).strip(), kind, count, how


def _cropped(page, left: float, right: float) -> str:
    return page.within_bbox((left, 0, right, page.height)).extract_text() or ""


def _preserved(page) -> list[str]:
    return [page.extract_text(layout=True, x_tolerance=1, y_tolerance=1) or ""]


def _tables(page) -> list[str]:
    return [f"Table {i}:\n{grid(t)}" for i, t in enumerate(page.extract_tables() or [], 1) if t]


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|T\*|Td|TD|ET|'")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def plain_pdf(content: bytes) -> Iterator[str]:
    """Text shown by each content stream of a PDF with simple fonts: literal and hexadecimal strings, line moves."""
    for m in _STREAM.finditer(content):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data or not re.search(rb"T[jJ]|'", data):
            continue
        out = b""
        for t in _SHOW.findall(data):
            if t.startswith(b"("):
                out += re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), t[1:-1], flags=re.S)
            elif t.startswith(b"<"):
                digits = re.sub(rb"\s", b"", t[1:-1])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                out += raw
            elif out and not out.endswith(b"\n"):
                out += b"\n"
        yield out.decode("latin-1").strip()


READERS: dict[str, Callable[[bytes], tuple[list[Page], int, int]]] = {"pdf": read_pdf, "pptx": read_pptx, "excel": read_xlsx}


def route(path):
    """The reader of a path by its lower-cased suffix; null where there is none."""
    known = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    return known[suffix(path)]


def parse_files(files: DataFrame) -> DataFrame:
    """Parsed reports of ``files(path, content)`` (the binary file source's columns).

    A file of an unknown kind and an unreadable one give a report of type ``failed`` with no pages and the
    reason.  A file is read as a whole by one task, whatever its size: executors need room for the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page", "text", "layout_type", "column_count", "extraction_method")
        page = pa.struct(list(zip(names, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()))))
        for b in batches:
            rows = []
            for kind, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    if kind is None or content is None:
                        raise ValueError("no reader for this file")
                    pages, tables, pictures = READERS[kind](content)
                    rows.append((kind, [dict(zip(names, p)) for p in pages], tables, pictures, None))
                except Exception as e:  # a broken file must not end the job
                    rows.append(("failed", [], 0, 0, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.list_(page), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types)]], ["path", "document_type", "pages", "tables_amount", "pictures_amount", "error"])

    return files.select("path", route(F.col("path")).alias("kind"), "content").mapInArrow(run, PARSED)


def read_files(spark: SparkSession, *paths: str, known_only: bool = False) -> DataFrame:
    """Parsed reports of all files under the paths (globs allowed); with ``known_only`` those that no reader knows are left out."""
    reader = spark.read.option("pathGlobFilter", "*.{" + ",".join(_any_case(x[1:]) for x in ROUTES) + "}") if known_only else spark.read
    return parse_files(reader.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)))


def _any_case(suffix_: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in suffix_)


def reports_of(parsed: DataFrame) -> DataFrame:
    """``doc_id, file_path, filename, sha1_name, document_type`` and the counts of each parsed report."""
    kept = F.size("pages")
    return parsed.select(
        F.sha2("path", 256).alias("doc_id"), F.col("path").alias("file_path"), basename(F.col("path")).alias("filename"), stem(F.col("path")).alias("sha1_name"), "document_type",
        kept.alias("pages_amount"), kept.alias("text_blocks_amount"), "tables_amount", "pictures_amount",
    )


def pages_of(parsed: DataFrame) -> DataFrame:
    """``doc_id, page, text`` and the layout of all pages that aren't blank; PDF text is cleaned."""
    each = parsed.select(F.sha2("path", 256).alias("doc_id"), "document_type", F.inline("pages"))
    text = F.when(F.col("document_type") == "pdf", clean_text(F.col("text"))).otherwise(F.col("text"))
    return each.select("doc_id", "page", strip(text).alias("text"), "layout_type", "column_count", "extraction_method").where(filled(F.col("text")))
