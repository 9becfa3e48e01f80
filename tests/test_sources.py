"""Reading files, the store, the log, the pipeline and the stream, on files made here."""

import contextlib
import random
import sys
import types
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.functions import tokens
from quillon.operators import layout
from quillon.plans.pipeline import Pipeline, system_prompt
from quillon.sources import files
from quillon.sources.store import Store, append_log
from quillon.streaming.ingest import ingest_stream

A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="p" xmlns:c="c" xmlns:r="r"'
SLIDE = f"""<p:sld {A}><p:cSld><p:spTree>
<p:sp><p:nvSpPr><p:cNvPr id="1" name="T"/><p:cNvSpPr txBox="1"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>Revenue rose</a:t></a:r></a:p><a:p><a:r><a:t>in 2020</a:t></a:r></a:p></p:txBody></p:sp>
<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>
<p:graphicFrame><c:chart r:id="rId1"/></p:graphicFrame>
<p:pic><p:nvPicPr><p:cNvPr id="2" name="Logo"/></p:nvPicPr><p:spPr><a:ext cx="10" cy="20"/></p:spPr></p:pic>
<p:grpSp><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>inside</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp>
<p:sp><p:nvSpPr><p:cNvPr id="3" name="Line"/></p:nvSpPr></p:sp>
</p:spTree></p:cSld></p:sld>"""
CHART = '<c:chartSpace xmlns:c="c" xmlns:a="a"><c:title><a:p><a:r><a:t>Sales</a:t></a:r></a:p></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:v>North</c:v></c:tx></c:ser></c:barChart></c:plotArea></c:chartSpace>'
RELS = '<Relationships><Relationship Id="rId1" Target="../charts/chart1.xml"/></Relationships>'
BOOK = '<workbook xmlns:r="r"><sheets><sheet name="BS" r:id="rId1"/><sheet name="Empty" r:id="rId2"/></sheets></workbook>'
BOOK_RELS = '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
SHEET = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="inlineStr"><is><t>y</t></is></c></row></sheetData></worksheet>'


def make(folder, name="a"):
    with zipfile.ZipFile(folder / f"{name}.PPTX", "w") as z:
        z.writestr("ppt/slides/slide1.xml", SLIDE)
        z.writestr("ppt/slides/slide2.xml", f"<p:sld {A}><p:spTree/></p:sld>")
        z.writestr("ppt/slides/_rels/slide1.xml.rels", RELS)
        z.writestr("ppt/charts/chart1.xml", CHART)
    with zipfile.ZipFile(folder / f"{name}.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", BOOK_RELS)
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet/>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Cash</t></si></sst>")
    (folder / f"{name}.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\nBT (Profit \\(net\\)) Tj T* (was 1 ,234) Tj ET\nendstream\nendobj\n")
    (folder / f"{name}_broken.pptx").write_bytes(b"no zip")
    (folder / f"{name}.txt").write_bytes(b"text")


def test_readers(tmp_path):
    make(tmp_path)
    pages, tables, images = files.read_pptx((tmp_path / "a.PPTX").read_bytes())
    assert (tables, images) == (1, 1)
    assert pages == [(1, "Text Frame (type: TEXT_BOX (17)):\nRevenue rose\nin 2020\n\nTable (type: TABLE (19)):\nx | \n\nChart (type: CHART (3)):\nTitle: Sales\nChart Type: barChart\nData Series: 1 series\nSeries 1: North\n\nImage (type: PICTURE (13)):\nName: Logo\nDimensions: 10 x 20\n\nGroup (type: GROUP (6)):\nText Frame (type: PLACEHOLDER (14)):\ninside\n\nOther (type: None):\nObject: Line")]
    assert files.read_xlsx((tmp_path / "a.xlsx").read_bytes()) == ([(1, "Sheet: BS\nCash |  | 5\ny")], 2, 0)
    assert list(files.plain_pdf((tmp_path / "a.pdf").read_bytes())) == ["Profit (net)\nwas 1 ,234"]


def test_slides_in_the_order_of_the_presentation(tmp_path):
    one = lambda t: f'<p:sld {A}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    with zipfile.ZipFile(tmp_path / "x.pptx", "w") as z:
        for n in (1, 2, 3):
            z.writestr(f"ppt/slides/slide{n}.xml", one(f"slide {n}"))
        z.writestr("ppt/presentation.xml", '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="rId9"/><p:sldId id="257" r:id="rId7"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="rId7" Target="slides/slide1.xml"/><Relationship Id="rId9" Target="slides/slide3.xml"/></Relationships>')
    pages, _, _ = files.read_pptx((tmp_path / "x.pptx").read_bytes())
    assert [(n, t.split("\n")[1]) for n, t in pages] == [(1, "slide 3"), (2, "slide 1")]


class Page:
    """A page as a PDF reader gives it: characters by position, in columns."""

    def __init__(self, xs, texts, width=1000.0, preserved="", tables=()):
        self.chars, self.width, self.height, self._texts, self._preserved, self._tables = [{"x0": x} for x in xs], width, 700.0, texts, preserved, list(tables)

    def extract_text(self, layout=False, **_):
        return self._preserved if layout else "".join(self._texts)

    def within_bbox(self, box):
        return Page([], [t for k, t in enumerate(self._texts) if box[0] <= self.width * (k + 0.5) / max(1, len(self._texts)) < box[2]])

    def extract_tables(self):
        if self._tables == ["broken"]:
            raise ValueError
        return self._tables


def readers(monkeypatch, plumbed=None, plain=None):
    def module(name, found):
        if found is None:
            monkeypatch.setitem(sys.modules, name, None)
            return
        m = types.ModuleType(name)
        m.open = lambda _: contextlib.nullcontext(found() if callable(found) else found)
        m.PdfReader = lambda _: found() if callable(found) else found
        monkeypatch.setitem(sys.modules, name, m)

    module("pdfplumber", plumbed)
    module("pypdf", plain)


def test_pdf_columns_and_parts(monkeypatch):
    two = [x for x in range(0, 400, 3)] + [x for x in range(600, 1000, 3)]
    pages = [Page(two, ["left", "right"]), Page(range(0, 1000, 9), ["plain"], preserved="p l a i n", tables=[[["a", None]], []]), Page(range(0, 1000, 9), [" "]), Page([i % 1000 for i in range(1500)], ["full"], preserved="full", tables=["broken"])]
    readers(monkeypatch, types.SimpleNamespace(pages=pages))
    got, tables, pictures = files.read_pdf(b"")
    assert got == [
        (1, "||COLUMN|| left\n\n||COLUMN|| right", "multi_column", 2, "coordinate_based"), (2, "plain\n\n=== Layout Preserved ===\n\np l a i n\n\n=== Tables ===\n\nTable 1:\na |", "single_column", 1, "coordinate_based"),
        (4, "full", "complex", 1, "coordinate_based"),
    ]
    assert (tables, pictures) == (0, 0)


def test_pdf_reader_that_fails(monkeypatch):
    def broken():
        raise RuntimeError("no pages")

    readers(monkeypatch, broken, types.SimpleNamespace(pages=[Page([], ["second "]), Page([], [""])]))
    assert files.read_pdf(b"")[0] == [(1, "second")]
    readers(monkeypatch, broken, broken)
    with pytest.raises(RuntimeError):
        files.read_pdf(b"")
    readers(monkeypatch)
    assert files.read_pdf(b"no pdf")[0] == []


def test_layout_of_one_page_as_of_many(spark):
    rng = random.Random(2)
    pages = {i: [rng.choice((0, 500, 820)) + rng.uniform(0, rng.choice((100, 300, 480))) for _ in range(rng.choice((30, 1200)))] for i in range(25)} | {98: [-5.0, 1005.0], 99: [500.0]}
    df = spark.createDataFrame([(i, float(x), 1000.0) for i, xs in pages.items() for x in xs], "page int, x double, width double")
    hist = layout.histogram(df).cache()
    kinds = {r.page: (r.layout_type, r.column_count, r.extraction_method) for r in layout.layouts(hist).collect()}
    pairs = {}
    for r in layout.column_pairs(layout.gaps(hist), df.select("page", "width").distinct()).orderBy("page", "column").collect():
        pairs.setdefault(r.page, []).append((r.left, r.right))
    for i, xs in pages.items():
        *kind, columns = layout.page_layout(xs, 1000.0)
        assert tuple(kind) == kinds[i] and columns == pairs.get(i, []), i
    assert layout.page_layout([], 10) == layout.page_layout([1], 0) == ("single_column", 1, "standard", [])


def test_answers_of_failing_services(spark, tmp_path):
    def tired(prompt):
        if "Reply with JSON" in prompt or "text blocks" in prompt:
            raise RuntimeError
        return "plain reply"

    source = tmp_path / "in"
    source.mkdir()
    make(source)
    q = spark.createDataFrame([(1, "What was the net profit?")], "qid long, question string")
    p = Pipeline(spark, str(tmp_path / "store"), score=tired, generate=tired, count=lambda t: len(t), lists=2, probes=2)
    p.ingest(str(source))
    row = p.answer(q).first()
    assert (row.answer, row.confidence_level, row.reasoning_summary) == ("plain reply", "low", "Error in structured processing")
    assert row.performance_metrics.output_tokens == 11 and row.retrieval_metrics.final_results == 3
    assert {r.llm_score for r in p.retrieve(q).collect()} == {0.5}
    silent = Pipeline(spark, p.store.folder, generate=lambda _: 1 / 0)
    assert silent.answer(q).first().answer == ""


def test_ingest_and_index_add_what_is_new(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    make(source)
    p = Pipeline(spark, str(tmp_path / "store"))
    first = p.ingest(str(source))
    assert (first["pages"], first["chunks"]) == (3, 3) and p.index().count() == 3
    make(source, "b")
    assert p.ingest(str(source))["chunks"] == 3 and p.index().count() == p.index().count() == 6
    assert p.store.load("reports").count() == 10
    ingest_stream(spark, str(source), p.store.folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert p.store.load("reports").count() == 10 and p.index().count() == 6


def test_a_stream_batch_that_runs_again_takes_its_own_place(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        store.put("t", spark.range(3), "stream-1")
    store.put("t", spark.range(2), "stream-2")
    assert store.load("t").count() == 5 and store.load("t", but="stream-1").count() == 2 and store.load("t").columns == ["id"]
    assert store.load("none") is None


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    make(source)
    where = ["--store", str(tmp_path / "store")]
    assert main([*where, "x"]) == 1
    assert main([*where, "--files", str(source), "--", "What", "was", "the", "net", "profit?"]) == 0
    said = iter(["", "Which cash?", " Quit "])
    assert main(where, lambda _: next(said)) == 0
    out = capsys.readouterr().out
    assert "parsed: 3" in out and "Profit" in out and "Cash" in out and "Score Range: " in out and "No sources identified" in out
    assert spark.read.json(str(tmp_path / "store" / "log")).count() == 2


def test_token_counters():
    assert tokens.counter()("net profit, 12") == 4 and tokens.counter("m", None) is tokens.builtin

    def load(name):
        if name != "cl100k_base":
            raise KeyError(name)
        return list

    assert tokens.counter("m", load)("abc") == 3 and tokens.counter("m", lambda n: {}[n]) is tokens.builtin
    assert tokens.counter("m", lambda _: str.split)("a b") == 2


def test_pipeline_store_and_log(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    make(source)
    p = Pipeline(spark, str(tmp_path / "store"))
    assert not p.store.exists()
    assert p.ingest(str(source)) == {"parsed": 3, "failed": 2, "pages": 3, "chunks": 3}
    assert {r.document_type for r in p.store.load("reports").collect()} == {"pdf", "pptx", "excel", "failed"}
    assert {r.text for r in p.store.load("pages").where("text like 'Profit%'").collect()} == {"Profit (net)\nwas 1,234"}
    assert p.index().count() == 3 and p.store.exists()
    q = spark.createDataFrame([(1, "What was the net profit?"), (2, "Which cash?")], "qid long, question string")
    log = {r.qid: r for r in p.answer(q).collect()}
    assert "Profit" in log[1].answer and "Cash" in log[2].answer
    times = log[1].performance_metrics
    assert log[1].retrieval_metrics.final_results == 3 and times.total_tokens == times.input_tokens + times.output_tokens
    assert times.total_time_s >= times.retrieval_time_s > 0 and abs(times.end_time - times.start_time - times.total_time_s) < 0.01
    assert p.store.stats().first()["document_count"] == 3
    p.answer(q, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    for kind in ("json", "csv", "parquet"):
        append_log(p.answer(q), str(tmp_path / kind), kind)
        append_log(p.answer(q), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 4
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none")).stats()
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.txt").write_bytes(b"x")
    with pytest.raises(RuntimeError):
        p.ingest(str(bad))


def test_stream_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    make(source)
    store = Store(spark, str(tmp_path / "store"))
    for name in (None, "b", None):
        if name:
            make(source, name)
        ingest_stream(spark, str(source), store.folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.load("reports").count() == 10
    assert store.load("reports").select("doc_id").distinct().count() == 10
    assert store.load("chunks").count() == 6


def test_prompt():
    assert system_prompt(" a ") == "a"
    assert system_prompt("a", "S", "e").count("---") == 2


def test_routes(spark):
    df = spark.createDataFrame([("x/A.PDF",), ("b.ppt",), ("c.xls",), ("d.txt",), ("e",)], "path string")
    assert [r[0] for r in df.select(files.route(F.col("path"))).collect()] == ["pdf", "pptx", "excel", None, None]
