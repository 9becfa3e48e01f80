"""Operators against brute force on small tables, with nulls, blanks, ties and empty tables."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import scores, text
from quillon.functions.sampling import hash_sample
from quillon.functions.text import TOKEN
from quillon.operators import chunking, knn, layout, models, pages, retrieval, slides

PAGES = "doc_id string, page int, text string, layout_type string, column_count int, extraction_method string"


def pages_of(spark, *rows):
    return spark.createDataFrame([(*r, None, None, None)[:6] if len(r) == 3 else r for r in rows], PAGES)


def test_bounds_and_blocks_tile_the_document(spark):
    p = pages_of(spark, *[("d", n, None if n % 5 == 0 else "x" * (n % 7)) for n in range(1, 700)], ("e", 2, " "), ("f", 1, "y"))
    bounds = {(r.doc_id, r.page): (r.start, r.end) for r in pages.page_bounds(p).collect()}
    blocks = sorted(pages.combine_pages(p, 100).where("doc_id = 'd'").collect(), key=lambda r: r.block)
    whole = "".join(b.text for b in blocks)
    assert all(b.start == len("".join(x.text for x in blocks[:i])) for i, b in enumerate(blocks))
    at = 0
    for n in range(1, 700):
        if n % 5 and n % 7:
            a, z = bounds["d", n]
            assert a == at and whole[a:z] == f"\n--- PAGE {n} ---\n{'x' * (n % 7)}\n"
            at = z
    assert ("e", 2) not in bounds and bounds["f", 1][0] == 0


def test_covered_pages(spark):
    b = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 10, 20000), ("d", 3, 20000, 20005)], "doc_id string, page int, start long, end long")
    c = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 9, 11), ("d", 3, 10, 20001), ("d", 4, 30000, 30001), ("x", 1, 0, 5)], "doc_id string, chunk int, start long, end long")
    got = {(r.doc_id, r.chunk): r.pages for r in pages.covered_pages(c, b).collect()}
    assert got == {("d", 1): [1], ("d", 2): [1, 2], ("d", 3): [2, 3], ("d", 4): [1], ("x", 1): [1]}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。\n，漢字.", max_size=300), st.integers(2, 12), st.integers(0, 6))
def test_recursive_split(t, size, overlap):
    import regex

    count = lambda x: len(regex.findall(TOKEN, x))
    chunks = chunking.split_recursively(t, size, min(overlap, size - 1))
    assert all(count(c) <= size for c in chunks)
    assert all(c in t for c in chunks)
    assert all(ch in "".join(chunks) for ch in set(t) if not ch.isspace())


def test_window_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, " "), (3, None), (4, "a")], "id int, t string")
    got = {(r.id, r.chunk): r.text for r in chunking.window_chunks(df, "id", "t", 4, 1).collect()}
    assert got == {(1, 1): "0 1 2 3", (1, 2): "3 4 5 6", (1, 3): "6 7 8 9", (4, 1): "a"}


def test_document_chunks(spark):
    p = pages_of(spark, ("a", 1, "Sheet: S\n1 | 2"), ("b", 1, "slide"), ("b", 2, " "), ("c", 1, "plain"), ("g", 1, "one"), ("g", 2, "two"), ("h", 1, "lost"))
    p = p.unionByName(spark.createDataFrame([("c", 2, "left||COLUMN|| ||COLUMN||right", "multi_column", 2, "coordinate_based"), ("c", 3, "merged", "multi_column", 2, "x"), ("c", 4, "odd", "complex", 2, "y")], PAGES))
    r = spark.createDataFrame([("a", "excel"), ("b", "pptx"), ("c", "pdf"), ("g", "other"), ("h", "failed")], "doc_id string, document_type string").withColumns({"filename": F.col("doc_id"), "sha1_name": F.col("doc_id")})
    got = {(x.doc_id, x.page, x.chunk): x for x in chunking.chunk_documents(p, r).collect()}
    assert got["a", 1, 1].sheet_name == "S" and got["a", 1, 1].content_type == "excel_full_sheet"
    assert got["b", 1, 1].slide_number == 1 and ("b", 2, 1) not in got
    assert got["c", 1, 1].content_type == "pdf_single_column" and got["c", 1, 1].extraction_method == "standard"
    assert [(got["c", 2, k].page_content, got["c", 2, k].column, got["c", 2, k].total_chunks) for k in (1, 2)] == [("left", 1, 2), ("right", 3, 2)]
    assert got["c", 3, 1].content_type == "pdf_multi_column_merged" and got["c", 4, 1].content_type == "pdf_complex_layout"
    assert got["g", 1, 1].page_range == "1,2" and got["g", 1, 1].spans_pages
    assert not any(k[0] == "h" for k in got)
    assert chunking.chunk_documents(p.limit(0), r).count() == 0


def test_layout_against_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(p, float(x)) for p in range(6) for x in np.concatenate([rng.uniform(0, 40, 30 * p), rng.uniform(60, 100, 40), [-3.0, 120.0]])]
    df = spark.createDataFrame([(p, x, 100.0) for p, x in rows] + [(0, None, 100.0), (9, 1.0, 0.0)], "page int, x double, width double")
    hist = layout.histogram(df)
    want = np.zeros((6, 50), int)
    for p, x in rows:
        want[p, min(max(int(x // 2), 0), 49)] += 1
    got = np.zeros((6, 50), int)
    for r in hist.collect():
        got[r.page, r.bin] = r.n
    assert (got == want).all()
    expect = set()
    for p in range(6):
        smooth = [np.mean(want[p, max(0, i - 1) : i + 2]) for i in range(50)]
        low = [s <= 0.1 * want[p].sum() / 50 for s in smooth] + [False]
        start = None
        for i, x in enumerate(low):
            if x and start is None:
                start = i
            if not x and start is not None:
                if i - start >= 2:
                    expect.add((p, start, i - 1))
                start = None
    assert {tuple(r) for r in layout.gaps(hist).collect()} == expect
    kinds = {r.page: r for r in layout.layouts(hist).collect()}
    assert all(kinds[p].column_count == 1 + sum(e[0] == p for e in expect) for p in range(6))


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_knn_exact(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "VECTOR_BLOCK", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[10] = x[11]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<float>")
    got = knn.knn_batch(df, df.where("vec_id % 10 = 0"), 5, metric).collect()
    d = knn._distances(x[::10].astype(float), x.astype(float), metric)
    for r in got:
        want = np.lexsort((np.arange(200), np.round(d[r.qid // 10], 9)))[:5]
        assert abs(d[r.qid // 10][want[r.rank - 1]] - r.distance) < 1e-6
    assert len(got) == 100
    if metric == "l2sq":
        one = knn.top_k(df, x[10].tolist(), 2).collect()
        assert [r.vec_id for r in one] == [10, 11]
    assert knn.knn_batch(df.limit(0), df.limit(0)).count() == 0


def test_lists_recall(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0")
    near = knn.knn_lists(e, asked, knn.Lists.fit(e, 16), 13).select("qid", "vec_id")
    exact = knn.knn_batch(e, asked).select("qid", "vec_id")
    assert exact.intersect(near).count() >= 0.9 * exact.count()


def test_parents_both_modes(spark):
    hits = spark.createDataFrame([(1, 1, "a", 1, None, False), (1, 2, "b", 1, None, None), (1, 3, "a", 2, "2,3", True), (1, 4, "a", 1, None, False)], "qid int, rank int, doc_id string, page int, page_range string, spans_pages boolean")
    assert [(r.rank, r.position) for r in retrieval.parent_pages(hits).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert [(r.rank, r.position) for r in retrieval.parent_pages(hits, compat=True).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    p = pages_of(spark, ("a", 1, "A1"), ("b", 1, "B1"), ("a", 2, "A2"), ("a", 3, " "))
    texts = {r.rank: r.text for r in retrieval.parent_content(retrieval.parent_pages(hits), p).collect()}
    assert texts == {1: "A1", 2: "B1", 3: "[Page 2]\nA2"}
    old = {r.rank: r.text for r in retrieval.parent_content(retrieval.parent_pages(hits, True), p, True).collect()}
    assert old[1] == "B1"


def test_scores_by_slot_both_modes(spark):
    docs = spark.createDataFrame([(1, r, "t", 0.0 if r == 1 else None) for r in range(1, 6)], "qid int, rank int, text string, distance double")
    placed = retrieval.batches(docs)
    assert {r.rank: (r.batch, r.slot, r.blocks) for r in placed.collect()} == {1: (0, 0, 2), 2: (0, 1, 2), 3: (1, 0, 2), 4: (1, 1, 2), 5: (2, 0, 1)}
    replies = spark.createDataFrame([(1, 0, [0.8]), (1, 1, [0.1, 0.2, 0.9])], "qid int, batch int, scores array<double>")
    new = {r.rank: r for r in retrieval.with_scores(placed, replies).collect()}
    assert new[2].llm_score == 0.5 and new[5].llm_score == 0.5 and new[1].combined_score == pytest.approx(0.86)
    assert {r.rank for r in retrieval.with_scores(placed, replies, compat=True).collect()} == {1, 3, 4}
    top = retrieval.best(retrieval.with_scores(placed, replies), 2).orderBy("position").collect()
    assert [t.rank for t in top] == [1, 2]


def test_similarity(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (None,), (-1.0,), (-3.0,)], "d double")
    assert [round(r[0], 4) for r in d.select(scores.similarity(F.col("d"))).collect()] == [1.0, 0.5, 0.6667, 1.0, 0.0]
    t = spark.createDataFrame([(10, 0.0), (10, 3.0)], "n int, s double")
    assert [r[0] for r in t.select(scores.throughput(F.col("n"), F.col("s"))).collect()] == [0.0, 3.33]


def test_slides(spark):
    s = spark.createDataFrame(
        [("d", 1, 1, "table", "T", "a | b"), ("d", 1, 2, "image", None, None), ("d", 1, 3, "text", "", " x "), ("d", 1, 4, "other", "", " "), ("d", 2, 1, "text", "", None)],
        "doc_id string, slide int, ord int, kind string, type_info string, text string",
    )
    assert [tuple(r) for r in slides.slide_texts(s).collect()] == [("d", 1, "Table (type: T):\na | b\n\nImage:\n\n\nText Frame:\n x")]
    assert tuple(slides.shape_counts(s).first()) == ("d", 1, 0, 1, 1)


def test_requests_are_halved():
    sent = []

    def embed(texts):
        sent.append(len(texts))
        if len(texts) > 60:
            raise models.TooManyTokens
        return [[0.0]] * len(texts)

    assert len(models.in_requests(["x"] * 130, embed)) == 130
    assert sent == [100, 50, 50, 30]


def test_hash_sample(spark):
    df = spark.range(5000).union(spark.range(100))
    got = [r[0] for r in hash_sample(df, ["id"], 50).collect()]
    assert len(got) == len(set(got)) == 50
    assert hash_sample(df.limit(0), ["id"], 5).count() == 0


def test_overlap_across_blocks(spark, monkeypatch):
    from quillon.operators import pages as pages_

    monkeypatch.setattr(pages_, "BLOCK_PAGES", 2)
    monkeypatch.setattr(pages_.combine_pages, "__defaults__", (2,))
    rng = random.Random(1)
    rows = [("d", n, " ".join(f"w{rng.randrange(10**6)}." for _ in range(300))) for n in range(1, 8)]
    got = sorted(chunking.cross_page_chunks(pages_of(spark, *rows)).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in got] == list(range(1, got[0].total_chunks + 1)) and {r.block for r in got} == {0, 1, 2, 3}
    for a, b in zip(got, got[1:]):
        assert a.start < b.start <= a.end and (a.block == b.block or b.start < a.end)
    whole = "".join(f"\n--- PAGE {n} ---\n{t}\n" for _, n, t in rows)
    assert all(whole[r.start : r.end].split()[-1] == r.page_content.split()[-1] for r in got)
    assert got[0].start == 1 and got[-1].end == len(whole) - 1


def test_spans_carry_the_end_of_what_stands_before():
    before, after = "a b c d. e f g h. ", "i j k l. m n o p. q r s t. "
    spans = chunking.split_spans(after, 10, 5, before=before)
    assert [(before + after)[len(before) + a : len(before) + b] for a, b in spans] == ["e f g h. i j k l. ", "i j k l. m n o p. ", "m n o p. q r s t. "]
    assert chunking.split_spans(after, 10, 5) == [(0, 18), (9, 27)] and chunking.split_spans(after, 15, 5) == [(0, 27)]


def test_a_long_document_is_cut_in_linear_time():
    long = ("One sentence of some words. " * 40 + "\n\n") * 4000
    began = time.monotonic()
    spans = chunking.split_spans(long)
    assert spans[-1][1] == len(long) and all(b <= c for (_, b), (_, c) in zip(spans, spans[1:])) and time.monotonic() - began < 60


def test_page_ranges(spark):
    df = spark.createDataFrame([("5,6", True), ("6, 5", True), ("5-6", True), ("5–7", True), ("9~8", True), ("1-999999999", True), ("x", True), (None, True), ("5,6", None)], "r string, s boolean")
    got = [r[0] for r in df.select(text.page_numbers(F.col("r"), F.col("s"), F.lit(4))).collect()]
    assert got == [[5, 6], [5, 6], [5, 6], [5, 6, 7], [8, 9], [1, 999999999], [4], [4], [4]]
