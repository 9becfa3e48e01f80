"""Splitting: tiling, limits, boundaries, and the stated cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import splitting as s


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab漢 \n\r\t。，.", max_size=400), st.integers(1, 40))
def test_cut_points(text, limit):
    codes = s.codes_of(text)
    ends = s.cut_points(codes, limit)
    assert ends[-1] == len(text) and all(0 <= b - a <= limit for a, b in zip([0, *ends], ends))
    longest = max(map(len, re.split("[ \t\r\n。！？；，、]", text)))
    assert s.longest_run(codes) == longest
    if longest < limit // 2 and "\r\n" not in text and limit > 4:
        assert all(text[e - 1] in s.BREAKS for e in ends[:-1])


def test_strongest_near_the_middle():
    text = "aaaa bbbb，cccc。dddd eeee"
    assert s.cut_points(s.codes_of(text), 15)[0] == text.index("。") + 1
    assert s.cut_points(s.codes_of("x" * 10), 4) == [2, 5, 7, 10]


def test_pieces(spark, make):
    long = "段落一。" * 40 + "\n\n" + "word " * 60
    rows = [("page", "a", long, "1", 100, 20), ("page", "b", "short", "1", 100, 20), ("page", "c", None, "1", 100, 20), ("page", "d", "y" * 250, "2", 100, None), ("page", "e", "z" * 5, "1", None, 1), ("page", "f", "q q" * 9, None, 5, 9), ("page", "g", "", "1", 1, 0)]
    df = make(rows, "item_kind string, item_id string, text string, pages string, max_size int, overlap int")
    got = {}
    for r in s.split_oversized(df).collect():
        got.setdefault(r.item_id, []).append(r)
    assert set(got) == {"a", "d", "f"}
    for name, text, size, overlap in (("a", long, 100, 20), ("d", "y" * 250, 100, 0), ("f", "q q" * 9, 5, 0)):
        own = sorted(got[name], key=lambda r: r.piece)
        assert "".join(text[r.start : r.end] for r in own) == text
        assert all(r.text == text[max(0, r.start - overlap) : r.end] and len(r.text) <= size for r in own)
        assert all(r.pieces == len(own) for r in own)
    assert {n: {r.cut for r in rs} for n, rs in got.items()} == {"a": {"natural"}, "d": {"forced", "natural"}, "f": {"natural"}}
    assert [r.cut for r in sorted(got["d"], key=lambda r: r.piece)] == ["forced"] * (len(got["d"]) - 1) + ["natural"]
    assert {r.item_id: r.cut for r in s.spans(df).collect()} == {"a": "natural", "d": "forced", "f": "natural"}
    assert s.split_oversized(df.limit(0)).count() == 0


def test_pages_of_ranges(spark, make):
    from pyspark.sql import functions as F

    df = make([("6,5", 5), ("5, 6", 5), ("5-7", 5), (None, 4), ("x", 4), ("5", 4), ("7-999999999", 4)], "r string, p int")
    assert [r[0] for r in df.select(s.normalised_pages(F.col("r"), F.col("p"))).collect()] == ["5,6", "5,6", "5,6,7", "4", "4", "5", "7-999999999"]


def test_forced_piece_of_a_run_within_the_size(spark, make):
    df = make([("page", "a", "x" * 90 + " " + "y" * 60, "1", 100, 40)], "item_kind string, item_id string, text string, pages string, max_size int, overlap int")
    assert {r.cut for r in s.spans(df).collect()} == {"natural"}
    rows = sorted(s.split_oversized(df).collect(), key=lambda r: r.piece)
    assert all((r.cut == "natural") == (r.end == 151 or df.first().text[r.end - 1] == " ") for r in rows) and any(r.cut == "forced" for r in rows)


def test_a_very_long_text(spark, make):
    text = ("段落一，還有一句。" * 5 + "\n") * 1_100_000  # over 50 million characters
    df = spark.range(1).selectExpr("'page' item_kind", "'a' item_id", "repeat('" + text[:46].replace("\n", "\\n") + "', 1100000) text", "'1' pages", "1000 max_size", "100 overlap")
    pieces = s.split_oversized(df).selectExpr("count(*) n", "sum(end - start) chars", "max(length(text)) longest", "count_if(cut = 'forced') forced").first()
    assert (pieces.chars, pieces.forced) == (len(text), 0) and pieces.longest <= 1000 and pieces.n < 2.5 * len(text) / 900


def test_scopes(spark, make):
    limits = s.sizes(make([("pages.text", "chars", 10, 2), ("pdf", "chars", 20, 1), ("default", "chars", 30, None), ("container", "tokens", 5, 0)], "scope string, unit string, max_size int, overlap int"))
    p = make([("d", 1, "t")], "doc_id string, page int, text string")
    c = make([("c1", "t", None, 1, "pdf"), ("c2", "t", None, 1, None), ("c3", "t", None, 1, "odd")], "chunk_id string, page_content string, page_range string, page int, document_type string")
    assert {r.item_id: (r.max_size, r.overlap) for r in s.items(p, c, limits).collect()} == {"d#1": (10, 2), "c1": (20, 1), "c2": (30, 0), "c3": (30, 0)}
    assert {r.max_size for r in s.items(p, c, {}).collect()} == {None}
    with pytest.raises(ValueError):
        s.sizes(spark.range(2000).selectExpr("cast(id as string) scope", "'chars' unit", "1 max_size", "0 overlap"))
