"""Languages: the automaton, cleaning of wrong labels, held-out sentences, mixed texts and the edges."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import languages as l

TEXT = {
    "en": "The unit cost of server racks fell by 3.1% during the year. Orders from Japan represented a third of the total. Headcount at the office increased to 20 people. Lenders have been notified of the change. The company expects revenue to recover in the next quarter.",
    "de": "Die Stückkosten der Serverschränke sanken um 3,1 %. Die Bestellungen aus Japan machten ein Drittel aus. Das Büro zählt jetzt zwanzig Beschäftigte. Die Banken wurden über die Änderung unterrichtet. Die Firma erwartet im nächsten Quartal wieder höhere Erlöse.",
    "fr": "Le coût unitaire des baies a baissé de 3,1 %. Les commandes du Japon représentent un tiers du total. Le bureau compte désormais vingt personnes. Les banques ont été informées du changement. La société prévoit une reprise du chiffre d'affaires au prochain trimestre.",
    "zh-Hant": "伺服器機櫃的單位成本下降了百分之三。來自日本的訂單占總額的三分之一。財務處的員工人數增加至二十人。往來銀行已獲通知此一變化。公司預期營業收入將於下一季回升。",
    "zh-Hans": "服务器机柜的单位成本下降了百分之三。来自日本的订单占总额的三分之一。财务处的员工人数增加至二十人。往来银行已获通知此一变化。公司预期营业收入将于下一季回升。",
    "ja": "サーバーラックの単位原価は三パーセント下がりました。日本からの注文は全体の三分の一を占めました。財務部の人員は二十人に増えました。取引銀行には変更を知らせました。会社は来期の売上の回復を見込んでいます。",
}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abc", max_size=12))
def test_automaton(text, word):
    nodes = l.automaton(text)
    at = 0
    for ch in word:
        at = nodes[at].get(ch) if at is not None else None
    assert (at is not None) == (word in text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(["de", "en", "ja"]), st.text(alphabet="abc年 ", max_size=60), max_size=3), st.lists(st.text(alphabet="abcd年月 ", min_size=1, max_size=40), max_size=12))
def test_side_by_side_counts(texts, clauses):
    automata = l.Automata(texts)
    want = [[l.phrases(c, nodes) for nodes in automata.plain()] for c in clauses]
    assert automata.counts(clauses).tolist() == want


def test_phrases():
    root = l.automaton("abcab")
    assert l.phrases("abcab", root) == 1 and l.phrases("cabc", root) == 2 and l.phrases("zz", root) >= 4


@pytest.fixture(scope="module")
def judge():
    return l.Judge(l.Automata({k: "\n".join(s for _, _, s, _ in l.sentences(v)) for k, v in TEXT.items()}))


def segs(text, judge):
    (own,) = l.segments([text], judge)
    return own


def test_mixed_text(judge):
    text = "Annual outlook\n\n" + "The company expects orders to recover during the year. 公司預期訂單將於下一季回升，員工人數增加。公司预期订单将于下一季回升，员工人数增加。\nDie Firma erwartet im nächsten Quartal höhere Bestellungen."
    got = segs(text, judge)
    assert [g[2] for g in got if g[4]] == ["en", "zh-Hant", "zh-Hans", "de"]
    assert all(0.5 <= g[3] <= 1 and text[g[0] : g[1]].strip() for g in got)


def test_quoted_names_and_numbers_are_no_sentences(judge):
    assert segs("1,234  5,678 | 9%.\n", judge) == []
    assert segs(None, judge) == segs("", judge) == segs(" \n", judge) == []
    got = segs("公司預期「The company expects orders to recover.」之後，訂單將於下一季回升，員工人數增加。", judge)
    assert {g[2] for g in got} == {"zh-Hant"}
    assert [g[2] for g in segs("Oskquell Precision的營業收入將於下一季回升。", judge)] == ["zh-Hant"]


def test_counts_are_whole_whatever_was_seen_before():
    automata = l.Automata({"a": "abcdefghij", "b": "klmnopqrst"})
    whole = lambda text: tuple(l.phrases(text, nodes) for nodes in automata.plain())
    for seen in ([], ["klmnopqrst"], ["abcdefghij"]):
        judge = l.Judge(automata)
        judge.read(seen)
        clause = "abcdefghij" * 4
        best, other = judge.totals(clause)
        assert (best, other) == whole(clause) and judge.language(clause) == ("a", other / (best + other))
    first, second = "k" * 20 + "l", "abcdefghij"
    total = [x + y for x, y in zip(whole(first), whole(second))]
    assert l.Judge(automata).totals(f"{first}, {second}") == tuple(total)


def test_order_and_batches_do_not_matter(judge):
    texts = [" ".join(random.Random(i).sample([v[a:b] for v in TEXT.values() for a, b, _, _ in l.sentences(v)], 6)) for i in range(40)]
    want = list(l.segments(texts, judge))
    back = l.Judge(judge.automata)
    assert [segs(t, back) for t in reversed(texts)] == want[::-1]


def test_long_clauses_are_read_alone(judge, monkeypatch):
    long = ["the company expects orders " * 300, "公司預期訂單將於下一季回升" * 500]
    want = judge.automata.counts(long).tolist()
    monkeypatch.setattr(l, "SIDE_BY_SIDE_CHARS", 1 << 30)
    assert judge.automata.counts(long).tolist() == want


def test_short_sentences(judge):
    for text, lang in (("Orders increased.", "en"), ("毛利上升。", None), ("Umsatz stieg wieder.", "de"), ("来自日本。", "zh-Hans"), ("Les banques ont baissé.", "fr")):
        got = segs(text, judge)
        assert [g[4] for g in got] == [1] and (lang is None or got[0][2] == lang), (text, got)
    for text in ("Im 4.", "Acme Corp.", "No. 5.", "3%。", "A1 B2.", "合計。", "Annual Report", "Inc."):
        assert segs(text, judge) == [], text
    text = "Die Firma erwartet im nächsten Quartal höhere Erlöse. Banken stiegen."
    assert {g[2] for g in segs(text, judge)} == {"de"}


def test_wrong_labels_are_cleaned():
    rng = random.Random(1)
    parts = {k: [v[a:b] for a, b, _, _ in l.sentences(v)] for k, v in TEXT.items()}
    sample = []
    for i in range(120):
        k = rng.choice(list(TEXT))
        label = rng.choice(list(TEXT)) if i % 8 == 0 else k
        sample.append((label, " ".join(rng.sample(parts[k], 3))))
    texts = l.cleaned(sample)
    judge = l.Judge(l.Automata(texts))
    right = sum(judge.language(l.prepared(s)[0])[0] == k for k, own in parts.items() for s in own)
    assert right >= 28


def test_rows(spark, make):
    docs = [(i, TEXT[k], k.upper(), None) for i, k in enumerate(sorted(TEXT) * 4)] + [(100, None, "en", "x"), (101, " ", None, "x"), (102, TEXT["de"] * 200, "en", "x"), (103, TEXT["en"], "??", "x"), (103, TEXT["en"], "??", "x")]
    df = make(docs, "doc_id long, text string, label string, lang string")
    known = l.label_map(make([(k.upper(), k) for k in TEXT] + [("??", None), ("EN2", "en")], "label string, lang string"))
    found = l.language_segments(df, l.train(df, known, "doc_id", "text", "label"))
    rows = found.collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, set()).add(r.lang)
    assert all(by[i] == {k} for i, k in enumerate(sorted(TEXT) * 4)) and by[102] == {"de"} and by[103] == {"en"} and not {100, 101} & set(by)
    assert sum(r.id == 103 for r in rows) == 2
    assert l.language_segments(df.limit(0), {}).count() == 0
    assert l.train(df.limit(0), known, "doc_id", "text", "label") == {}
    with pytest.raises(ValueError):
        l.label_map(spark.range(20_000).selectExpr("cast(id as string) label", "'en' lang"))
