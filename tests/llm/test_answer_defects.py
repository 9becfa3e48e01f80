"""Answer defects: held-out accuracy on made cases, the plain facts, and the edges."""

import random

import pytest

from quillon.llm import answer_defects as d


def sample(seed, n):
    rng = random.Random(seed)
    firm = lambda: rng.choice("昕翊霈岑") + rng.choice("棠岫汐礫") + rng.choice(("光學", "能源", "精密"))
    item = lambda: rng.choice(("毛利率", "營業收入", "研發支出", "存貨餘額", "應付帳款"))
    num = lambda: f"{rng.randrange(1000, 10**8):,}"
    out = []
    for _ in range(n):
        q = f"{firm()}{rng.randrange(2015, 2026)}年第{rng.choice('一二三四')}季的{item()}是多少？"
        a = rng.choice((
            f"{firm()}2019年的{item()}為{num()}元（{rng.randrange(9)}萬），較前一年增加{rng.randrange(40)}.1%。", f"{item()}呈現下滑，主因是庫存調整，以及日本的需求轉弱。冷卻板的平均售價在大洋洲維持平穩。", f"{num()} 元", "西歐",
            f"影響有限：{item()}僅減少3.9%，財務處認為屬短期現象。\n1. {item()}：{num()} 元\n2. {item()}：{num()} 元", f"依第3頁的資料，{item()}為{num()}元。\n\n| 項目 | 金額 |\n|---|---|\n| {item()} | {num()} |",
        ))
        out.append((q, a, rng.choice(("high", "medium", "低", None)), rng.randrange(4)))
    return out


@pytest.fixture(scope="module")
def judge():
    return d.train(sample(1, 500))


CASES = [
    (None, "empty"), ("", "empty"), ("　\n", "empty"), ("***", "empty"), ("N/A", "empty"), ("[]", "empty"), ("（空白）", "empty"),
    ("{q}", "copy"), ("{q}{q}", "copy"), ("您的問題是：{q}", "copy"), ("「{q}」", "copy"), ("問題：{q}\n回答：{q}", "copy"),
    ("抱歉，我無法根據提供的內容回答這個問題。", "refusal"), ("您好，查無昕棠光學的毛利率資料，故無從作答。", "refusal"), ("No relevant information was found, so no answer can be given.", "refusal"), ("申し訳ありませんが、その質問にはお答えできません。", "refusal"),
    ("翊岫光學2019年的毛利率為3,000元，較前一年增加2.1%。此外，財務處的", "truncated"), ("營業收入呈現下滑。其中毛利率為1,365,", "truncated"), ("影響有限：毛利率僅減少2%。\n1. 營業收入：5,000 元\n2. 毛利率：", "truncated"), ("依第3頁的資料，毛利率為3元。\n\n| 項目 | 金額 |\n|---|---|\n| 毛利率", "truncated"),
    ("Orders from Japan represented 9.9% of the total, and shipments rose by 3.1%.", "language"), ("与去年同期相比，存货周转天数由80天缩短为9天，反映汇率变动。", "language"), ("電力変換器の歩留まりは15.1%に達しました。", "language"), ("감사 결과 출하가 9.4% 늘었습니다.", "language"),
    ("{q}", "copy"), ("關於「{q}」：毛利率為3,000元。", None), ("文件未揭露財務處的明細，但毛利率僅減少7.9%，品保單位認為屬短期現象。", None), ("約 12.5%", None), ("西歐", None), ('原文為 "Receivables stood at 6,484 dollars."，也就是說毛利率為3,000元。', None), ("Ephwyn Energy2022年的毛利率為347,445元。", None),
]


@pytest.mark.parametrize(("answer", "defect"), CASES)
def test_cases(judge, answer, defect):
    q = "翊岫光學2019年第一季的毛利率是多少？"
    assert judge.defect(q, answer and answer.replace("{q}", q), "high", 2)[0] == defect


def test_held_out(judge):
    rng = random.Random(9)
    made = d._synthetic(sample(2, 300), rng)
    right = lambda j: sum((j.defect(*p)[0] or "") == (d.DEFECTS[k] if 0 <= k < 5 else "") for p, k in made)
    assert right(judge) >= 0.97 * len(made)
    assert right(d.train(sample(1, 500), rules=False)) >= 0.95 * len(made)  # without the flags of hand-written rules


def test_swapped(judge):
    rng = random.Random(3)
    firms = [f"{x}{y}" for x in "昕翊霈岑" for y in ("棠光學", "岫能源", "汐精密", "礫生技")]
    own = [(f"{f}{y}年的存貨餘額是多少？", f"{f}{y}年的存貨餘額為{rng.randrange(10**5):,}元。", "high", 2) for f in firms for y in range(2015, 2025)]
    trained = d.train(own)
    swapped = [(q, own[(i * 7 + 50) % len(own)][1], c, n) for i, (q, _, c, n) in enumerate(own)]
    over = lambda rows: sum(x[2] > 0 for x in trained.defects(rows))
    assert over(own) <= 0.05 * len(own) and over(swapped) >= 0.8 * len(own)
    assert sum(x[0] is None for x in trained.defects(swapped)) >= 0.97 * len(own)  # not one of the five


def test_question_taken_out():
    assert d.without_question("You asked: what  IS it? 3 元", "What is it") == "You asked: Q? 3 元"
    assert d.without_question("abc", "") == "abc" and d.without_question("", "x") == "" and d.without_question("İxİx", "i̇x")


def test_batches_do_not_matter(judge):
    rows = sample(4, 60) + [(None, None, None, None), ("q", "", "low", 0)]
    one = [judge.defects([r])[0] for r in rows]
    for a, b in zip(judge.defects(rows), one):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 and abs(a[2] - b[2]) < 1e-3
    assert judge.defects([]) == []


def test_rows(spark, make, judge):
    q = "毛利率是多少？"
    rows = [(1, q, None, None, None, "x"), (2, None, "西歐", "high", 1, "x"), (2, None, "西歐", "high", 1, "x"), (None, q, q, None, 0, "x"), (4, "", "，" + "很長，" * 20000, "low", 0, "x")]
    got = d.flag_answers(make(rows, "id long, question string, answer string, level string, sources int, defect string"), judge)
    assert sorted((str(r.id), r.defect) for r in got.collect() if r.defect) == [("1", "empty"), ("4", "truncated"), ("None", "copy")]
    assert got.count() == 5 and d.flag_answers(make([], "id long, question string, answer string, level string, sources int"), judge).count() == 0


def test_empty_sample():
    assert d.train([]).defect("q", None, None, None)[0] == "empty"


@pytest.mark.parametrize("lead", ["想請教：", "想知道的是"])
def test_copy_under_words_outside_the_list(judge, lead):
    q = "翊岫光學2019年第一季的毛利率是多少？"
    assert judge.defect(q, lead + q, "high", 2)[0] == "copy"
    assert judge.defect(q, lead + q + "毛利率是12.5%，較前一年增加。", "high", 2)[0] is None
