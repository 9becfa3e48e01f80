"""Page noise: furniture, joins, held-out misreadings, repair, and the edges."""

import random

import numpy as np
import pytest

from quillon.llm import page_noise as p


TITLE = "Tordora Materials schedules 2021"


def prose(rng, n=12):
    who = lambda: rng.choice(("the cloud division", "the procurement centre", "quality assurance"))
    en = lambda: f"{rng.choice(('After the audit', 'Because of contract renegotiation', 'Excluding one-off items'))}, {who()} increased inventory to {rng.randrange(10**6):,} dollars during {rng.randrange(2015, 2026)}, a low-margin effect that should continue."
    zh = lambda: f"{rng.choice(('會計師查核後', '與去年同期相比', '就日本而言'))}，{rng.choice(('存貨餘額', '股利', '資本支出'))}為{rng.randrange(10**6):,}元，並已通知大洋洲的往來銀行，此一變化將延續到{rng.randrange(2015, 2026)}年第二季。"
    return " ".join(en() for _ in range(n)) if rng.random() < 0.5 else "".join(zh() for _ in range(n))


def wrapped(text, width=50):
    if " " in text[:60]:
        out, line = [], ""
        for w in text.split(" "):
            if len(line) + len(w) > width:
                out.append(line.rstrip())
                line = ""
            line += w + " "
        return "\n".join([*out, line.rstrip()])
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


@pytest.fixture(scope="module")
def editor():
    rng = random.Random(0)
    return p.train([(TITLE + "\n") * (i % 3 == 0) + wrapped(prose(rng)) for i in range(200)])


def test_held_out_characters(editor):
    rng = random.Random(7)
    hit = right = wrong = 0
    for _ in range(60):
        clean = p.flat(wrapped(prose(rng)))
        bad, put = p._corrupt(clean, rng)
        want = {(at, p.LOOKALIKES[k][0]) for at, k in put}
        got = {(a, s) for a, _, s in editor.edits([bad])[0]}
        hit += len(want & got)
        right += len(want)
        wrong += len({a for a, _ in got} - {a for a, _ in want})
        assert len(editor.edits([clean])[0]) <= 1
    assert hit >= 0.85 * right and wrong <= 0.05 * right


@pytest.mark.parametrize(
    ("text", "split"),
    [("the procu-\nrement centre", True), ("the procu¬\nrement", True), ("inven\xad \n tory rose", True), ("one-\noff items", False), ("a low-\nmargin effect", False), ("2019-\n2020", False), ("-\nitem", False), ("low-mar-\ngin", True)],
)
def test_line_ends(editor, text, split):
    assert bool(editor.split_words(text)) is split


@pytest.mark.parametrize(
    ("line", "page", "ok"),
    [("- 3 -", 3, True), ("~ 12 ~", 12, True), ("iv", 4, True), ("IV", 4, True), ("Page 2 of 9", 2, True), ("第 9 頁，共 18 頁", 9, True), ("P. 007", 7, True), ("9/10", 9, True), ("- l2 -", 12, True), ("[5]", 5, True), ("頁 8", 8, True),
     ("- 3 -", 4, False), ("1. 流動性 / 財務處", 1, False), ("1,081,048", 1, False), ("南美 2019", 2019, False), ("i", 2, False), ("10/9", 9, False)],
)
def test_page_numbers(line, page, ok):
    assert p.page_line(line, page) is ok


def test_encoded_text_is_left_alone(editor):
    junk = "uSGzTlmBxGespRLBMWtRcD8bLp4md8ZTcIHaY2UjGUvhiqaB6Q"
    assert editor.edits([p.flat(f"After the audit\n{junk}\n0123456789abcdef0123456789abcdef rose")])[0] == []


def report(rng, doc, pages, title):
    out = []
    for n in range(1, pages + 1):
        body = wrapped(prose(rng))
        top = title if n % 3 else title.replace("a", "@", 1)
        out.append((doc, n, f"{top}\n{body}\n- {n} -"))
    return out


def test_noise_and_repair(spark, make, editor):
    rng = random.Random(4)
    rows = report(rng, "r1", 8, TITLE) + [("r2", n, wrapped(prose(rng))) for n in range(1, 6)]
    rows += [("r3", 1, None), ("r3", 2, " \n"), (None, 1, "x"), ("r3", None, "y"), rows[0], ("r4", 1, f"   Same title   1\n{wrapped(prose(rng))}"), ("r4", 2, f"Same title   2\n{wrapped(prose(rng))}"), ("r4", 3, f"3   SAME TITLE\n{wrapped(prose(rng))}")]
    df = make([(*r, "clash") for r in rows], "doc_id string, page int, text string, noise string")
    got = {(r.doc_id, r.page, r.noise) for r in p.noise(p.read_pages(df, editor)).collect()}
    for n in range(1, 9):
        assert ("r1", n, "header") in got and ("r1", n, "page_no") in got
        assert (("r1", n, "char") in got) == (n % 3 == 0)
    assert {("r4", n, k) for n in (1, 2, 3) for k in ("header", "page_no")} <= got
    assert not any(g[0] in ("r2", "r3") for g in got)
    assert p.noise(p.read_pages(df.limit(0), editor)).count() == 0


def test_title_of_a_short_chapter_in_a_long_report(spark, make, editor):
    rng = random.Random(5)
    chapter = {40: "Zinc smelter closures", 41: "Zinc smelter closures", 42: "Zinc sme1ter closures"}
    alone = {7: "Quarry permits by county", 8: "Quarry permits of Latvia"}
    rows = [("long", n, f"{(chapter | alone)[n]}    {n}\n{wrapped(prose(rng))}" if n in chapter or n in alone else wrapped(prose(rng))) for n in range(1, 201)]
    read = p.read_pages(make(rows, "doc_id string, page int, text string"), editor)
    got = {(r.page, r.noise) for r in p.noise(read).collect()}
    assert {(n, k) for n in chapter for k in ("header", "page_no")} <= got
    assert {n for n, k in got if k == "header"} == set(chapter)
    assert {r.page for r in p._titles(read).collect()} == set(chapter)


def mend(text, editor):
    return p.mended(text, editor.split_words(text), editor.edits([p.flat(text)])[0])


def test_mended(editor):
    text = "After the audit, the procu-\nrement centre increased inven¬\ntory to 2O,000 dollars during 2019."
    assert p.paragraphs(mend(text, editor)) == "After the audit, the procurement centre increased inventory to 20,000 dollars during 2019."
    assert p.paragraphs("會計師查核後，存貨\n餘額為3元。\n\n- 一\n- 二") == "會計師查核後，存貨餘額為3元。\n\n- 一\n- 二"
    junk = "uSGzTlmBxGespRLBMWtRcD8bLp4md8ZTcIHaY2UjGUvhiqaB6Q"
    rest = "After the audit, the centre increased inventory to {},000 dollars during 2019."
    assert mend(f"{junk}\n{rest.format('2O')}", editor) == f"{junk}\n{rest.format('20')}"


def distance(a, b):
    row = np.arange(len(b) + 1)
    col, codes = np.arange(len(b) + 1), np.array([*map(ord, b)])
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x)))
        row = np.minimum.accumulate(np.concatenate(([i], best)) - col) + col
    return int(row[-1])


def test_character_error_of_held_out_pages(editor):
    rng = random.Random(12)
    before = after = chars = 0
    for n in range(1, 31):
        lines = wrapped(prose(rng, 6)).split("\n")
        clean = p.paragraphs("\n".join(lines))
        bad = []
        for line in lines:  # some words split at their line's end
            head, _, word = line.rpartition(" ")
            bad.append(f"{line[:-3]}-\n{line[-3:]}" if word.isalpha() and len(word) > 6 and rng.random() < 0.3 else line)
        noisy = p._corrupt("\n".join(bad), rng)[0]
        noisy = f"{TITLE}   {n}\n{noisy}\n- {n} -"
        fixed = p.cleaned(mend(noisy, editor), n, {p.title_line(f"{TITLE}   {n}", n)[0]})
        before, after, chars = before + distance(p.paragraphs(noisy), clean), after + distance(fixed, clean), chars + len(clean)
    assert after < 0.2 * before, (before / chars, after / chars)


def test_every_row_is_repaired(spark, make, editor):
    rng = random.Random(6)
    rows = report(rng, "r", 5, TITLE) + [("r", None, "no number"), ("r", None, "other text"), (None, 1, "no report"), (None, None, None), ("e", 1, None), ("e", 2, " ")]
    got = p.repaired(p.read_pages(make(rows + rows[:2], "doc_id string, page int, text string"), editor, repair=True)).collect()
    assert len(got) == len(rows)
    assert not any("Tordora" in r.text or "\n- " in r.text for r in got if r.doc_id == "r" and r.page)
    assert {r.text for r in got if r.page is None} == {"no number", "other text", ""}


def test_titles_and_numbers_of_any_length(spark, make, editor):
    rng = random.Random(8)
    long = "Consolidated schedules of the group and of all its subsidiaries abroad for the year that ended in the month of December and comparative figures"
    pages = lambda doc, first, line: [(doc, n, f"{line.format(n)}\n{wrapped(prose(rng))}") for n in range(first, first + 4)]
    rows = pages("long", 1, long) + pages("deep", 1, "\n" * 20 + "Deep title of the report") + pages("far", 100_001, "Annual figures   {}") + pages("alone", 1_000_001, "{}") + pages("tiny", 1, "Small: title of 2019")
    rows += [("bare", n, f"Note: quarter\n{n} sites in 2019, all open") for n in range(1, 5)]
    got = {(r.doc_id, r.page, r.noise) for r in p.noise(p.read_pages(make(rows, "doc_id string, page int, text string"), editor)).collect()}
    assert {d for d, _, k in got if k == "header"} >= {"long", "deep", "far", "tiny"}
    assert {(d, n) for d, n, k in got if k == "page_no"} == {(d, n) for d, first in (("far", 100_001), ("alone", 1_000_001)) for n in range(first, first + 4)}
    assert p.page_line("9" * 5000, 9) is False and p.page_line("²", 2) is False and p.page_line("１２", 12) is True
    word = "Quelch" * 15
    seen = []
    ask = p.Editor(editor.weights, editor.words, editor.compounds)
    ask.joins = lambda left, sign, right: not seen.append(left)
    assert ask.split_words(f"x {word}-\nrement")[0][0] == 2 + len(word) and seen == [word]


def test_misreadings_are_learned(editor):
    rng = random.Random(3)
    words = ["inventory", "procurement", "continuous", "turbine", "quarterly", "furnace", "minutes", "columns"]
    text = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + [" ".join(w.replace("u", "v", 1) for w in words)] + [" ".join(w.replace("n", "nn", 1) for w in words)]
    assert p.confusions(text) == (("u", "v"),) and p.confusions([]) == ()
    trained = p.train(text)
    assert trained.table[-1] == ("u", "v") and editor.table == p.LOOKALIKES
    zh = ["存貨餘額與產能利用率都會回升。" * 30, "存貨餗額。產能利用卒都會。"] + ["存貨餗額", "貨餗額與"] * 2
    assert p.confusions(zh) == () or {read for _, read in p.confusions(zh)} <= {"餗", "卒"}


def test_no_sample():
    assert p.train([]).edits(["x 0 1"]) == [[]]


def shown(rng, n=40):
    words = ["inventory", "procurement", "continuous", "turbine", "quarterly", "furnace", "minutes", "columns"]
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(n)], " ".join(w.replace("u", "v", 1) for w in words)


def test_the_end_of_long_pages_counts(spark, make, tmp_path):
    rng = random.Random(3)
    text, odd = shown(rng)
    rows = [("r", n, "the board has held\n" * 230 + t) for n, t in enumerate([*text, odd], 1)]  # what shows the misreading stands beyond 4,000 characters
    make(rows, "doc_id string, page int, text string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page for r in p.p2_found(spark, str(tmp_path)).collect() if r.noise == "char"} == {len(rows)}


def test_misreadings_of_all_pages(spark, make):
    counted = lambda pages: p.all_confusions(p.count_words(make([(t,) for t in pages], "text string").repartition(5)))
    text, odd = shown(random.Random(3))
    assert counted([*text, odd]) == p.confusions([*text, odd]) == (("u", "v"),)
    assert counted([*text * 30, *[odd] * 30]) == (("u", "v"),)  # in a large table misreadings recur
    stems = ["increase", "reduce", "measure", "require", "schedule", "balance", "finance", "declare"]
    assert counted([" ".join(f"{w}d" for w in stems)] * 900 + [" ".join(f"{w}s" for w in stems[:4])] * 60) == ()  # endings
    assert counted([]) == ()
    assert counted(["存貨餘額與產能利用率都會回升。" * 60, "存貨餗額。"] + ["存貨餗額"] * 3) == (("餘", "餗"),)


def test_shares_train_alike_in_any_order(spark, make, monkeypatch):
    monkeypatch.setattr(p, "SHARE_CHARS", 20_000)
    rng = random.Random(5)
    pages = make([("r", n, wrapped(prose(rng))) for n in range(90)] + [("r", None, None), ("s", 1, "")], "doc_id string, page int, text string")
    one, other = p.fit_all(pages.repartition(1), p.LOOKALIKES), p.fit_all(pages.repartition(7), p.LOOKALIKES)
    assert np.array_equal(one, other) and one.any()
    clean = p.flat(wrapped(prose(rng)))
    bad, put = p._corrupt(clean, rng)
    assert len(p.Editor(one, None, None).edits([bad])[0]) >= 0.8 * len(put)
    assert not p.fit_all(pages.where("text = ''"), p.LOOKALIKES).any()


def test_ends_are_settled_by_a_table(spark, make, editor):
    rows = [("r", 1, "the procu-\nrement centre"), ("r", 2, "one-\noff items"), ("r", 3, "a plain page"), (None, None, "the procu-\nrement centre of a low-\nmargin 2O19"), ("r", None, None)]
    pages = make(rows, "doc_id string, page int, text string")
    counts = p.count_words(make([("the procurement of one-off low-margin items",)], "text string"))
    open_ = p.Editor(editor.weights, None, None, editor.table)
    local = p.Editor(editor.weights, {"the", "procurement", "of", "items", "one-off", "low-margin"}, {"one-off", "low-margin"}, editor.table)
    key = lambda df: sorted(map(str, df.collect()))
    for repair in (False, True):
        got = p.settled(p.read_pages(pages, open_, repair), open_, counts)
        want = p.read_pages(pages, local, repair)
        assert got.columns == want.columns and key(got) == key(want)
    assert {r.page for r in got.collect() if r.hyphen} == {1, None}


def test_a_context_is_hashed_once(editor, monkeypatch):
    rows, plain = [], p._context
    monkeypatch.setattr(p, "_context", lambda c, at, *rest: rows.append(len(at)) or plain(c, at, *rest))
    page = p.flat(wrapped(prose(random.Random(1))))
    one = editor.edits([page])
    once, rows[:] = sum(rows), []
    assert editor.edits([page] * 40) == one * 40
    assert once and sum(rows) == once


def test_contexts_that_share_a_mix(editor, monkeypatch):
    pages = [p.flat(wrapped(prose(random.Random(k)))) for k in range(5)]
    noisy = [p._corrupt(t, random.Random(2))[0] for t in pages]
    want, unique = editor.edits(noisy), np.unique
    monkeypatch.setattr(np, "unique", lambda mix, **k: unique(mix % np.uint64(50), **k))
    assert any(want) and editor.edits(noisy) == want


def test_line_ends_are_learned_as_one_by_one():
    rng = np.random.default_rng(2)
    x, y = p.SPACE + rng.integers(0, 40, (300, 9)), rng.choice([-1, 1], 300).astype(np.float32)  # some features twice in a row
    orders = [rng.permutation(300) for _ in range(3)]
    w, total = np.zeros(p.SPACE + 40), np.zeros(p.SPACE + 40)
    for i in np.concatenate(orders):
        if y[i] * (own := w[x[i]]).sum() <= 1:
            w[x[i]] = own = own + y[i]
        total[x[i]] += own
    ids, sums = p._fit_ends(x, y, orders)
    assert ids.tolist() == np.unique(x).tolist() and np.array_equal(sums, total[ids])


def test_fast_patterns_match_the_same():
    every = "".join(map(chr, range(0x110000)))
    for text in (every, every[:0x10000]):
        assert p.tokens(text) == p._TOKEN.findall(text) and p.words_of(text) == p._WORD.findall(text)
    assert p._found(p._NEAR_SIGNS, p._SIGNS, every[:0x10000]) == p._SIGNS.findall(every[:0x10000])
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("ab年-¬ \t\n\n　\x1c\x85†éA1") for _ in range(rng.randrange(20)))
        assert p.flat(text) == p._LINE.sub("", p._WRAP.sub(" ", p._BREAK.sub("", text))) and len(p._placed(text)) == len(p.flat(text))
        text = "".join(rng.choice("aZ9+/=-年") for _ in range(rng.randrange(200)))
        assert p._has_run(text) == bool(p._RUN.search(text))
        assert p._encoded(text) == (len(text) >= 16 and sum(a.isdigit() != b.isdigit() for a, b in zip(text, text[1:])) >= 4 or len(text) >= 20 and sum(a.isupper() != b.isupper() for a, b in zip(text, text[1:])) >= 6)


def test_a_text_is_read_once_for_its_size(spark, make, monkeypatch):
    monkeypatch.setattr(p, "SHARE_CHARS", 20_000)
    rng = random.Random(5)
    pages = make([("r", n, wrapped(prose(rng))) for n in range(60)] + [("r", None, None), ("s", 1, ""), ("t", 1, "\U00020000 the procu-\nrement " * 300)], "doc_id string, page int, text string")
    assert np.array_equal(p.fit_all(pages, p.LOOKALIKES, p.count_words(pages)), p.fit_all(pages, p.LOOKALIKES))
