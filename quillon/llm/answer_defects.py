"""Defective question-answer pairs by a multi-label linear classifier.

Features are hashed character n-grams of the answer (its question, figures and quotations taken out) and
facts about the pair: how much of the answer is the question, how the last line ends, which brackets and
fences stay open, which scripts it is written in, its confidence level and number of sources.  The
classifier is trained here on a bounded sample of the pairs themselves: from answers that look whole, copies, cuts,
refusals, answers in other languages and answers swapped between questions are made; thresholds are
calibrated on held-out ones.  The scores alone decide.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.sampling import hash_sample

#: The defects, in the order in which they outrank each other.
DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
#: The classifier's labels: the defects, and an answer that belongs to another question.
LABELS = (*DEFECTS, "swapped")
#: Bound of the training sample in rows, size of the feature space, epochs and share held out for calibration.
SAMPLE_ROWS, SPACE, EPOCHS, HELD_OUT = 2_000, 1 << 16, 5, 0.25
#: Logit of a refusal or another language from which the first classifier keeps an answer out of the whole ones.
DOUBT = -1.5
#: Answers judged at once.
AT_ONCE = 500

#: What stands for a missing answer.
PLACEHOLDERS = {"tbd", "na", "none", "null", "nan", "nil", "待補", "無", "空白", "不詳", "待定", "暫無", "略", "answernotavailable", "notavailable", "unknown", "noanswer", "todo"}
#: Words that introduce a question or an answer without being one.
INTRODUCTIONS = ("您的問題是", "你的問題是", "您問的是", "您想問的是", "問題是", "問題", "回答", "答案", "提問", "關於", "question", "answer", "yourquestionis", "youasked")
#: Sentences that decline, for the synthetic refusals ({} takes a topic).
REFUSALS = (
    "抱歉，我無法根據提供的內容回答這個問題。", "很遺憾，文件沒有{}的相關資訊，因此不能給出答案。", "資料中並未提及{}，恕難回覆。", "這部分內容我幫不上忙，謝謝您的提問。", "此問題超出我能協助的範圍，請改詢問相關人員。",
    "檢索結果與問題無關，無法作答。", "若您能補充檔案，我會再試一次。", "目前的上下文不足以回答{}的問題，建議查閱原始報告。", "查無{}資料，故無從作答。", "我不便對{}提供意見。", "作為語言模型，我沒有能力判斷{}。",
    "對不起，我不知道{}。", "未找到與{}相關的內容。", "现有资料不足，无法回答该问题。", "抱歉，我无法回答这个问题。", "I'm sorry, but I cannot answer this from the given context.", "The documents provided do not contain information about {}.",
    "No relevant information was found, so no answer can be given.", "As an assistant I am unable to comment on {}.", "I don't know the answer to this question.", "Unfortunately, the context does not mention {}.", "申し訳ありませんが、その質問にはお答えできません。",
    "関連する情報が見つかりませんでした。", "죄송하지만 그 질문에는 답변드릴 수 없습니다.", "관련 정보를 찾을 수 없습니다.", "Leider kann ich diese Frage nicht beantworten.", "Die Dokumente enthalten keine Angaben zu {}.",
    "Désolé, je ne peux pas répondre à cette question.", "Aucune information pertinente n'a été trouvée.", "Lo siento, no puedo responder a esta pregunta.", "No se encontró información relevante sobre {}.",
)
#: Phrases before a refusal, and remarks before an answer that is given all the same.
POLITE = ("", "", "", "您好，", "感謝您的提問。", "經檢視所有來源後，", "謝謝。")
REMARKS = ("文件未揭露{}的明細，但", "雖然資料中並未提及{}，", "{}表示無法於期限內完成擴產，對此致歉；", "報告沒有說明{}，不過", "公司無法預測{}，但")
#: Plain sentences in other languages, beside the sample's own.
FOREIGN = (
    "The operating margin rose by 3.2 points in the second quarter, mainly because of lower freight costs.", "Orders from Asia represented a third of the total, and management expects a recovery.",
    "Inventory turnover improved from 80 days to 65 days after the audit.", "The board moved 5,120 dollars to the reserve of the legal office.", "Headcount increased to 271 during 2018.", "Compared with last year, the dividend was set at 2.4 dollars per share.",
    "The company closed an older plant in Africa and finished tests of a new line.", "According to the sales team, banks extended the credit line to 48,120 dollars, which auditors will continue to monitor.", "Because of currency movements, shipments fell by 12.5%.", "Suppliers were audited and 14 findings were reported.",
    "営業利益は前年同期と比べて増えましたが、為替の影響によるものです。", "工場の稼働率は高い水準で推移しています。", "영업이익은 전년 동기와 비교하여 늘었으며 환율의 영향입니다.", "감사 결과 연구 개발 부문의 인원이 늘었습니다.", "생산 부문은 두 번째 라인의 검수를 마쳤으며 계속 점검할 예정입니다.", "일회성 항목을 제외하면 주문이 전체의 12.5%를 차지했습니다.", "공장 가동률은 높은 수준을 유지하고 있습니다.",
    "Der Umsatz stieg gegenüber dem Vorjahr um 4,5 %, vor allem wegen niedrigerer Kosten.", "Das Werk in Asien erreichte eine höhere Ausbeute.", "Le chiffre d'affaires a augmenté par rapport à l'année précédente grâce à la demande.",
    "L'usine a atteint un meilleur rendement au cours du trimestre.", "Los ingresos aumentaron frente al año anterior por la demanda estacional.", "La planta alcanzó un mejor rendimiento durante el trimestre.",
    "营业收入较前一年增加，主要受汇率变动影响。", "与去年同期相比，该公司的存货周转天数缩短。", "管理层预期毛利率将于下一季回升。",
)

#: Whole pairs to learn from where the sample has next to none.
STOCK = (
    ("公司2019年第一季的營業收入是多少？", "公司2019年第一季的營業收入為12,345元，較前一年增加3.1%。"), ("毛利率為什麼下滑？", "毛利率下滑2.4個百分點，主因是庫存調整，以及海外需求轉弱。"), ("哪個地區成長最多？", "西歐"), ("費用占多少？", "約 12.5%"),
    ("請列出各項金額", "各項金額如下：\n1. 營業收入：12,345 元\n2. 研發支出：2,345 元"), ("存貨餘額是多少？", "存貨餘額為9,876元（9千），管理階層將持續追蹤。"),
)
STOCK_BELOW, STOCK_TIMES = 30, 20

_QUOTE = regex.compile(r"\"[^\"\n]*\"|“[^“”]*”|「[^「」]*」|『[^『』]*』|《[^《》]*》")
_NAME = regex.compile(r"\p{Lu}\p{Ll}+(?:\s\p{Lu}\p{Ll}+)+|\p{Lu}{2,}")
_BARE = regex.compile(r"[^\p{L}\p{N}]+")
_FIGURE = regex.compile(r"\d+(?:[.,，]\d+)*")
_STOP = regex.compile(r"[。！？!?.…;；]")
_VALUE = regex.compile(r"(?:約|about|NT|US|HK)?\s*[$＄¥€£]?\s*[-−(（]?\d[\d,，.]*\s*[)）]?\s*(?:[%％‰]|元|美元|萬元|億元|人|天|項|倍|件|年|座|個百分點)?(?:（[^（）]*）)?$")
_FACT = regex.compile(r"\d\s*(?:[%％‰|]|元|美元|萬|億|人|天|項|倍|件|個百分點|\n|$)|\|")
_LIST = regex.compile(r"\s*(?:\d+[.)、．]|[-*•‧・])\s*")
_PAIRS = {"（": "）", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "《": "》", "【": "】", "“": "”"}
_HAS_STOP = regex.compile(r"[。！？!?][」』）)\"”]*\s*\S")


def _table() -> np.ndarray:
    """Per BMP character: 1 traditional only, 2 simplified only (by two legacy character sets), 3 kana, 4 hangul, 5 Latin, 6 other ideograph."""
    out = np.zeros(0x10000, np.int8)

    def in_(c: str, codec: str) -> bool:
        try:
            c.encode(codec)
        except UnicodeEncodeError:
            return False
        return True

    for k in range(0x4E00, 0xA000):
        c = chr(k)
        big, gb = in_(c, "big5"), in_(c, "gb2312")
        out[k] = 1 if big and not gb else 2 if gb and not big else 6
    out[0x3041:0x3100], out[0xAC00:0xD7A4] = 3, 4
    for k in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]:
        out[k] = 5
    return out


_SCRIPT = _table()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the number of the text each belongs to."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint32), np.repeat(np.arange(len(texts)), [len(r) // 4 for r in raw])


def scripts(texts: list[str]) -> np.ndarray:
    """Characters of each kind in each text: (texts, kinds)."""
    codes, owner = _codes(texts)
    kind = _SCRIPT[np.minimum(codes, 0xFFFF)]
    return np.bincount(owner * 7 + kind, minlength=7 * len(texts)).reshape(-1, 7)


def bare(text: str) -> str:
    return _BARE.sub("", text).lower()


def foreign(text: str) -> bool:
    """Whether a text, its names and quotations taken out, is mainly written in other scripts than traditional Chinese."""
    return mainly_foreign(scripts([_NAME.sub(" ", _QUOTE.sub(" ", text))])[0])


def mainly_foreign(s) -> bool:
    return bool(s[3] >= 2 or s[4] >= 2 or s[2] > s[1] or (s[5] >= 12 and s[5] * 2 > sum(s[1:])))


def remainder(answer: str, question: str) -> tuple[int, str]:
    """How often the answer holds the question, and the letters and digits it has besides (introductions aside); both bare."""
    n = answer.count(question) if question else 0
    if n:
        answer = answer.replace(question, " ")
        for word in INTRODUCTIONS:
            answer = answer.replace(word, "")
        answer = answer.replace(" ", "")
    return n, answer


def given_back(answer: str, question: str) -> bool:
    """Whether an answer ends with its question, with at most a few words and no figure before it; both bare."""
    lead, held, after = answer.rpartition(question) if question else (answer, "", "")
    lead = lead.replace(question, "") if held else lead
    return bool(held) and not after and len(lead) <= 20 and not any(map(str.isdigit, lead))


def ending(answer: str) -> list[str]:
    """Facts about how an answer ends."""
    text = answer.rstrip()
    out = []
    if not text:
        return ["end:none"]
    last = text.rsplit("\n", 1)[-1].strip()
    final = text[-1]
    closed = text.rstrip("」』）)\"”》】]} ")
    stopped = bool(closed) and closed[-1] in "。！？!?.｡"
    unclosed = [o for o, c in _PAIRS.items() if text.count(o) > text.count(c)]
    if unclosed:
        out.append("open:bracket")
    if text.count("```") % 2:
        out.append("open:fence")
    if text.count('"') % 2:
        out.append("open:quote")
    kind = "stop" if stopped else "comma" if final in ",，、;；" else "colon" if final in ":：" else "ellipsis" if final == "…" else "pipe" if final == "|" else "digit" if final.isdigit() else "bracket" if final in "」』）)\"”》】]}" else "letter" if final.isalpha() else "sign"
    out.append(f"end:{kind}")
    if last.startswith("|"):
        out.append("table:whole" if last.endswith("|") and len(last) > 1 else "table:cut")
        return out
    item = _LIST.match(last) if "\n" in text or regex.match(r"\s*\d+[.)、]\s", last) else None
    body = last[item.end() :] if item else last
    if item:
        head, colon, value = body.partition("：")
        whole = stopped or (bool(value.strip()) if colon else bool(body)) and kind in ("digit", "letter", "bracket", "sign") and (not colon or bool(_VALUE.match(value.strip())) or bool(regex.search(r"\p{L}", value)))
        out.append("item:whole" if whole and kind not in ("comma", "colon") else "item:cut")
        return out
    if not stopped and kind != "pipe":
        if _VALUE.match(body):
            out.append("line:value")
        elif _HAS_STOP.search(last) or "\n" in text:
            out.append("line:tail")
        elif len(bare(body)) <= 12 and kind not in ("comma", "colon", "ellipsis"):
            out.append("line:short")
        else:
            out.append("line:unstopped")
        if regex.search(r"(?:[的將以及和與或於在由]|以及|因為|\d[,，])$", body):
            out.append("line:hanging")
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashed n-grams of all texts, each once a text, and the number of the text each belongs to."""
    codes, owner = _codes(texts)
    codes = codes.astype(np.uint64)
    parts = []
    for n in (1, 2, 3):
        size = max(0, len(codes) - n + 1)
        h = np.full(size, n * 7919, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : size + i]) * np.uint64(0x100000001B3)
        own = owner[:size] == owner[n - 1 : size + n - 1]
        parts.append((owner[:size][own] << 32) | ((h ^ (h >> np.uint64(29))) % np.uint64(SPACE - 4096)).astype(np.int64)[own])
    packed = np.sort(np.concatenate(parts))
    if len(packed):
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    return (packed & 0xFFFFFFFF) + 4096, packed >> 32


_FLAGS: dict[str, int] = {}


def _flag(name: str) -> int:
    """A place below 4096 by a fixed polynomial of the name's characters."""
    if name not in _FLAGS:
        h = 7
        for c in name:
            h = (h * 31 + ord(c)) % 1_000_003
        _FLAGS[name] = h % 4096
    return _FLAGS[name]


def without_question(answer: str, question: str) -> str:
    """The answer with Q for its question, however spaced, spelled in capitals or punctuated."""
    at = [i for i, c in enumerate(answer) if not _BARE.match(c)]
    low, q = "".join([answer[i].lower()[:1] for i in at]), bare(question)
    parts, last, hit = [], 0, low.find(q) if q else -1
    while hit >= 0:
        parts += [answer[last : at[hit]], "Q"]
        last = at[hit + len(q) - 1] + 1
        hit = low.find(q, hit + len(q))
    return "".join(parts) + answer[last:]


def shared(question: str, answer: str) -> int:
    """Quarters of the question's pairs of characters that the answer has; both bare."""
    pairs = {question[i : i + 2] for i in range(len(question) - 1)}
    return 4 * sum([x in answer for x in pairs]) // len(pairs) if pairs else 0


#: Flags that apply a hand-written rule; training without them shows what the rest is worth.
RULES = ("placeholder", "copied", "given back", "foreign", "cut")


def features(pairs: list[tuple], rules: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values of the features of ``(question, answer, level, sources)``; null text counts as empty.

    Without ``rules`` the flags of hand-written rules are left out.
    """
    said = [_QUOTE.sub(" ", p[1] or "") for p in pairs]
    counts = scripts([_NAME.sub(" ", t) for t in said])
    texts, places = [], []
    for i, (q, a, level, sources) in enumerate(pairs):
        q, a = q or "", a or ""
        asked, letters = bare(q), bare(a)
        times, rest = remainder(letters, asked)
        flags = [f"times:{min(times, 2)}", f"rest:{min(len(rest), 12) if times else 'x'}", f"letters:{min(len(letters), 3)}"]
        if letters in PLACEHOLDERS or not letters:
            flags.append("placeholder:")
        if times and not rest:
            flags.append("copied:")
        if times:
            flags.append(f"given back:{given_back(letters, asked)}")
        ends = ending(a)
        flags += ends
        flags.append(f"cut:{min(len(CUTS.intersection(ends)), 2)}")
        s = counts[i].tolist()
        total = max(1, sum(s[1:]))
        flags += [f"kana:{s[3] >= 2}", f"hangul:{s[4] >= 2}", f"simplified:{s[2] > s[1]}:{s[2] >= 2}", f"latin:{4 * s[5] // total}", f"latin long:{s[5] >= 20}:{2 * s[5] // total}", f"traditional:{min(s[1], 2)}"]
        flags.append(f"foreign:{mainly_foreign(s)}")
        flags += [f"level:{(level or 'none').strip().lower()}", f"sources:{min(sources or 0, 2)}"]
        figures = set(_FIGURE.findall(q))
        flags += [f"shared:{shared(asked, letters)}", f"shared figures:{figures <= set(_FIGURE.findall(a)) if figures else 'none'}:{len(letters) > 12}"]
        texts.append(_FIGURE.sub("0", _NAME.sub("N", without_question(said[i], q) if times else said[i])))
        flags.append(f"figures:{min(texts[-1].count('0'), 2)}")
        places.append([_flag(f) for f in flags if rules or f.partition(":")[0] not in RULES])
    grams, owner = _grams(texts)
    cut = np.searchsorted(owner, np.arange(len(pairs) + 1))
    out = []
    for i, at in enumerate(places):
        own = grams[cut[i] : cut[i + 1]]
        out.append((np.concatenate((np.array(at, np.int64), own)), np.concatenate((np.ones(len(at), np.float32), np.full(len(own), 2.0 / np.sqrt(max(len(own), 1)), np.float32)))))
    return out


#: What an ending must show for its answer to be cut.
CUTS = {"open:bracket", "open:fence", "open:quote", "end:comma", "end:colon", "end:ellipsis", "table:cut", "item:cut", "line:tail", "line:unstopped", "line:hanging"}


class Classifier:
    """One linear model per label with its calibrated threshold (in logits)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, rules: bool = True):
        self.weights, self.thresholds, self.rules = weights, thresholds, rules

    def margins(self, pairs: list[tuple]) -> np.ndarray:
        """Scores over the thresholds: (pairs, labels)."""
        if not pairs:
            return np.empty((0, len(self.thresholds)), np.float32)
        xs = features(pairs, self.rules)
        starts = np.concatenate(([0], np.cumsum([len(at) for at, _ in xs])[:-1]))
        scores = np.add.reduceat(self.weights[:, np.concatenate([at for at, _ in xs])] * np.concatenate([v for _, v in xs]), starts, axis=1)
        return scores.T - self.thresholds

    def defects(self, pairs: list[tuple]) -> list[tuple[str | None, float, float]]:
        """Per pair the defect that outranks the others of those over their thresholds, with its margin (none: the largest), and the
        margin of a swapped answer.  The scores alone decide."""
        out = []
        for margin in self.margins(pairs):
            over = np.flatnonzero(margin[: len(DEFECTS)] > 0)
            out.append((DEFECTS[over[0]] if len(over) else None, float(margin[over[0]] if len(over) else margin[: len(DEFECTS)].max()), float(margin[len(DEFECTS)])))
        return out

    def defect(self, question: str | None, answer: str | None, level: str | None, sources: int | None) -> tuple[str | None, float]:
        return self.defects([(question, answer, level, sources)])[0][:2]


def _cut(answer: str, rng: random.Random) -> str | None:
    """An answer broken off inside a sentence, number, bracket, row, list item or fence."""
    kind = rng.random()
    if kind < 0.15:
        return answer + f'```json\n{{"{answer[:4]}": {rng.randrange(10**6)}, "'
    if kind < 0.3:
        return answer + rng.choice(("此外，相關部門的", "主要是因為需求轉弱，以及", "其中營業收入為12,345,", "整體來看，毛利率將……", "整體來看，毛利率將…", "就日本而言，", "資產總額為3,456,789元（345", "資產總額為3,456,789元（34萬"))
    if kind < 0.5:
        head = answer if "\n" not in answer else answer.split("\n")[0]
        return head + rng.choice(("\n1. 營業收入：12,345 元\n2. 毛利率：", "\n1. 營業收入：5,123 元\n2. 毛利率：98 元\n3. 費用：", "\n\n| 項目 | 金額 |\n|---|---|\n| 營業收入 | 12,345 |\n| 毛利率", "\n\n| 項目 | 金額 |\n|---|---|\n| 營業收入"))
    at = [m.start() for m in regex.finditer(r"[，、：]", answer)]
    if at and kind < 0.8:
        return answer[: rng.choice(at) + 1]
    n = rng.randrange(len(answer) // 3, len(answer) - 1) if len(answer) > 12 else 0
    made = answer[:n].rstrip("0123456789|.。元 \n")
    return made if len(bare(made)) > 8 else None


def _respaced(question: str, rng: random.Random) -> str:
    """A question given back as it is, in small letters, with a space more or without its last sign."""
    kind, at = rng.random(), rng.randrange(len(question) + 1)
    return question if kind < 0.4 else question.lower() if kind < 0.55 else question[:at] + " " + question[at:] if kind < 0.75 else question[:-1] if len(question) > 4 else question


def _synthetic(pairs: list[tuple], rng: random.Random) -> list[tuple[tuple, int]]:
    """Labelled pairs (label -1: whole) made from pairs that look whole."""
    out: list[tuple[tuple, int]] = []
    answers = [p[1] for p in pairs if p[1]]
    for q, a, level, n in pairs:
        out.append(((q, a, level, n), -1))
        said = [x for x in regex.findall(r"[^。\n|]{6,}。", a or "")]
        if said and rng.random() < 0.5:
            out.append(((q, rng.choice(said), level, n), -1))
        at = rng.randrange(max(1, len(q or "") - 6))
        topic = rng.choice(("這項數字", "該部門的研發支出", "2019年的數字", "毛利率", (q or "")[:12], (q or "")[at : at + rng.randrange(4, 16)], (q or "")[at : at + rng.randrange(4, 16)]))
        which = rng.random()
        if which < 0.1:
            out.append(((q, rng.choice((None, "", " ", "　", "\n", "-", "—", "***", "...", "。", "[]", "{}", "N/A", "TBD", "無", "待補", "（空白）", "None", '""', "Answer not available")), rng.choice(("low", level)), n), 0))
        elif which < 0.25:
            for _ in range(2):
                shape = rng.choice(("{}", "{}", "{}{}", "您的問題是：{}", "「{}」", "問題：{}\n回答：{}", " {} ", "請問{}", "來信詢問：{}", "客戶提出的是：{}"))
                out.append(((q, shape.replace("{}", _respaced(q or "?", rng)), level, n), 1))
        if answers and rng.random() < 0.3:
            out.append(((q, rng.choice(answers), level, n), 5))
        elif which < 0.55:
            words = rng.choice(POLITE) + rng.choice(REFUSALS).replace("{}", topic)
            out.append(((q, words + (rng.choice(REFUSALS).replace("{}", topic) if rng.random() < 0.2 else ""), rng.choice(("low", level)), rng.choice((0, n))), 2))
            out.append(((q, rng.choice(REMARKS).replace("{}", topic) + (a or ""), level, n), -1))
        elif which < 0.85:
            if a and (made := _cut(a, rng)):
                out.append(((q, made, level, n), 3))
        else:
            k = rng.randrange(1, 3)
            out.append(((q, " ".join(rng.sample(FOREIGN, k)), level, n), 4))
        if rng.random() < 0.15 and answers:
            out.append(((q, f"關於「{q}」：{a}", level, n), -1))
            out.append(((q, rng.choice(("西歐", "日本", "約 12.5%", "12,345 元", "NT$ 9,876", "12,345,678", "大洋洲", "12,345 元（1萬2345）", "研發中心")), level, n), -1))
            out.append(((q, f'原文為 "{rng.choice(FOREIGN[:2])}"，也就是說{a}', level, n), -1))
            out.append(((q, (a or "").split("\n")[0] + rng.choice(("\n1. 營業收入：12,345 元\n2. 毛利率：9,812 元", "\n\n| 項目 | 金額 |\n|---|---|\n| 營業收入 | 12,345 |\n| ROE | 1,697 |", "\n- 毛利率：12%\n- 營收：5,000 元")), level, n), -1))
    return out


def _fit(made: list[tuple[tuple, int]], rng: random.Random, rules: bool) -> Classifier:
    rng.shuffle(made)
    xs = features([p for p, _ in made], rules)
    ys = np.array([[label == k for k in range(len(LABELS))] for _, label in made], np.float32).reshape(-1, len(LABELS))
    ys[:, 4] = [label == 4 or label in (1, 2) and foreign(p[1]) for p, label in made]
    held = int(len(made) * HELD_OUT)
    w, g2 = np.zeros((len(LABELS), SPACE), np.float32), np.full((len(LABELS), SPACE), 1e-2, np.float32)
    order = list(range(held, len(made)))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            at, v = xs[i]
            p = 1 / (1 + np.exp(-np.clip(w[:, at] @ v, -30, 30)))
            grad = np.outer(p - ys[i], v)
            g2[:, at] += grad * grad
            w[:, at] -= 0.3 * grad / np.sqrt(g2[:, at])
    scores = np.array([w[:, at] @ v for at, v in xs[:held]]).reshape(held, len(LABELS))
    thresholds = np.zeros(len(LABELS), np.float32)
    for k in range(len(LABELS)):
        truth = ys[:held, k] > 0
        if not truth.any():
            continue
        rank = np.argsort(-scores[:, k])
        hits = np.cumsum(truth[rank])
        f1 = 2 * hits / (np.arange(1, held + 1) + truth.sum())
        best = int(np.flatnonzero(f1 == f1.max())[-1])
        low = scores[rank[best], k]
        high = scores[rank[best + 1], k] if best + 1 < held else low - 1
        thresholds[k] = (low + high) / 2
    return Classifier(w, thresholds, rules)


def train(sample: list[tuple], seed: int = 5, rules: bool = True) -> Classifier:
    """Classifier from ``(question, answer, level, sources)`` pairs without labels.

    The first classifier takes for whole only answers that end well and state a quantity (or are one short
    value); it then judges the others, and the second is trained on all that it finds whole.
    """
    rng = random.Random(seed)

    def plain(p: tuple) -> bool:
        times, rest = remainder(bare(p[1] or ""), bare(p[0] or ""))
        return len(bare(p[1] or "")) >= 2 and bare(p[1]) not in PLACEHOLDERS and not (times and not rest)

    def ends_well(p: tuple) -> bool:
        return not CUTS & {*ending(p[1])}

    usable = [p for p in sample if plain(p) and ends_well(p)]
    whole = [p for p in usable if not foreign(p[1])]
    sure = [p for p in whole if _FACT.search(p[1]) or len(bare(p[1])) <= 6]
    if len(sure) < STOCK_BELOW:
        stock = [(q, a, "high", 1) for q, a in STOCK] * STOCK_TIMES
        whole, sure = whole + stock, sure + stock
    other = [(p, 4) for p in usable if foreign(p[1]) and len(_FIGURE.findall(p[1])) >= 1 and len(p[1]) >= 40]
    first = _fit(_synthetic(sure, rng) + other, rng, rules)
    doubt = (first.margins(whole) + first.thresholds)[:, [2, 4]]
    kept = [p for p, d in zip(whole, doubt) if (d < DOUBT).all()]
    return _fit(_synthetic(kept, rng) + other, rng, rules) if kept else first


def flag_answers(pairs: DataFrame, classifier: Classifier) -> DataFrame:
    """``id, defect, margin, swapped`` of every row of ``pairs(id, question, answer, level, sources)``; null defect: none.

    ``swapped`` is the margin by which the answer seems to belong to another question (over 0: it does).
    Null and blank answers are empty; a null question is copied by no answer; very long answers are read
    whole; repeated rows repeat; other columns are not carried.  Nothing is shuffled.
    """
    model = pairs.sparkSession.sparkContext.broadcast((classifier.weights, classifier.thresholds, classifier.rules))  # fixed size
    schema = f"id {pairs.schema['id'].dataType.simpleString()}, defect string, margin double, swapped double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(*model.value)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = judge.defects(list(zip(*[part.column(i).to_pylist() for i in range(1, 5)])))
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64()))]], ["id", "defect", "margin", "swapped"])

    return pairs.select("id", "question", "answer", "level", "sources").mapInArrow(run, schema)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/structured_answer.parquet")
    pairs = rows.select(
        F.col("answer_id").alias("id"), "question", F.col("final_answer").alias("answer"), F.col("confidence_level").alias("level"), F.when(F.col("relevant_sources").isNotNull(), F.size("relevant_sources")).otherwise(0).alias("sources")
    )
    sample = hash_sample(pairs, ["id"], SAMPLE_ROWS).drop("id").distinct().collect()
    return flag_answers(pairs, train(sorted((tuple(r) for r in sample), key=repr)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("defect is not null").select(F.col("id").alias("answer_id"), "defect").distinct()


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by defect and confidence level (repeated rows once), and how many of them seem to belong to another question."""
    levels = spark.read.parquet(f"{sf_dir}/structured_answer.parquet").select(F.col("answer_id").alias("id"), F.lower(F.trim("confidence_level")).alias("confidence_level")).dropDuplicates(["id"])
    once = _judged(spark, sf_dir).select("id", "defect", (F.col("swapped") > 0).alias("swapped")).distinct()
    return once.join(levels, "id").groupBy("defect", "confidence_level").agg(F.count(F.lit(1)).alias("answers"), F.count_if("swapped").alias("swapped"))
