"""Language of documents and of their segments by cross-parsing.

Each language has the suffix automaton of a bounded sample of text labelled with it.  A sentence is
parsed against it from left to right into the longest phrases that occur in that text; the language
whose text parses the sentence into the fewest phrases wins.  The sample is cleaned first, as labels may
be wrong: its halves judge each other's sentences, and those that another language claims are left out.
"""

from __future__ import annotations

import gc
import struct
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of the labelled sample: rows per language, characters of a row, characters of a language's automaton.
SAMPLE_ROWS, SAMPLE_ROW_CHARS, AUTOMATON_CHARS = 120, 4_000, 30_000
#: Most rows a table of language labels may have.
MOST_LABELS = 10_000
#: Letters from which a stretch is judged whatever its form, ideographs and syllables counting thrice.
LEAST_LETTERS = 15

_SENTENCE = regex.compile(
    r"""[^\n\r\x0b\x0c\x85  。！？!?.｡]*+(?:\.(?=[^\s"'”’)\]」』）》»])[^\n\r\x0b\x0c\x85  。！？!?.｡]*+)*+(?:[。！？!?.｡]+["'”’)\]」』）》»]*|(?=[\n\r\x0b\x0c\x85  ])|$)"""
)
_END = regex.compile(r"""[。！？!?.｡]["'”’)\]」』）》»\s]*$""")
_QUOTED = regex.compile(r"「[^「」]*」|『[^『』]*』|《[^《》]*》|“[^“”]*”|«[^«»]*»|\"[^\"\n]*\"|\[[^\[\]\n]*\]|（《[^》]*》）")
_DIGITS = regex.compile(r"\d+(?:[.,\s]\d+)*")
_SPACES = regex.compile(r"[\s\p{Cf}\p{Cc}]+")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_LATIN = regex.compile(r"[\p{Latin}\p{M}]+")
_STRAY = regex.compile(r"[^\p{L}\p{M}\p{Nd}\s,.;:!?，。、；：！？'’%％()（）－-]+")
_LETTER = regex.compile(r"\p{L}")
_WORDS = regex.compile(r"\p{L}{2,}")
#: Clauses read side by side, and the length from which one is read alone.
SIDE_BY_SIDE, SIDE_BY_SIDE_CHARS = 4_096, 4_000
#: Characters of the texts judged at once.
BATCH_CHARS = 2_000_000
#: Clauses a worker remembers before it starts afresh.
MEMO_CLAUSES = 500_000


def prepared(sentence: str) -> tuple[str, bool]:
    """What is parsed, and whether it has the letters of a sentence.

    Quoted terms, stray signs and foreign-script words of a sentence mainly in one script are left out,
    compatibility forms unified, numbers written as 0, letters lower-cased.  Under ``LEAST_LETTERS`` letters
    the form decides: see ``brief``.
    """
    t, wide = sentence, 0
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _STRAY.sub("", _QUOTED.sub(" ", t)))
        wide = (len(t.encode("utf-8", "surrogatepass")) - len(t)) // 2
        if wide * 6 >= len(t):
            t = _LATIN.sub(" ", t)
        else:
            t, wide = t if _western(t) else _WIDE.sub("", t), 0
    elif '"' in t or "[" in t or "=" in t:
        t = _STRAY.sub("", _QUOTED.sub(" ", t))
    spaced = " ".join(_DIGITS.sub("0", t).split())
    if not spaced.isprintable():
        spaced = _SPACES.sub(" ", spaced).strip()
    t = spaced.lower()
    if wide > LEAST_LETTERS or len(t) - t.count("0") - t.count(" ") - t.count("|") >= 40 or sum([len(w) for w in t.split(" ") if w.isalpha()]) >= LEAST_LETTERS:
        return t, True
    return t, len(_LETTER.findall(t)) + 2 * len(_WIDE.findall(t)) >= LEAST_LETTERS or brief(spaced)


def _western(t: str) -> bool:
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def brief(t: str) -> bool:
    """Whether a short text is a sentence by its form: stopped, and of three ideographs or syllables or of two words of which one begins small.

    Ordinals, abbreviations, codes and names ("Im 4.", "No. 5.", "Acme Corp.", "3%。") aren't.
    """
    if not _END.search(t):
        return False
    words = _WORDS.findall(t)
    return len(_WIDE.findall(t)) >= 3 or len(words) >= 2 and any(w[0].islower() for w in words)


def clauses(text: str) -> list[str]:
    """The clauses of a prepared text, without the punctuation between them."""
    for sign in "，、;；:：。":
        if sign in text:
            text = text.replace(sign, ",")
    return [c for c in text.replace(", ", ",").split(",") if c]


def automaton(text: str) -> list[dict[str, int]]:
    """Suffix automaton: per state its transitions; a path from state 0 is a substring of the text."""
    nodes, length, link = [{}], [0], [-1]
    last = 0
    for ch in text:
        cur = len(nodes)
        nodes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nodes[p]:
            nodes[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nodes[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nodes)
                nodes.append(dict(nodes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nodes[p].get(ch) == q:
                    nodes[p][ch] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nodes


def phrases(text: str, nodes: list[dict[str, int]]) -> int:
    """Number of longest-match phrases of the text; a character that the automaton doesn't know costs two."""
    n, node, root = 0, nodes[0], nodes[0]
    for ch in text:
        to = node.get(ch)
        if to is None:
            n += 1
            to = root.get(ch)
            if to is None:
                n += 1
                to = 0
        node = nodes[to]
    return n + 1


class Automata:
    """The automata of all languages as one open-addressing table of transitions, read for many clauses side by side."""

    def __init__(self, texts: dict[str, str]):
        self.texts = {k: v for k, v in sorted(texts.items()) if v}
        self.names = list(self.texts)
        alphabet = sorted({ch for v in self.texts.values() for ch in v})
        self.code = np.zeros(0x110000, np.uint16)  # 0: known to no language
        self.code[[ord(ch) for ch in alphabet]] = np.arange(1, len(alphabet) + 1)
        width = len(alphabet).bit_length()
        keys, values, self.roots, base = [], [], [], 0
        self.first = np.full((len(self.names), len(alphabet) + 1), -1, np.int32)
        place = {ch: i for i, ch in enumerate(alphabet, 1)}
        for k, text in enumerate(self.texts.values()):
            nodes = automaton(text)
            self.roots.append(base)
            for state, out in enumerate(nodes, base):
                for ch, to in out.items():
                    keys.append(state << width | place[ch])
                    values.append(base + to)
            for ch, to in nodes[0].items():
                self.first[k, place[ch]] = base + to
            base += len(nodes)
        self.bits = max(4, (3 * len(keys)).bit_length())
        kind = np.uint32 if base << width < 0xFFFFFFFF and self.bits <= 32 else np.uint64
        self.empty, self.width = kind(np.iinfo(kind).max), kind(width)  # no state has the highest number
        self.keys, self.values = np.full(1 << self.bits, self.empty, kind), np.zeros(1 << self.bits, np.int32)
        left_keys, left_values = np.array(keys, kind), np.array(values, np.int32)
        slot = self._slot(left_keys)
        while len(left_keys):
            free = np.flatnonzero(self.keys[slot] == self.empty)
            self.keys[slot[free]] = left_keys[free]  # of several the last one stays
            placed = self.keys[slot] == left_keys
            self.values[slot[placed]] = left_values[placed]
            left_keys, left_values, slot = left_keys[~placed], left_values[~placed], slot[~placed] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        kind, wide = keys.dtype.type, 8 * keys.dtype.itemsize
        return (keys * kind(0x9E3779B97F4A7C15 >> 64 - wide | 1) >> kind(wide - self.bits)).astype(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The state each transition leads to, -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != self.empty))
        while len(open_):
            at = slot[open_] + 1 & (1 << self.bits) - 1
            slot[open_] = at
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (held != self.empty)]
        return out

    def counts(self, clauses: list[str]) -> np.ndarray:
        """Phrases of each clause in each language: (clauses, languages); ``phrases`` for all at once, step by step."""
        out = np.zeros((len(clauses), len(self.names)), np.int64)
        sizes = np.array([len(c) for c in clauses], np.int64)
        order = np.argsort(-sizes, kind="stable")
        for i in order[: np.count_nonzero(sizes > SIDE_BY_SIDE_CHARS)]:
            out[i] = [phrases(clauses[i], nodes) for nodes in self.plain()]
        order = order[np.count_nonzero(sizes > SIDE_BY_SIDE_CHARS) :]
        roots = np.array(self.roots, np.int32)[:, None]
        for s in range(0, len(order), SIDE_BY_SIDE):
            own = order[s : s + SIDE_BY_SIDE]
            size = sizes[own]
            raw = np.frombuffer("".join([clauses[i] for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.zeros((int(size[0]), len(own)), np.uint16)
            row = np.repeat(np.arange(len(own)), size)
            codes[np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size), row] = self.code[raw]
            live = np.searchsorted(-size, -np.arange(size[0]), "left")  # clauses longer than each step
            state, n = np.repeat(roots, len(own), 1), np.ones((len(self.names), len(own)), np.int64)
            for step in range(int(size[0])):
                k = int(live[step])
                code = codes[step, :k]
                to = self._next((state[:, :k].astype(self.keys.dtype) << self.width | code).ravel()).reshape(-1, k)
                missed = to < 0
                again = np.where(missed, self.first[:, code], to)
                unknown = again < 0
                n[:, :k] += missed
                n[:, :k] += unknown
                state[:, :k] = np.where(unknown, roots, again)
            out[own] = n.T
        return out

    def plain(self) -> list[list[dict[str, int]]]:
        """The automata one by one, for clauses too long to be read side by side; built when the first one comes."""
        if not hasattr(self, "_plain"):
            self._plain = [automaton(v) for v in self.texts.values()]
        return self._plain


class Judge:
    """The automata of all languages; judges prepared sentences."""

    def __init__(self, automata: Automata):
        self.automata, self.names = automata, automata.names
        self.form = struct.Struct(f"<{len(self.names)}Q")
        self.memo: dict[str, int] = {}

    def read(self, texts: Iterable[str]) -> None:
        """Count the phrases of the texts' clauses in each language, as 64-bit fields of one number, so that clauses add up.

        All are counted to the end: sums over clauses and runners-up need them whole.
        """
        if len(self.memo) > MEMO_CLAUSES:
            self.memo.clear()
        new = list({c for t in texts for c in clauses(t)} - self.memo.keys())
        if new and self.names:
            packed = self.automata.counts(new).astype("<u8").tobytes()
            wide = self.form.size
            self.memo.update((c, int.from_bytes(packed[i * wide : (i + 1) * wide], "little")) for i, c in enumerate(new))

    def totals(self, text: str) -> tuple[int, ...]:
        """Phrases of a text in each language: phrases end at punctuation, so clauses are parsed once and their counts added."""
        own = clauses(text)
        if not own or not self.names:
            return ()
        try:
            total = sum([self.memo[c] for c in own])
        except KeyError:
            self.read([text])
            total = sum([self.memo[c] for c in own])
        return self.form.unpack(total.to_bytes(self.form.size, "little"))

    def language(self, text: str, stay: str | None = None) -> tuple[str | None, float]:
        """The language of fewest phrases (of equal ones ``stay``, else the first by name) and its confidence.

        The confidence is r / (1 + r) for r times as many phrases in the runner-up: 0.5 for a tie, 0.67 for twice as many.
        """
        total = self.totals(text)
        if not total:
            return None, 0.0
        best = min(total)
        at = total.index(best)
        if stay in self.names and total[self.names.index(stay)] == best:
            at = self.names.index(stay)
        rest = total[:at] + total[at + 1 :]
        return self.names[at], min(rest) / (best + min(rest)) if rest else 1.0

    def fewest(self, text: str) -> set[str]:
        """The languages that need the fewest phrases."""
        total = self.totals(text)
        return {k for k, n in zip(self.names, total) if n == min(total)}


def sentences(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """``(start, end, prepared text, complete)`` of the stretches of a text that can be judged."""
    for m in _SENTENCE.finditer(text):
        raw = m.group()
        if raw:
            ready, enough = prepared(raw)
            if enough:
                yield m.start(), m.end(), ready, bool(_END.search(raw))


def segments(texts: list[str | None], judge: Judge) -> Iterator[list[tuple[int, int, str, float, int]]]:
    """Per text ``(start, end, lang, confidence, complete sentences)`` of its runs of one language, in order.

    A run's confidence is the mean of its sentences' weighted by their lengths; stretches that are no sentences
    belong to the run before them, and so does a sentence that no other language parses into fewer phrases.
    """
    split = [list(sentences(t)) if t else [] for t in texts]
    judge.read(ready for own in split for _, _, ready, _ in own)
    for own in split:
        out: list[list] = []
        for start, end, ready, complete in own:
            lang, sure = judge.language(ready, out[-1][2] if out else None)
            if lang is None:
                continue
            n = len(ready)
            if out and out[-1][2] == lang:
                run = out[-1]
                run[1], run[3], run[4], run[5] = end, run[3] + sure * n, run[4] + complete, run[5] + n
            else:
                out.append([start, end, lang, sure * n, int(complete), n])
        yield [(a, b, lang, s / n, c) for a, b, lang, s, c, n in out]


def _pick(per: dict[str, list[str]], chars: int) -> dict[str, str]:
    out = {}
    for lang, parts in per.items():
        text, size = [], 0
        for p in parts:
            if size >= chars:
                break
            text.append(p)
            size += len(p) + 1
        out[lang] = "\n".join(text)
    return out


def cleaned(sample: list[tuple[str, str]], chars: int = AUTOMATON_CHARS) -> dict[str, str]:
    """Training text per language from ``(lang, text)`` rows, without what another language claims.

    A sentence that occurs under several labels counts for the one it occurs under most.  Then the automata
    of each half of the rows judge the other half, twice: a sentence stays if its language alone needs the
    fewest phrases.
    """
    halves: list[dict[str, list[str]]] = [defaultdict(list), defaultdict(list)]
    turn: Counter[str] = Counter()
    for lang, text in sample:
        turn[lang] += 1
        halves[turn[lang] % 2][lang] += [s for _, _, s, complete in sentences(text) if complete]
    votes: dict[str, Counter[str]] = defaultdict(Counter)
    for half in halves:
        for lang, parts in half.items():
            for s in parts:
                votes[s][lang] += 1
    for half in halves:
        for lang, parts in half.items():
            half[lang] = [s for s in parts if all(n < votes[s][lang] for k, n in votes[s].items() if k != lang)]
    for _ in range(2):
        judges = [Judge(Automata(_pick(h, chars // 2))) for h in halves]
        for i in (0, 1):
            judges[1 - i].read(s for parts in halves[i].values() for s in parts)
        kept: list[dict[str, list[str]]] = [defaultdict(list), defaultdict(list)]
        for i in (0, 1):
            other = judges[1 - i]
            for lang, parts in halves[i].items():
                size = 0
                for s in parts:
                    if size >= chars:
                        break
                    tied = other.fewest(s)
                    if lang not in other.names or tied == {lang}:
                        kept[i][lang].append(s)
                        size += len(s)
        halves = kept
    both = {k: [s for pair in zip(halves[0].get(k, []), halves[1].get(k, [])) for s in pair] + halves[0].get(k, [])[len(halves[1].get(k, [])) :] + halves[1].get(k, [])[len(halves[0].get(k, [])) :] for k in {*halves[0], *halves[1]}}
    return _pick(both, chars)


def label_map(codes: DataFrame) -> dict[str, str]:
    """Languages by label, read to the driver behind a check of their number."""
    rows = codes.where("label is not null and lang is not null").select("label", "lang").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError("lang_codes has too many rows for a table of labels")
    return {r["label"]: r["lang"] for r in rows}


def labelled(label: Column, known: dict[str, str]) -> Column:
    """The language a label names, null where it names none."""
    if not known:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])[label]


def train(docs: DataFrame, known: dict[str, str], id_col: str, text_col: str, label_col: str) -> dict[str, str]:
    """Cleaned training text per language from ``SAMPLE_ROWS`` labelled rows each, chosen by the hash of their ids."""
    rows = docs.select(labelled(F.col(label_col), known).alias("lang"), F.xxhash64(id_col).alias("h"), F.substring(text_col, 1, SAMPLE_ROW_CHARS).alias("text"))
    rows = rows.where("lang is not null and length(text) >= 40")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # at most one row a language of the label table
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, int(min(1.0, (1.5 * SAMPLE_ROWS + 100) / n) * (1 << 30)))])
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")])  # so that tasks pass on no more rows at any size
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= SAMPLE_ROWS)
    return cleaned([(r["lang"], r["text"]) for r in first.orderBy("lang", "n").select("lang", "text").collect()])


_JUDGES: dict[int, Judge] = {}


def language_segments(docs: DataFrame, training: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and run of one language: ``id, segment, start, end, lang, confidence, sentences``.

    ``start`` and ``end`` are code points (end exclusive), ``sentences`` the complete sentences of the run.
    Null, blank and number-only texts and titles too short to judge have no rows; short sentences have; very long ones are judged whole; repeated
    rows give repeated rows; other columns are not carried.  Nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Automata(training))  # of at most AUTOMATON_CHARS characters a language
    token = hash(tuple(sorted(training.items())))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, segment int, start int, end int, lang string, confidence double, sentences int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _JUDGES:
            _JUDGES.clear()
            _JUDGES[token] = Judge(shared.value)
            gc.freeze()
        judge = _JUDGES[token]
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars <= BATCH_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                rows: list[tuple] = []
                who: list[int] = []
                for i, own in enumerate(segments(texts[at:end], judge), at):
                    rows += [(k, *s) for k, s in enumerate(own)]
                    who += [i] * len(own)
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, types)]], ["id", "segment", "start", "end", "lang", "confidence", "sentences"])
                at = end

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str], DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = label_map(spark.read.parquet(f"{sf_dir}/lang_codes.parquet"))
    return docs, known, language_segments(docs, train(docs, known, "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known, found = _parts(spark, sf_dir)
    spoken = found.where("sentences > 0").select(F.col("id").alias("doc_id"), "lang").distinct()
    named = docs.select("doc_id", labelled(F.col("lang"), known).alias("named"))
    return spoken.join(named, "doc_id").where("named is null or named <> lang").select("doc_id", "lang").distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].withColumnsRenamed({"id": "doc_id"}).withColumn("confidence", F.round("confidence", 4))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document (by characters; of equal ones the first by name), its confidence, and how many it has."""
    docs, _, found = _parts(spark, sf_dir)
    size = F.col("end") - F.col("start")
    per = found.groupBy("id", "lang").agg(F.sum(size).alias("chars"), (F.sum(size * F.col("confidence")) / F.sum(size)).alias("sure"))
    top = per.groupBy("id").agg(
        F.min(F.struct(-F.col("chars"), F.col("lang"), F.col("sure"), F.col("chars"))).alias("m"), F.count(F.lit(1)).alias("languages"), F.sum("chars").alias("all")
    )
    main = top.select(F.col("id").alias("doc_id"), F.col("m.lang").alias("lang"), F.round(F.col("m.sure") * F.col("m.chars") / F.col("all"), 4).alias("confidence"), "languages")
    return docs.select("doc_id").join(main, "doc_id", "left").select("doc_id", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.lit(0)).alias("languages"))
