"""Noise in text from scanned pages, and its repair.

An averaged-perceptron character editor reads the page as one line of text and predicts, at each place
where a character is known to be a look-alike of another, whether to keep it or which edit undoes the
misreading (replace; replace and delete for two characters read for one; insert for one read for two),
and at each line end whether to join the lines, and whether to drop the sign before the line end.  It is
trained here on all pages, corrupted with the look-alikes: shares of them train side by side and their
weights are averaged.  The words and compounds, and the misreadings that the pages show, are counted over
all pages too.  Running titles and page numbers are found by their place on the page and their recurrence
over the report's pages.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import stored

#: Characters that train together, and of the pieces dealt to them; share of look-alikes put in; epochs.
SHARE_CHARS, PIECE_CHARS, RATE, EPOCHS = 2_000_000, 4_000, 0.04, 4
#: Weights are added up as whole multiples of this part, so that the order of the shares doesn't matter.
PART = 1 << 20
#: Sizes of the editor's weight tables of characters and, after it, of line ends, and its margin for an edit.
SPACE, ENDS, MARGIN = 1 << 21, 1 << 18, 0.0
#: A running title stands on at least this many pages, whatever the report's length.
TITLE_PAGES = 3
#: Tasks that share the pages of one title.
TITLE_SALTS = 16

#: Uses of a frequent and of a rare word, and words that must show a misreading for it to be learned.
FREQUENT, RARE, SHOWN = 20, 2, 4
#: Over all pages a word is rare beside another that is used so many times as much.
RATIO = FREQUENT // RARE
#: Times that a word's misreading must be expected for its absence to speak against it.
EXPECTED = 3

Table = tuple[tuple[str, str], ...]
#: What is printed and what it is misread as; misreadings that the sample shows are learned beside them.
LOOKALIKES = (
    ("的", "旳"), ("年", "午"), ("季", "李"), ("本", "木"), ("已", "巳"), ("元", "兀"), ("利", "刊"), ("比", "此"), ("大", "犬"), ("天", "夭"), ("未", "末"), ("日", "曰"), ("人", "入"), ("入", "人"), ("毛", "手"),
    ("千", "干"), ("土", "士"), ("東", "束"), ("問", "間"), ("待", "侍"), ("自", "白"), ("王", "玉"), ("末", "未"), ("己", "巳"),
    ("0", "O"), ("0", "o"), ("1", "l"), ("1", "I"), ("1", "|"), ("2", "Z"), ("5", "S"), ("8", "B"), ("6", "b"), ("9", "g"),
    ("g", "9"), ("i", "1"), ("l", "1"), ("a", "@"), ("o", "0"), ("e", "c"), ("t", "†"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"), ("I", "l"), ("b", "6"), ("s", "5"),
    ("d", "cl"), ("h", "li"), ("m", "rn"), ("rn", "m"), ("w", "vv"),
)
#: Written lines at a page's edge that tell how wide its lines are.
BESIDE = 12
#: Signs that stand for a hyphen at a line end.
HYPHENS = "-‐¬­‑"



def ranges(class_: str, above: int = 0xFFFF) -> str:
    """The characters of a class of ``regex`` up to the given one, as they stand in a set of ``re``, which searches several times as fast."""
    return "".join(f"{re.escape(m.group()[0])}-{re.escape(m.group()[-1])}" for m in regex.finditer(f"{class_}+", "".join(map(chr, range(above + 1)))))


_SPACES, _LATIN, _NUMERALS = ranges(r"\s"), ranges(r"\p{Latin}"), ranges(r"\p{N}")
_BLANKS = "".join(regex.findall(r"\s", "".join(map(chr, range(0x10000)))))
_BREAK = regex.compile(rf"(?<=\p{{L}})[{HYPHENS}][ \t]*\n[ \t]*(?=\p{{L}})")
_HANGING = regex.compile(rf"[{HYPHENS}][ \t]*\n[ \t]*(?=[\p{{Ll}}0-9@†|])")
_HEAD = regex.compile(r"[\p{Latin}\p{N}@†|]+(?:-[\p{Latin}]+)*$")
_TAIL = regex.compile(r"[\p{Ll}0-9@†|]+")
_WRAP = re.compile(rf"(?<=[!-~†])[ \t]*\n[{_SPACES}]*(?=[!-~†])")
_LINE = re.compile(rf"[ \t]*\n[{_SPACES}]*")
_RUN = re.compile(r"[A-Za-z0-9+/=]{16,}")
_JUNK = re.compile(r"(?:[A-Za-z0-9+/=]\n? {0,3}){24,}")
_TOKEN = regex.compile(r"[\p{Latin}\p{N}@†|]{5,}")
#: Three figures or signs: no replacement makes a word of what has them.
_UNLIKE_WORDS = re.compile("(?:[0-9@†|][^0-9@†|]*){3}")
_HAN = regex.compile(r"\p{Han}{3,}")
_WORD = regex.compile(r"\p{Latin}+(?:-\p{Latin}+)*")
_SIGNS = regex.compile(r"[\p{L}\p{N}@†|]+")
#: The same for texts without characters beyond the basic plane.
_NEAR_SIGNS = re.compile(f"[{ranges(r'[\p{L}\p{N}]')}@†|]+")
_NEAR_TOKEN, _NEAR_WORD = re.compile(f"[{_LATIN}{_NUMERALS}@†|]{{5,}}"), re.compile(f"[{_LATIN}]+(?:-[{_LATIN}]+)*")
_ENDS = re.compile(rf"[{HYPHENS}][ \t]*\n")
_DIGITS, _CAPITALS = re.compile("[0-9]+|[^0-9]+"), re.compile("[A-Z]+|[^A-Z]+")
_ROMAN = regex.compile(r"(?i)^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_DIGITAL = str.maketrans("OoQlI|iZzSsBbgq", "000111122558699")
_PLAIN_DIGITS = {c: str(unicodedata.decimal(chr(c))) for c in range(0x110000) if chr(c).isdecimal() and c > 127}
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_HEADING = regex.compile(r"\d{1,2}(?:\.\d{1,2})*[.、)]\s+\S.*\s/\s")
_FIGURES = regex.compile(r"(?:\t|\|| {2,})\s*\(?-?\d{1,3}(?:,\d{3})+\)?\s*$")
#: A slide that is only its title: "label: unit" over "place year".
_SLIDE = regex.compile(r"\s*[^\n]*[:：] [^\n]+\n\s*[^\n]*\b(?:19|20)\d\d\s*$")
_EDGES = (regex.compile(r"^\W*(?P<n>[\w|]+)(?:\s{2,}|\t|\s*[|·•—–-]\s+)(?P<t>.+)$"), regex.compile(r"^(?P<t>.+?)(?:\s{2,}|\t|\s+[|·•—–-]\s*)(?P<n>[\w|]+)\W*$"))
#: What sets a number off at either edge of a line.
_GAP = re.compile(r"[\s|·•—–-][\s|·•—–-]|\t")
_GOES_ON, _SMALL, _STOPPED = regex.compile(r"\p{Ll}|\d[\d,.]*[\p{Ll} ,]"), regex.compile(r"\p{Ll}{2}"), re.compile("[。；;！？]")
_PAGE = regex.compile(
    r"(?i)^\W*(?:(?:page|p|pg|seite|頁|页|第)[.\s:：]*)?([\p{N}OolI|ZSBivxlcdm]+)\s*(?:頁|页)?(?:\s*(?:/|of|,|，|共|之|von|／)+\s*(?:共\s*)?[\p{N}OolI|ZSB]+\s*(?:頁|页)?)?\W*$"
)
#: Letters that no such line begins with, nor an empty one.
_NO_NUMBER = {"", *"aefghjknqrtuwyAEFGHJKNQRTUWY"}


def flat(text: str) -> str:
    """The page as one line: hyphens at line ends dropped, wrapped lines joined, encoded attachments left out."""
    if _has_run(text) and any(_encoded(m.group()) for m in _RUN.finditer(text)):
        text = _RUN.sub(lambda m: "\n" if _encoded(m.group()) else m.group(), _JUNK.sub(lambda m: "\n" if any(map(_encoded, m.group().split())) else m.group(), text))
    if "\n" not in text:
        return text
    if _ENDS.search(text):
        text = _BREAK.sub("", text)
    first, *others = text.split("\n")
    if not others:
        return text
    out, before, last = [first.rstrip(" \t")], first.rstrip(" \t")[-1:], len(others)
    for i, line in enumerate(others, 1):  # as by _WRAP and _LINE
        line = line.lstrip(_BLANKS) if i == last else line.lstrip(_BLANKS).rstrip(" \t")
        if line:
            if ("!" <= before <= "~" or before == "†") and ("!" <= line[0] <= "~" or line[0] == "†"):
                out.append(" ")
            out.append(line)
            before = line[-1]
    return "".join(out)


_IN_RUN = bytes(c if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/=") else 0 for c in range(256)).translate(bytes([0]) + b"x" * 255)


def _has_run(text: str) -> bool:
    """Whether ``_RUN`` matches somewhere."""
    return b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(_IN_RUN)


def _encoded(s: str) -> bool:
    """Whether a run of letters and digits is an encoded attachment or a digest rather than a word or number."""
    return len(s) >= 16 and len(_DIGITS.findall(s)) > 4 or len(s) >= 20 and len(_CAPITALS.findall(s)) > 6


def _found(near: re.Pattern, any_: regex.Pattern, text: str) -> list[str]:
    return (near if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else any_).findall(text)


def tokens(text: str) -> list[str]:
    """The runs of letters and figures that are long enough to show a misreading."""
    return _found(_NEAR_TOKEN, _TOKEN, text)


def words_of(text: str) -> list[str]:
    """The words of a page, none across a line end."""
    return _found(_NEAR_WORD, _WORD, text)


def _heads(table: Table) -> dict[str, list[int]]:
    """Of each misreading the entries of the table that it may stand for."""
    out: dict[str, list[int]] = {}
    for k, (_, read) in enumerate(table):
        out.setdefault(read, []).append(k)
    return out


_CLASS = np.zeros(0x10000, np.uint8)
for _c in range(0x10000):
    _ch = chr(_c)
    _CLASS[_c] = 1 if "0" <= _ch <= "9" else 2 if "a" <= _ch <= "z" else 3 if "A" <= _ch <= "Z" else 4 if 0x4E00 <= _c < 0xA000 else 5 if _ch.isspace() or _c == 0 else 6 if _ch.isalpha() else 7 if _ch in ",.，．" else 8
_PRIME = np.uint64(0x100000001B3)


class _Codes:
    """Pages side by side as one array of codes with room between them."""

    def __init__(self, pages: list[str]):
        room = "\0" * 8
        self.codes = np.minimum(np.frombuffer((room + "".join([p + room for p in pages])).encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
        self.starts = 8 + np.cumsum([0, *(len(p) + 8 for p in pages)])[:-1]


def _places(c: np.ndarray, texts: list[str]) -> dict[str, np.ndarray]:
    """Where each of the texts, of one or two characters, begins."""
    first = np.zeros(0x10000, bool)
    first[[ord(t[0]) for t in texts if t[0] <= "\uffff"]] = True
    at = np.flatnonzero(first[np.minimum(c, 0xFFFF)])
    own = c[at].astype(np.uint16)
    order = np.argsort(own, kind="stable")  # radix sort
    at, own = at[order], own[order]
    out = {}
    for t in texts:
        lo, hi = (np.searchsorted(own, np.uint16(ord(t[0])), side) for side in ("left", "right")) if t[0] <= "\uffff" else (0, 0)
        out[t] = at[lo:hi]
        if len(t) > 1:
            inside = out[t][out[t] + 1 < len(c)]
            out[t] = inside[c[inside + 1] == ord(t[1])]
    return out


def _allowed(c: np.ndarray, at: np.ndarray, pair: tuple[str, str]) -> np.ndarray:
    """A digit stands for a letter only beside a letter, a letter for a digit only near a digit."""
    printed, read = pair
    if not (printed.isascii() and len(printed) == len(read) == 1) or printed.isdigit() == read.isdigit():
        return np.ones(len(at), bool)
    near = [_CLASS[c[at + k]] for k in ((-1, 1) if read.isdigit() else (-2, -1, 1, 2))]
    return np.any([(n == 2) | (n == 3) | (n == 6) if read.isdigit() else n == 1 for n in near], axis=0)


def _candidates(c: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(place, edit, context, features)``: the edits that may be made, which of the different contexts each is in, and theirs (contexts, features).

    A context is hashed once, however often it occurs.
    """
    heads = _heads(table)
    places = _places(c, [*heads])
    at = [(places[read][_allowed(c, places[read], table[k])], k) for read, ops in heads.items() for k in ops]
    where = np.concatenate([a for a, _ in at])
    op = np.repeat(np.array([k for _, k in at]), [len(a) for a, _ in at])
    last = where + np.array([len(read) - 1 for _, read in table])[op]
    left, right = np.zeros(len(where), np.uint64), np.zeros(len(where), np.uint64)
    for k in (1, 2, 3, 4):
        left = left << np.uint64(16) | c[where - k]
        right = right << np.uint64(16) | c[last + k]
    mix = left * np.uint64(0x9E3779B97F4A7C15)
    mix = (mix ^ (mix >> np.uint64(29)) ^ right) * np.uint64(0xBF58476D1CE4E5B9)
    mix = (mix ^ (mix >> np.uint64(32)) ^ op.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    _, one, which = np.unique(mix, return_index=True, return_inverse=True)
    if not all(np.array_equal(v, v[one][which]) for v in (left, right, op)):  # two contexts share a mix
        one = which = np.arange(len(where))
    return where, op, which, _context(c, where[one], last[one], op[one])


def _context(c: np.ndarray, at: np.ndarray, last: np.ndarray, op: np.ndarray) -> np.ndarray:
    """Hashed features of edits of the characters from ``at`` to ``last``: (places, features)."""
    l1, l2, l3, l4 = (c[at - k].astype(np.uint64) for k in (1, 2, 3, 4))
    r1, r2, r3, r4 = (c[last + k].astype(np.uint64) for k in (1, 2, 3, 4))
    k1, k2, k3, q1, q2, q3 = (_CLASS[x.astype(np.int64)].astype(np.uint64) for x in (l1, l2, l3, r1, r2, r3))
    rows = [
        (), (k1, q1), (k2, k1, q1, q2), (k3, k2, k1, q1, q2, q3), (l1,), (r1,), (l1, r1), (l2, l1), (r1, r2), (l2, l1, r1), (l1, r1, r2), (l2, l1, r1, r2),
        (l3, l2, l1), (r1, r2, r3), (l3, l2, l1, r1), (l1, r1, r2, r3), (l4, l3, l2, l1), (r1, r2, r3, r4), (l3, l2, l1, r1, r2, r3),
    ]
    out, high = np.empty((len(at), len(rows)), np.int32), np.empty(len(at), np.uint64)
    for i, parts in enumerate(rows):
        h = np.uint64(1469598103934665603) ^ (op * 64 + i).astype(np.uint64)
        for p in parts:
            h ^= p
            h *= _PRIME
            h ^= np.right_shift(h, np.uint64(31), out=high)
        out[:, i] = np.bitwise_and(h, np.uint64(SPACE - 1), out=high)
    return out


def _join_features(left: str, sign: str, right: str, words: set[str], compounds: set[str]) -> list[int]:
    return _known_features(left, sign, right, (left + right).lower() in words, f"{left}-{right}".lower() in compounds, left.rsplit("-", 1)[-1].lower() in words, right.lower() in words)


def _known_features(left: str, sign: str, right: str, word: bool, compound: bool, first: bool, second: bool) -> list[int]:
    last = left.rsplit("-", 1)[-1].lower()
    facts = (f"sign{sign}", f"word{word}", f"compound{compound}", f"both{word}{compound}", f"l{last[-3:]}", f"r{right[:3].lower()}", f"lr{last[-2:]}{right[:2].lower()}", f"parts{first}{second}", "join")
    return [SPACE + crc32(f.encode("utf-8", "surrogatepass")) % ENDS for f in facts]


class Editor:
    """The trained editor: averaged weights, and the words and compounds of its pages (None if they are in a table)."""

    def __init__(self, weights: np.ndarray, words: set[str] | None, compounds: set[str] | None, table: Table = LOOKALIKES):
        self.weights, self.words, self.compounds, self.table = weights, words, compounds, table

    def edits(self, pages: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per flat page the edits ``(start, length, printed)`` in order, best first where they overlap."""
        codes = _Codes(pages)
        where, op, which, features = _candidates(codes.codes, self.table)
        score = self.weights[features].sum(1)[which]
        best: dict[tuple[int, str], tuple[float, int]] = {}  # of a place and what is read there
        for i in np.flatnonzero(score > MARGIN).tolist():
            k, own = int(op[i]), (float(score[i]), int(op[i]))
            at = int(where[i]), self.table[k][1]
            if at not in best or own[0] > best[at][0]:
                best[at] = own
        found = [(at, len(read), value, k) for (at, read), (value, k) in best.items()]
        out: list[list[tuple[int, int, str]]] = [[] for _ in pages]
        page = np.searchsorted(codes.starts, [f[0] for f in found], "right") - 1
        last: dict[int, int] = {}
        for (at, n, _, op), p in sorted(zip(found, page.tolist()), key=lambda x: (x[0][0], -x[0][2])):
            start = at - int(codes.starts[p])
            if start >= last.get(p, 0):
                out[p].append((start, n, self.table[op][0]))
                last[p] = start + n
        return out

    def joins(self, left: str, sign: str, right: str) -> bool:
        """Whether the sign between the parts at a line end isn't the word's own hyphen."""
        return bool(self.weights[_join_features(left, sign, right, self.words, self.compounds)].sum() > 0)

    def split_words(self, text: str) -> list[tuple[int, int, int]]:
        """``(end of the first part, start and end of the second)`` of the words split at line ends."""
        return [place for place, end in line_ends(text) if self.joins(*end)]


def line_ends(text: str) -> list[tuple[tuple[int, int, int], tuple[str, str, str]]]:
    """Of the signs at line ends the place, as in ``split_words``, and the part before, the sign, the part after."""
    out = []
    for m in _HANGING.finditer(text) if _ENDS.search(text) else ():
        begin = m.start()
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "@†|-" or unicodedata.combining(text[begin - 1])):
            begin -= 1
        left, right = _HEAD.search(text, begin, m.start()), _TAIL.match(text, m.end())
        if left and right and any(map(str.isalpha, left.group())) and any(map(str.isalpha, right.group())):
            out.append(((m.start(), right.start(), right.end()), (left.group(), m.group()[0], right.group())))
    return out


def confusions(pages: list[str]) -> Table:
    """Misreadings that the sample itself shows, ``(printed, read)``, beside the fixed ones.

    A rare word that is one replacement away from one frequent word shows a pair; so does a rare run of three
    ideographs that differs in the middle from the one frequent run with its ends.  A pair counts if several
    different words show it (for ideographs, if they are most of what the character read is seen in).
    Doubled and dropped characters aren't misreadings.
    """
    words: Counter[str] = Counter()
    runs: Counter[str] = Counter()
    chars: Counter[str] = Counter()
    for page in pages:
        words.update(tokens(page))
        chars.update(page)
        for m in _HAN.finditer(page):
            runs.update([m.group()[i : i + 3] for i in range(len(m.group()) - 2)])
    gaps: dict[tuple[str, str], set[str]] = defaultdict(set)
    for word, n in words.items():
        if n >= FREQUENT and len(word) >= 5 and word.isalpha():
            for i in range(len(word)):
                for width in (1, 2):
                    if i + width <= len(word):
                        gaps[word[:i], word[i + width :]].add(word)
    shown: dict[tuple[str, str], set[str]] = defaultdict(set)
    for word, n in words.items():
        if n <= RARE and len(word) >= 5:
            hits = set()
            for i in range(len(word)):
                for width in (1, 2):
                    for full in gaps.get((word[:i], word[i + width :]), ()) if i + width <= len(word) else ():
                        printed, read = full[i : len(full) - len(word) + i + width], word[i : i + width]
                        if not {*printed} & {*read} and printed.lower() != read.lower() and len(printed) + len(read) < 4:
                            hits.add((printed, read, full))
            if len({h[2] for h in hits}) == 1:
                printed, read, full = min(hits, key=lambda h: (len(h[0]) + len(h[1]), h))
                shown[printed, read].add(full)
    middle: dict[tuple[str, str], set[str]] = defaultdict(set)
    for run, n in runs.items():
        if n >= FREQUENT:
            middle[run[0], run[2]].add(run[1])
    for run, n in runs.items():
        known = middle.get((run[0], run[2]), set())
        if n <= RARE and len(known) == 1 and (printed := min(known)) != run[1]:
            shown[printed, run[1]].update([f"{run}{i}" for i in range(n)])
    fixed = set(LOOKALIKES)
    learned = [pair for pair, held in shown.items() if pair not in fixed and len(held) >= SHOWN and (not _WIDE.match(pair[1]) or 2 * len(held) >= chars[pair[1]])]
    return tuple(sorted(learned))


def _misread(codes: np.ndarray, rng: np.random.Generator, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Character codes with look-alikes put in, and of each place the edit (plus one) that undoes one there."""
    printed: dict[str, list[int]] = {}
    for k, (p, _) in enumerate(table):
        printed.setdefault(p, []).append(k)
    op = np.zeros(len(codes), np.int16)
    taken = np.zeros(len(codes) + 1, bool)  # a place where two characters may have been read for one, and the place after one that was
    places = _places(codes, [*printed])
    paired = {c for p in printed if len(p) > 1 for c in p}
    for p, ops in sorted(printed.items(), key=lambda x: -len(x[0])):
        at = places[p]
        if len(p) > 1:
            at = at[~taken[at] & ~taken[at + 1]]
            taken[at] = True
        elif p in paired:
            at = at[~taken[at]]
        at = at[rng.random(len(at)) < RATE]
        if len(p) > 1:
            taken[at + 1] = True
        op[at] = np.array(ops)[rng.integers(0, len(ops), len(at))] + 1
    at = np.flatnonzero(op)
    own = op[at].astype(np.int64)
    long, two = (np.array([False, *(len(pair[i]) > 1 for pair in table)])[own] for i in (0, 1))
    grown = np.cumsum(two.astype(np.int64) - long)
    place = at + grown - two + long  # in the text with look-alikes; two characters for two move nothing
    inner, extra = at[long] + 1, at[two] + 1
    out = np.delete(np.insert(codes, extra, 0), inner + np.searchsorted(extra, inner, "right"))
    truth = np.zeros(len(out), np.int16)
    truth[place] = own
    out[place] = np.array([0, *(ord(read[0]) for _, read in table)], np.uint32)[own]
    out[place[two] + 1] = np.array([0, *(ord(read[-1]) for _, read in table)], np.uint32)[own[two]]
    return out, truth


def _corrupt(page: str, rng: random.Random, table: Table = LOOKALIKES) -> tuple[str, list[tuple[int, int]]]:
    """A page with look-alikes put in, and their ``(place, edit)``."""
    out, truth = _misread(np.frombuffer(page.encode("utf-32-le", "surrogatepass"), np.uint32), np.random.default_rng(rng.getrandbits(32)), table)
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), [(int(i), int(truth[i]) - 1) for i in np.flatnonzero(truth)]


def _varied(page: str, rng: random.Random) -> str:
    """Some pages in capitals, some respaced: neither is misreading."""
    kind = rng.random()
    if kind < 0.06:
        return page.upper()
    if kind < 0.16:
        return "".join(c for c in page if c != " " or rng.random() > 0.1)
    return page


def train(sample: list[str], seed: int = 3) -> Editor:
    """Editor from pages that are all at hand."""
    table = LOOKALIKES + confusions([flat(p) for p in sample])
    return Editor(fit(sample, table, seed), *_lexicon([words_of(p) for p in sample]), table)


def fit(sample: list[str], table: Table, seed: int = 3) -> np.ndarray:
    """Weights from some pages."""
    weights = np.zeros(SPACE + ENDS, np.float32)
    for ids, own in fit_parts(sample, table, seed):
        weights[ids] = own
    return weights


def fit_parts(sample: list[str], table: Table, seed: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The weights in use and their values, of characters, then of line ends; what the first passes take for misread in the pages is left out of the later ones."""
    rng, order_rng = random.Random(seed), np.random.default_rng(seed)
    codes = _Codes([_varied(flat(p), rng) for p in sample])
    misread, truth = _misread(codes.codes, order_rng, table)
    where, op, which, features = _candidates(np.minimum(misread, 0xFFFF), table)
    y = np.where(truth[where] == op + 1, np.float32(1), np.float32(-1))
    ids, x = _numbered(features, SPACE)
    w = np.zeros(len(ids), np.float32)
    changed, when = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
    rows, indices, values = (np.empty((256, x.shape[1]), kind) for kind in (np.int32, np.int64, np.float32))
    live = np.arange(len(y))
    steps = kept = 0
    for epoch in range(EPOCHS):
        if epoch == 2:
            live = live[~((y[live] < 0) & (w[x].sum(1)[which[live]] > 0))]
        order = order_rng.permutation(live)
        inside, label = which[order], y[order]
        for s in range(0, len(order), 256):
            own = inside[s : s + 256]
            at = indices[: len(own)]
            at[:] = x.take(own, axis=0, out=rows[: len(own)], mode="clip")
            wrong = np.flatnonzero(label[s : s + 256] * w.take(at, out=values[: len(own)], mode="clip").sum(1) <= 1.0)
            if len(wrong):
                to, by = at[wrong].ravel(), np.repeat(label[s + wrong] * np.float32(0.2), x.shape[1])
                np.add.at(w, to, by)
                changed.append(to)
                when.append(by * np.float32(kept))
            steps += 1
            kept += bool(epoch) and steps % 8 == 0
    late = np.bincount(np.concatenate(changed), np.concatenate(when), len(ids))  # what the weights of earlier steps lack of their sum
    yield ids, ((w * float(kept) - late) / max(1, steps // 8)).astype(np.float32)
    jx: list[list[int]] = []
    jy: list[int] = []
    half = len(sample) // 2
    found = [words_of(t) for t in sample]
    for known, own in ((found[:half], found[half:]), (found[half:], found[:half])):  # a page's words aren't known from itself
        words, compounds = _lexicon(known)
        features_of = cache(partial(_join_features, words=words, compounds=compounds))
        for page in own:
            _line_ends(page, rng, features_of, jx, jy)
    if jy:
        ids, total = _fit_ends(np.array(jx), np.array(jy, np.float32), [order_rng.permutation(len(jy)) for _ in range(EPOCHS)])
        yield ids, (total / (EPOCHS * len(jy))).astype(np.float32)


def _numbered(features: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The different features, and of each its number among them, so that the weights in use lie side by side."""
    used = np.zeros(space, bool)
    used[features] = True
    ids = np.flatnonzero(used)
    number = np.empty(space, np.int32)
    number[ids] = np.arange(len(ids), dtype=np.int32)
    return ids, number[features]


def _fit_ends(features: np.ndarray, y: np.ndarray, orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different features, and the sums of their weights over the examples that have them, one example after the other.

    Examples up to the next one that changes weights are scored at once.
    """
    ids, x = _numbered(features - SPACE, ENDS)
    x = x.astype(np.int64)
    w, total = np.zeros(len(ids) + 1, np.float32), np.zeros(len(ids) + 1)
    again = np.sort(x, 1)
    counted = x.copy()  # a feature that an example has twice counts once in the sums
    for i in np.flatnonzero((again[:, 1:] == again[:, :-1]).any(1)).tolist():
        counted[i] = [f if f not in x[i, :j] else len(ids) for j, f in enumerate(x[i])]
    for order in orders:
        at, ahead = 0, 16
        while at < len(order):
            own = order[at : at + ahead]
            wrong = np.flatnonzero(y[own] * w.take(x.take(own, axis=0)).sum(1) <= 1)
            right = own[: wrong[0]] if len(wrong) else own
            total += w * np.bincount(counted.take(right, axis=0).ravel(), minlength=len(w))
            at += len(right)
            if len(wrong):
                i = own[len(right)]
                w[x[i]] += y[i]
                total[counted[i]] += w[counted[i]]
                at, ahead = at + 1, max(16, ahead // 2)
            else:
                ahead = min(2 * ahead, 4096)
    return SPACE + ids, total[:-1]


def _line_ends(found: list[str], rng: random.Random, features_of: Callable[[str, str, str], list[int]], jx: list[list[int]], jy: list[int]) -> None:
    """Add the compounds and some of the words found on a page, as if they were split, to the examples."""
    for w in [w for w in found if len(w) >= 5 or "-" in w]:
        if "-" in w:
            for i, c in enumerate(w):
                if c == "-":
                    jx.append(features_of(w[:i], rng.choice(HYPHENS) if rng.random() < 0.2 else "-", w[i + 1 :].split("-")[0]))
                    jy.append(-1)
        elif rng.random() < 0.1:
            i = rng.randrange(2, len(w) - 1)
            jx.append(features_of(w[:i], rng.choice(HYPHENS), w[i:]))
            jy.append(1)


def _lexicon(own_words: list[list[str]]) -> tuple[set[str], set[str]]:
    words = {w.lower() for w in set().union(*own_words)}
    return words, {c for w in words if "-" in w for c in runs_of_parts(w)}


def runs_of_parts(word: str) -> set[str]:
    """Of a compound the compounds that it begins with, and each two parts."""
    parts = word.split("-")
    return {word} | {c for i in range(1, len(parts)) for c in ("-".join(parts[: i + 1]), "-".join(parts[i - 1 : i + 1]))}


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def is_number(token: str, page: int) -> bool:
    """Whether a token is the page's number in digits (look-alikes and leading zeros allowed) or Roman numerals."""
    t = token.strip()
    digits = t.translate(_DIGITAL)
    if any(c.isdecimal() for c in t) and digits.isdecimal() and digits.lstrip("0").translate(_PLAIN_DIGITS) == str(page):
        return True
    return 0 < page < 4000 and t.lower() == _roman(page)


def page_line(line: str, page: int) -> bool:
    """Whether a line holds the page's own number and nothing else."""
    line = line.strip()
    if line[:1] in _NO_NUMBER or "一" <= line[:1] <= "鿿" and line[0] not in "頁页第":
        return False
    m = _PAGE.match(line)
    return bool(m) and is_number(m[1], page)


def title_line(line: str, page: int) -> tuple[str, bool]:
    """A line without its page number at either end (set off by a gap), in comparable form; whether one was there."""
    line = line.strip()
    own = False
    for edge in _EDGES if _GAP.search(line) else ():
        if (m := edge.match(line)) and is_number(m["n"], page):
            line, own = m["t"], True
            break
    return "".join(_found(_NEAR_SIGNS, _SIGNS, line)).lower(), own


def _runs_on(line: str, after: str, width: int) -> bool:
    """Whether a line at a page's edge is wrapped body text: about as wide as the lines beside it, in the middle of a sentence.

    ``after`` is the line below, empty at the bottom; it tells body text from titles by form, so that a body line that
    chances to recur in a long report is no title.
    """
    bare, word = line.strip(), after.split(maxsplit=1)[:1]
    if not bare.isascii() and _WIDE.search(bare):
        return len(bare) >= 0.8 * width and "，" in bare
    if after:
        return len(bare) + 1 + len(word[0] if word else "") > width and bool(_GOES_ON.match(after.strip()))
    return len(bare) >= 0.8 * width and bool(_SMALL.match(bare))


def edges(text: str, page: int | None) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether the page's number stands alone at the top or bottom, and the lines there that may be titles."""
    number, out = False, []
    if page is None:
        return False, []
    lines = text.split("\n")
    written = [i for i, x in enumerate(lines) if x.strip()]
    if len(written) <= 2 and _SLIDE.match(text):
        return any(page_line(lines[i], page) for i in written), []
    for seq, near, top in ((written[:3], written[:BESIDE], True), (written[::-1][:3], written[-BESIDE:], False)):
        for i in seq:
            line = lines[i]
            if page_line(line, page):
                number = True
                continue
            bare = line.strip()
            width = max((len(lines[k].strip()) for k in near if k != i), default=0)
            if _runs_on(line, lines[i + 1].strip() if top and i + 1 < len(lines) else "", width) or _HEADING.match(bare) or ("\t" in bare or "|" in bare or "  " in bare) and _FIGURES.search(bare):
                break
            norm, own = title_line(line, page)
            if not norm.isalpha() and sum(map(str.isdigit, norm)) > sum(map(str.isalpha, norm)):
                break
            if len(norm) >= 4 and not bare.startswith(("Sheet:", "|")) and bare[-1] not in ".,，、:：" and not _STOPPED.search(bare):
                out.append((norm, own))
            break
    return number, out


def _fields(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def read_pages(pages: DataFrame, editor: Editor, repair: bool = False) -> DataFrame:
    """Per row of ``pages(doc_id, page, text)``: ``doc_id, page, hyphen, char, number, tops`` and, for repair, ``fixed``.

    ``tops`` has the comparable forms of the lines at the page's edges that may be running titles, with
    whether each holds the page's number; ``fixed`` has the repaired text.  Null and blank texts give no findings.
    If the editor's words are in a table, ``settled`` makes these columns out of ``ends``, the signs at line ends
    that may split words, and the ``parts`` of the text around them.
    """
    model = pages.sparkSession.sparkContext.broadcast((editor.weights, editor.words, editor.compounds, editor.table))  # of bounded size
    later = editor.words is None
    hyphen = "ends array<struct<left: string, sign: string, right: string>>" if later else "hyphen boolean"
    schema = f"doc_id {_fields(pages, 'doc_id')}, page {_fields(pages, 'page')}, {hyphen}, char boolean, number boolean, tops array<struct<norm: string, own: boolean>>" + (", parts array<string>" if repair and later else ", fixed string" if repair else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ed = Editor(*model.value)
        for batch in batches:
            ids, numbers, texts = batch.column(0), batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
            for at, end in _slices(texts, 500_000):
                own = texts[at:end]
                found = ed.edits([flat(t) for t in own])
                tops = [edges(t, n) for t, n in zip(own, numbers[at:end])]
                cols = [pa.array([bool(f) for f in found]), pa.array([t[0] for t in tops]), pa.array([[{"norm": n, "own": o} for n, o in t[1]] for t in tops], pa.list_(pa.struct([("norm", pa.string()), ("own", pa.bool_())])))]
                names = ["doc_id", "page", "ends" if later else "hyphen", "char", "number", "tops"]
                if later:
                    ends = [line_ends(t) for t in own]
                    first = pa.array([[{"left": e[0].lower(), "sign": e[1], "right": e[2].lower()} for _, e in x] for x in ends], pa.list_(pa.struct([("left", pa.string()), ("sign", pa.string()), ("right", pa.string())])))
                    if repair:
                        cols.append(pa.array([parted(t, [place for place, _ in x], f) for t, x, f in zip(own, ends, found)], pa.list_(pa.string())))
                        names.append("parts")
                else:
                    split = [ed.split_words(t) for t in own]
                    first = pa.array([bool(x) for x in split])
                    if repair:
                        cols.append(pa.array([mended(t, x, f) for t, x, f in zip(own, split, found)], pa.string()))
                        names.append("fixed")
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), batch.column(1).slice(at, end - at), first, *cols], names)

    return pages.select("doc_id", "page", "text").mapInArrow(run, schema)


def _slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``most`` characters together, or of one text."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= most):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def settled(read: DataFrame, editor: Editor, counts: DataFrame) -> DataFrame:
    """``read_pages`` of an editor whose words are in the table ``counts``, with its ends decided.

    Every different end is looked up once by joins, so the words are never in one place.
    """
    end = F.struct("left", "sign", "right")
    key = F.xxhash64("doc_id", "page", "ends")  # rows that share a key by chance share what is decided for any page alike
    some = read.where(F.size("ends") > 0).withColumn("key", key)
    asked = some.select("key", F.explode("ends").alias("e")).select("key", "e.*").distinct()
    last = F.substring_index("left", "-", -1)
    ask = [("w", F.concat("left", "right")), ("p", F.concat("left", F.lit("-"), "right")), ("w", last), ("w", F.col("right"))]
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(k).alias("kind"), x.alias("word")) for i, (k, x) in enumerate(ask)]))
    lookups = asked.select("left", "sign", "right").distinct().select("left", "sign", "right", slots.alias("s")).select("left", "sign", "right", "s.*")
    uses = [F.coalesce(F.max(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(4)]
    known = lookups.join(counts.where(F.col("kind").isin("w", "p")), ["kind", "word"], "left").groupBy("left", "sign", "right").agg(*uses)
    word, compound = ((F.col(a) > 0) & (F.col(a) * RATIO > F.col(b)) for a, b in (("n0", "n1"), ("n1", "n0")))  # far less used than the other: not a word of its own
    weights = read.sparkSession.sparkContext.broadcast(editor.weights[SPACE:])  # of fixed size

    def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.value
        for batch in batches:
            hit = [bool(own[[k - SPACE for k in _known_features(*x)]].sum() > 0) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["left", "sign", "right"]).filter(pa.array(hit, pa.bool_()))

    yes = known.select("left", "sign", "right", word.alias("word"), compound.alias("compound"), F.col("n2") > 0, F.col("n3") > 0).mapInArrow(joins, "left string, sign string, right string")
    split = asked.join(yes, ["left", "sign", "right"], "left_semi").groupBy("key").agg(F.collect_set(end).alias("split"))  # of one page
    every = some.join(split, "key", "left").drop("key").unionByName(read.where(F.size("ends") == 0).withColumn("split", F.lit(None)))
    out = [F.col("doc_id"), F.col("page"), F.col("split").isNotNull().alias("hyphen"), F.col("char"), F.col("number"), F.col("tops")]
    if "parts" in read.columns:
        part = F.col("parts")
        ended = F.transform("ends", lambda e, i: F.concat(F.when(F.array_contains("split", e), part[3 * i + 2]).otherwise(part[3 * i + 1]), part[3 * i + 3]))
        out.append(F.concat(part[0], F.array_join(ended, "")).alias("fixed"))
    return every.select(*out)


def _placed(text: str) -> list[int]:
    """Of each character of the flat page its place in the page's text."""
    place = np.arange(len(text))

    def sub(pattern: regex.Pattern | re.Pattern, to, text: str, place: np.ndarray) -> tuple[str, np.ndarray]:
        parts, places, at = [], [], 0
        for m in pattern.finditer(text):
            new = to(m)
            parts += [text[at : m.start()], new]
            places += [place[at : m.start()], place[m.start() : m.end()][:1].repeat(len(new)) if new != m.group() else place[m.start() : m.end()]]
            at = m.end()
        return "".join(parts) + text[at:], np.concatenate([*places, place[at:]])

    if any(_encoded(m.group()) for m in _RUN.finditer(text)):
        text, place = sub(_JUNK, lambda m: "\n" if any(map(_encoded, m.group().split())) else m.group(), text, place)
        text, place = sub(_RUN, lambda m: "\n" if _encoded(m.group()) else m.group(), text, place)
    for pattern, to in ((_BREAK, ""), (_WRAP, " "), (_LINE, "")):
        text, place = sub(pattern, lambda m, to=to: to, text, place)
    return place.tolist()


def mended(text: str, split: list[tuple[int, int, int]], edits: list[tuple[int, int, str]]) -> str:
    """A page's text with the words joined and the characters replaced that the editor found; other line ends kept."""
    parts = parted(text, split, edits)
    return "".join(x for i, x in enumerate(parts) if i % 3 != 1)


def parted(text: str, ends: list[tuple[int, int, int]], edits: list[tuple[int, int, str]]) -> list[str]:
    """A page's text with the characters replaced, as the part before the first end and, of each, the end as it is, joined, and the part after."""
    place = _placed(text) if edits else []
    new = {place[start + k]: printed if k == 0 else "" for start, n, printed in reversed(edits) for k in range(n)}  # the first character gives way to what was printed, the others go
    changed = sorted(new)

    def own(start: int, end: int) -> str:
        out, at = [], start
        for i in changed[bisect_left(changed, start) : bisect_left(changed, end)]:
            out += [text[at:i], new[i]]
            at = i + 1
        return "".join(out) + text[at:end]

    parts, at = [], 0
    for head, tail, end in ends:
        after = end
        while after < len(text) and text[after] == " ":
            after += 1
        parts += [own(at, head), own(head, after), own(tail, end) + "\n"]
        at = after
    return [*parts, own(at, len(text))]


_BLANK = regex.compile(r"\n[ \t]*\n+")
_WRAPPED = regex.compile(r"[ \t]*\n(?![ \t]*(?:[-*•]|\d+[.)、]|\||Sheet:| {2,}))[ \t]*")
_BETWEEN_WORDS = regex.compile(r"(?<=[!-~])\n(?=[!-~])")
_BETWEEN_SIGNS = regex.compile(r"(?<=[^\n\x00-\x7f]|[,.;])\n(?=\S)(?![-*•|]|\d+[.)])|(?<=\S)\n(?=[^\x00-\x7f\n])")


def paragraphs(text: str) -> str:
    """Continuous paragraphs: wrapped lines joined (with a space between Latin words), blank lines and lists kept."""
    out = []
    for block in _BLANK.split(text):
        block = block.strip("\n")
        if "\n" in block:
            block = _BETWEEN_SIGNS.sub("", _BETWEEN_WORDS.sub(" ", _WRAPPED.sub("\n", block)))
        out.append(block)
    return "\n\n".join(x for x in out if x.strip())


def _titles(read: DataFrame) -> DataFrame:
    """``doc_id, page, own, norms``: pages with a running title, whether its line holds the page's number, and its forms.

    A line counts if, of its comparable form, the first or the second half recurs in the report, the whole form
    is close to the most frequent one with that half, and lines so close to that one stand on enough pages.
    """
    lines = read.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull()).select("doc_id", "page", F.explode("tops").alias("t")).select("doc_id", "page", "t.norm", "t.own").distinct()
    n = F.length("norm")
    halves = F.array(F.concat(F.lit("<"), F.substring("norm", 1, F.floor(n / 2))), F.concat(F.lit(">"), F.expr("substring(norm, cast(floor(length(norm) / 2) as int) + 1)")))
    keyed = lines.withColumn("half", F.explode(halves))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page", F.lit(13)), F.lit(TITLE_SALTS)).cast("int"))  # a title of most pages is joined by several tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(TITLE_SALTS - 1)))
    forms = keyed.groupBy("doc_id", "half", "norm").agg(F.countDistinct("page").alias("k"))
    often = forms.groupBy("doc_id", "half").agg(F.sum("k").alias("n"), F.max_by("norm", F.struct("k", "norm")).alias("form")).where(F.col("n") >= TITLE_PAGES).drop("n")
    close = F.expr("levenshtein(norm, form, cast(greatest(2, floor(length(form) * 0.2)) as int))") >= 0
    near = keyed.join(often.withColumn("salt", salts), ["doc_id", "half", "salt"]).where(close)
    enough = near.groupBy("doc_id", "half").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= TITLE_PAGES)
    return near.join(enough.withColumn("salt", salts), ["doc_id", "half", "salt"], "left_semi").groupBy("doc_id", "page").agg(F.max("own").alias("own"), F.array_distinct(F.flatten(F.collect_set(F.array("norm", "form")))).alias("norms"))


def noise(read: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """``doc_id, page, noise``: one row for each page and kind of noise; ``tops`` is the stored table to take titles from, if not ``read``."""
    titles = _titles(tops or read)
    flags = read.groupBy("doc_id", "page").agg(*[F.max(c).alias(c) for c in ("hyphen", "char", "number")])
    both = flags.join(titles.select("doc_id", "page", "own"), ["doc_id", "page"], "left")
    kinds = F.array(
        F.when(F.col("hyphen"), F.lit("hyphen")), F.when(F.col("char"), F.lit("char")), F.when(F.col("own").isNotNull(), F.lit("header")), F.when(F.col("number") | F.coalesce("own", F.lit(False)), F.lit("page_no"))
    )
    return both.select("doc_id", "page", F.explode(F.array_compact(kinds)).alias("noise"))


def count_words(pages: DataFrame) -> DataFrame:
    """``kind, word, n``: uses in all pages of tokens (t), runs of three ideographs (h), ideographs (c), words (w) and compounds (p), and all characters (s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at, end in _slices(texts, SHARE_CHARS):
                plain = [flat(t) for t in texts[at:end]]
                counts = {k: Counter() for k in "twp"} | _ideographs(plain) | {"s": {"": sum(map(len, texts[at:end]))}}
                for t in plain:
                    counts["t"].update(tokens(t))
                counts["t"] = {w: n for w, n in counts["t"].items() if not _UNLIKE_WORDS.search(w)}
                own_words: Counter[str] = Counter()
                for t in texts[at:end]:
                    own_words.update(words_of(t))
                for w, n in own_words.items():
                    counts["w"][w.lower()] += n
                for w, n in counts["w"].items():
                    if "-" in w:
                        counts["p"].update(dict.fromkeys(runs_of_parts(w), n))
                for kind, own in counts.items():
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own)), pa.array([*own], pa.string()), pa.array([*own.values()], pa.int64())], ["kind", "word", "n"])

    return pages.select("text").mapInArrow(run, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


@cache
def _han() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(r"\p{Han}", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))]] = True
    return out


def _ideographs(pages: list[str]) -> dict[str, dict[str, int]]:
    """Uses of runs of three ideographs and of ideographs."""
    codes = np.frombuffer("\0".join(pages).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    han = _han()[codes]
    three = np.flatnonzero(han[:-2] & han[1:-1] & han[2:])
    runs, k = np.unique(codes[three] << 42 | codes[three + 1] << 21 | codes[three + 2], return_counts=True)
    chars, n = np.unique(codes[han], return_counts=True)
    return {"h": {chr(r >> 42) + chr(r >> 21 & 0x1FFFFF) + chr(r & 0x1FFFFF): c for r, c in zip(runs.tolist(), k.tolist())}, "c": {chr(c): m for c, m in zip(chars.tolist(), n.tolist())}}


def all_confusions(counts: DataFrame) -> Table:
    """``confusions`` of all pages, from ``count_words``.

    What is rare is so beside the frequent word, as every misreading of a frequent word recurs in a large table.
    A pair must also be shown by at least half of the words that are used so much that it is to be expected in
    them; endings and other pairs of words that differ in one character aren't.
    """
    words = counts.where((F.col("kind") == "t") & (F.length("word") >= 5)).select("word", "n")
    spots = words.withColumn("i", F.explode(F.expr("sequence(0, length(word) - 1)"))).withColumn("width", F.explode(F.array(F.lit(1), F.lit(2)))).where("i + width <= length(word)")
    spots = spots.select("word", "n", F.expr("substring(word, 1, i)").alias("head"), F.expr("substring(word, i + 1, width)").alias("mid"), F.expr("substring(word, i + width + 1)").alias("tail"))
    frequent = spots.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^\p{L}+$")).select("head", "tail", F.col("word").alias("full"), F.col("n").alias("uses"), F.col("mid").alias("printed"))
    hits = spots.withColumnRenamed("mid", "read").join(frequent, ["head", "tail"]).where(F.col("n") * RATIO <= F.col("uses"))
    hits = hits.where("length(printed) + length(read) < 4 and lower(printed) <> lower(read) and translate(printed, read, '') = printed")
    sole = hits.groupBy("word", "n").agg(F.countDistinct("full").alias("fulls"), F.min(F.struct(F.expr("length(printed) + length(read)").alias("size"), "printed", "read", "full", "uses")).alias("h")).where("fulls = 1").select("n", "h.*")
    fixed = counts.sparkSession.createDataFrame([*LOOKALIKES], "printed string, read string")
    shown = sole.groupBy("printed", "read").agg(F.countDistinct("full").alias("held"), F.sum("n").alias("misread"), F.sum("uses").alias("uses")).where(F.col("held") >= SHOWN).join(fixed, ["printed", "read"], "left_anti")
    grams = frequent.select("full", "printed", F.col("uses").alias("own")).distinct()
    due = grams.join(shown, "printed").where(F.col("own") * F.col("misread") >= F.col("uses") * EXPECTED).groupBy("printed", "read").agg(F.count("*").alias("due"))
    latin = shown.join(due, ["printed", "read"], "left").where(F.col("held") * 2 >= F.coalesce("due", F.lit(0))).select("printed", "read")
    runs = counts.where("kind = 'h'").select(F.expr("concat(substring(word, 1, 1), substring(word, 3, 1))").alias("ends"), F.expr("substring(word, 2, 1)").alias("mid"), "n")
    most = runs.groupBy("ends").agg(F.max(F.struct("n", "mid")).alias("top")).where(F.col("top.n") >= FREQUENT)
    beside = runs.join(most, "ends").where("mid <> top.mid")
    rare = beside.groupBy("ends").agg(F.max("n").alias("next"), F.first("top.n").alias("first")).where(F.col("next") * RATIO <= F.col("first")).select("ends")
    held = beside.join(rare, "ends", "left_semi").groupBy(F.col("top.mid").alias("printed"), F.col("mid").alias("read")).agg(F.sum("n").alias("held")).where(F.col("held") >= SHOWN)
    chars = counts.where("kind = 'c'").select(F.col("word").alias("read"), F.col("n").alias("all"))
    wide = held.join(chars, "read").where("2 * held >= all").join(fixed, ["printed", "read"], "left_anti").select("printed", "read")
    return tuple(sorted((r[0], r[1]) for r in latin.unionByName(wide).collect()))  # pairs of characters, however large the table


def fit_all(pages: DataFrame, table: Table, counts: DataFrame | None = None) -> np.ndarray:
    """Weights trained on all pages: the mean of those of shares of about ``SHARE_CHARS`` characters, dealt by hash."""
    total = (pages.agg(F.sum(F.length("text"))) if counts is None else counts.where("kind = 's'").agg(F.sum("n"))).first()[0] or 0
    shares = total // SHARE_CHARS + 1
    cut = F.expr(f"if(length(text) between 1 and {PIECE_CHARS}, array(text), regexp_extract_all(text, '(?s).{{1,{PIECE_CHARS}}}', 0))")
    pieces = pages.select(F.xxhash64("doc_id", "page", "text").alias("h"), F.posexplode(cut).alias("i", "text"))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("h", "i"), F.lit(shares)))
    tasks = min(shares, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.repartition(tasks, "share").sortWithinPartitions("share", "h", "i", "text").select("share", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, own, held, done = np.zeros(SPACE + ENDS, np.int64), None, [], 0

        def learn() -> int:
            if held:
                for ids, weights in fit_parts(held, table):
                    sums[ids] += np.rint(weights.astype(np.float64) * PART).astype(np.int64)
            return bool(held)

        for batch in batches:
            for share, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if share != own:
                    done += learn()
                    own, held = share, []
                held.append(text)
        done += learn()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(sums[at], done), pa.int64())], ["at", "n"])

    weights = np.zeros(SPACE + ENDS + 1, np.float64)
    rows = ordered.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most one a weight
    weights[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return (weights[:-1] / PART / max(1, weights[-1])).astype(np.float32)


def read_all(pages: DataFrame, repair: bool = False) -> tuple[DataFrame, DataFrame]:
    """``read_pages`` with an editor trained and words counted on these pages, all of them; settled, and as stored."""
    counts = stored(count_words(pages))
    table = LOOKALIKES + all_confusions(counts)
    editor = Editor(fit_all(pages, table, counts), None, None, table)
    read = stored(read_pages(pages, editor, repair))
    return settled(read, editor, counts), read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("doc_id", "page", "text")
    return noise(*read_all(pages))


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once, as continuous paragraphs without running titles and page numbers."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("doc_id", "page", "text")
    return repaired(*read_all(pages, repair=True))


def repaired(read: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """``doc_id, page, text``: every page of ``read_pages(..., repair=True)`` once (all texts of a page without number), cleaned."""
    lone = F.when(F.col("doc_id").isNull() | F.col("page").isNull(), F.col("fixed"))
    once = read.groupBy("doc_id", "page", lone.alias("lone")).agg(F.max("fixed").alias("fixed"), F.max("number").alias("number"))
    with_titles = once.join(_titles(tops or read).select("doc_id", "page", "norms"), ["doc_id", "page"], "left")
    clean = F.pandas_udf(_clean, "string")
    return with_titles.select("doc_id", "page", clean("fixed", F.when(F.col("number") | F.col("norms").isNotNull(), F.col("page")), "norms").alias("text"))


def cleaned(text: str, page: int | None, titles: set[str]) -> str:
    """Paragraphs of a page without its number and its running titles, given in comparable form; without a number as they are."""
    lines = text.split("\n")
    for order in (1, -1):
        for i in [i for i in range(len(lines))[::order] if lines[i].strip()][:3] if page is not None else []:
            if not page_line(lines[i], page):
                form = title_line(lines[i], page)[0]
                if not any(form == t or SequenceMatcher(None, form, t, False).ratio() >= 0.8 for t in titles):  # the repair may have changed it
                    break
            lines[i] = ""
    return paragraphs("\n".join(lines))


def _clean(fixed, page, norms):
    import pandas as pd

    return pd.Series([cleaned(t or "", None if pd.isna(n) else int(n), set(own) if own is not None else set()) for t, n, own in zip(fixed, page, norms)])
