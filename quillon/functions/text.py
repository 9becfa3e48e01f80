"""Column expressions that clean and take apart report text.

Patterns spell their character classes out, so that they mean the same in Java's, RE2's and Python's
regular expressions: ``SPACE`` is Unicode white space, ``DIGIT`` a decimal digit, ``WORD`` a letter, number or ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"

#: Number rules, in order.
NUMBER_RULES = (
    (rf"({DIGIT}){SPACE}*[,，]{SPACE}*({DIGIT}{{3}})", r"\1,\2"),
    (rf"({DIGIT}){SPACE}*[.．]{SPACE}*({DIGIT})", r"\1.\2"),
    (rf"({DIGIT}){SPACE}*[oO]{SPACE}*({DIGIT})", r"\1.0\2"),
    (rf"({DIGIT}){SPACE}+({DIGIT})", r"\1\2"),
    (rf"({DIGIT}){SPACE}*[%％]", r"\1%"),
    (rf"[$＄]{SPACE}*({DIGIT})", r"$\1"),
    (rf"([NT$]+){SPACE}*({DIGIT})", r"\1\2"),
    (rf"[-－—]{SPACE}*({DIGIT})", r"-\1"),
)
#: Spacing rules, in order.
SPACING_RULES = ((rf"({WORD}+)-{SPACE}*\n{SPACE}*({WORD}+)", r"\1\2"), (r" {2,}", " "), (r"\n{3,}", "\n\n"))
#: Full-width signs and what they become.
SIGNS, PLAIN = "＄％（）", "$%()"
#: Fixed value: what separates the columns of a page.
COLUMN_MARK = "||COLUMN||"
#: Fixed value: a page's marker line in a combined document.
PAGE_MARK = r"\n--- PAGE [0-9]+ ---\n"


def _apply(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to.replace("$", "\\$").replace("\\1", "$1").replace("\\2", "$2")))
    return text


def clean_numbers(text: Column) -> Column:
    return _apply(text, NUMBER_RULES)


def clean_spacing(text: Column) -> Column:
    return _apply(text, SPACING_RULES)


def clean_symbols(text: Column) -> Column:
    return F.translate(text, SIGNS, PLAIN)


def clean_text(text: Column) -> Column:
    """All rules in order: numbers, spacing, symbols; null stays null."""
    return clean_symbols(clean_spacing(clean_numbers(text)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"^{SPACE}+|{SPACE}+$"), F.lit(""))


def filled(text: Column) -> Column:
    """Whether a text holds more than white space (null: no)."""
    return F.coalesce(text.rlike(r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"), F.lit(False))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def sheet_name(text: Column) -> Column:
    """Of the first line that starts with ``Sheet:``, what is left without any ``Sheet:``."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: x.startswith("Sheet:")), F.lit(0))
    return F.coalesce(strip(F.replace(line, F.lit("Sheet:"), F.lit(""))), F.lit("Unknown Sheet"))


def without_page_marks(text: Column) -> Column:
    return F.regexp_replace(text, PAGE_MARK, "\n")


def columns_of(text: Column) -> Column:
    return F.split(text, r"\|\|COLUMN\|\|")


#: Pages up to which a stretch such as ``5-9`` is listed page by page.
SPREAD = 10_000


def page_numbers(page_range: Column, spans: Column, page: Column) -> Column:
    """Pages a chunk covers: those of its range (``5,6``, ``6, 5``, ``5-6``) if it spans pages, else its own.

    A stretch runs up or down; one of over ``SPREAD`` pages counts as its ends.
    """

    def numbers(part: Column) -> Column:
        ends = F.transform(F.split(part, r"[-‐‑–—~〜～－]"), lambda x: F.trim(x).try_cast("int"))
        first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        whole = (F.size(ends) == 2) & first.isNotNull() & last.isNotNull() & (F.abs(last - first) <= SPREAD)
        return F.when(whole, F.sequence(first, last)).otherwise(F.filter(ends, lambda x: x.isNotNull()))

    listed = F.flatten(F.transform(F.split(page_range, ","), numbers))
    return F.when(F.coalesce(spans, F.lit(False)) & page_range.isNotNull() & (F.size(listed) > 0), F.array_sort(F.array_distinct(listed))).otherwise(F.array(page))


def format_table(rows: Column) -> Column:
    """Rows of cells as lines of stripped cells joined by `` | ``; null cells are empty, empty rows left out."""
    kept = F.filter(rows, lambda r: r.isNotNull() & (F.size(r) > 0))
    return F.array_join(F.transform(kept, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(strip(c), F.lit(""))), " | ")), "\n")


def truncated(text: Column, limit: Column) -> Column:
    return F.when(F.length(text) > limit, F.concat(text.substr(F.lit(1), limit), F.lit("..."))).otherwise(text)


def token_count(text: Column) -> Column:
    """Words, numbers, single ideographs and signs: the built-in counter where no vocabulary is given."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0))


#: What counts as a token of the built-in counter.
TOKEN = r"[\p{sc=Han}\p{sc=Hiragana}\p{sc=Katakana}]|[\p{sc=Latin}\p{sc=Hangul}\p{N}_]+|[^\p{sc=Latin}\p{sc=Hangul}\p{sc=Han}\p{sc=Hiragana}\p{sc=Katakana}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]"
