"""Token counters: of a model's own vocabulary where one is at hand, else the built-in one."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TOKEN, token_count

#: Vocabularies tried in order where a model has none of its own.
FALL_BACK = ("o200k_base", "cl100k_base")
_TOKEN = regex.compile(TOKEN)

Load = Callable[[str], Callable[[str], list]]


def builtin(text: str) -> int:
    return len(_TOKEN.findall(text))


def counter(model: str | None = None, load: Load | None = None) -> Callable[[str], int]:
    """Counts a text's tokens by ``load(model)``, a function from text to tokens.

    A model that ``load`` doesn't know (``KeyError``) is counted by the first of ``FALL_BACK`` that can be
    loaded; without a model, a loader or any vocabulary the built-in counter counts.
    """
    if model is None or load is None:
        return builtin
    for name in (model, *FALL_BACK):
        try:
            encode = load(name)
        except Exception:  # unknown to the loader, or its file can't be had
            continue
        return lambda text: len(encode(text))
    return builtin


def counted(text: Column, count: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text column (null: 0); without a counter of one's own by the built-in one in the JVM."""
    if count is None or count is builtin:
        return token_count(text)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([count(t or "") for t in texts.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")(text)
