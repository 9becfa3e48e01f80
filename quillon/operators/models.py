"""What talks to models: embedder, scorer and generator, each with a stand-in that needs no service."""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of one request to an embedding service, and of the smaller requests after it refused one.
REQUEST_TEXTS, RETRY_TEXTS = 100, 50
DIMENSIONS = 64
_TERM = re.compile(r"[一-鿿぀-ヿ]|[^\W_]+")

Embed = Callable[[list[str]], list[list[float]]]
#: A model that answers a prompt: the scorer and the generator.
Ask = Callable[[str], str]
#: Prompts asked at a time by a task.
CONCURRENT = 3
#: What stands before the query and the blocks of a ranking prompt, and before the context and the question of an answering one.
QUERY_LABEL, BLOCKS_LABEL, CONTEXT_LABEL, QUESTION_LABEL = "\nQuery: ", "\n\nText Blocks:\n", "\nContext:\n", "\n\nQuestion:\n"


class TooManyTokens(RuntimeError):
    """An embedding service refused a request for its size."""


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Unit vectors of signed term counts by the hash of each term; a text without terms is the zero vector."""
    out = []
    for t in texts:
        v = np.zeros(dimensions)
        for term in terms(t):
            h = zlib.crc32(term.encode())
            v[h % dimensions] += 1 if h & 0x80000000 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def blocks_of(prompt: str) -> tuple[str, list[str]]:
    """The query and the text blocks of a ranking prompt."""
    head, _, rest = prompt.partition(BLOCKS_LABEL)
    return head.rpartition(QUERY_LABEL)[2].strip(), [x.strip("\n") for x in re.split(r"\nBlock \d+:\n", rest)[1:]]


def overlap(prompt: str) -> str:
    """Ranking reply of a scorer without a service: the share of the query's distinct terms that each block has."""
    query, texts = blocks_of(prompt)
    q = set(terms(query))
    shares = [len(q & set(terms(t))) / len(q) if q else 0.0 for t in texts]
    return json.dumps({"block_rankings": [{"reasoning": "shared terms", "relevance_score": x} for x in shares]})


def extract(prompt: str) -> str:
    """Answer reply of a generator without a service: the sentence of the context that shares most terms with the question."""
    context, _, question = prompt.rpartition(QUESTION_LABEL)
    context = context.rpartition(CONTEXT_LABEL)[2]
    q = set(terms(question))
    parts = [x.strip() for x in re.split(r"(?<=[。！？.!?])\s+|(?<=[。！？])|\n+", context) if x.strip()]
    best = max(parts, key=lambda x: len(q & set(terms(x))), default="")
    return json.dumps({"final_answer": best, "reasoning_summary": "the sentence that shares most terms with the question", "confidence_level": "medium" if best else "low"}, ensure_ascii=False)


def in_requests(texts: list[str], embed: Embed) -> list[list[float]]:
    """Vectors of texts by requests of ``REQUEST_TEXTS``; one refused for its size is sent again in smaller parts."""
    out: list[list[float]] = []
    for s in range(0, len(texts), REQUEST_TEXTS):
        part = texts[s : s + REQUEST_TEXTS]
        try:
            out += embed(part)
        except TooManyTokens:
            for r in range(0, len(part), RETRY_TEXTS):
                out += embed(part[r : r + RETRY_TEXTS])
    return out


def embedded(text: Column, embed: Embed = hashed) -> Column:
    """Vectors of a text column by Arrow batch; null texts count as empty."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(in_requests([t or "" for t in texts.to_pylist()], embed), pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(text)


def _called(ask: Ask, prompt: str | None) -> tuple[str | None, float]:
    began = time.monotonic()
    try:
        reply = ask(prompt or "")
    except Exception:  # whatever a service raises
        reply = None
    return reply, time.monotonic() - began


def replied(prompts: DataFrame, ask: Ask, plain: str | None = None) -> DataFrame:
    """``prompts`` without ``prompt`` (and ``plain``) with ``reply``, ``seconds`` and ``second_call``.

    ``CONCURRENT`` prompts are asked at a time.  Where a call fails, the prompt in the column ``plain`` is asked
    instead, if one is named; where that fails too, the reply is null.
    """
    kept = [c for c in prompts.columns if c not in ("prompt", plain)]
    kinds = {f.name: f.dataType.simpleString() for f in prompts.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "reply string, seconds double, second_call boolean"])
    asked = prompts.select(*kept, "prompt", *([plain] if plain else []))

    def one(pair: tuple[str | None, str | None]) -> tuple[str | None, float, bool]:
        reply, took = _called(ask, pair[0])
        if reply is None and plain:
            reply, more = _called(ask, pair[1])
            return reply, took + more, True
        return reply, took, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(CONCURRENT) as pool:
            for b in batches:
                first = b.column(len(kept)).to_pylist()
                found = list(pool.map(one, zip(first, b.column(len(kept) + 1).to_pylist() if plain else [None] * len(first))))
                cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], *cols], [*kept, "reply", "seconds", "second_call"])

    return asked.mapInArrow(run, schema)
