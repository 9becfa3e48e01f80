"""Reading the replies of language models: block rankings and structured answers."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where JSON may stand in a reply that isn't JSON as a whole, in the order tried.
_PLACES = (re.compile(r"```json\s*(\{.*?\})\s*```", re.S), re.compile(r"```\s*(\{.*?\})\s*```", re.S), re.compile(r"(\{.*?\})", re.S))
_SCORE = re.compile(r"(?:score|relevance)[:\s]*([0-9.]+)", re.I)
_NUMBER = re.compile(r"[0-9.]+")
NEUTRAL = 0.5

#: An answer's fields with their defaults in a whole reply and in one taken out of text.
WHOLE = {"step_by_step_analysis": "Analysis not available", "reasoning_summary": "Summary not available", "relevant_sources": [], "confidence_level": "medium", "final_answer": "Answer not available"}
PART = {"step_by_step_analysis": "Analysis extracted from response", "reasoning_summary": "Extracted response", "relevant_sources": [], "confidence_level": "low"}
FAILED = {"step_by_step_analysis": "Fallback answer due to parsing error", "reasoning_summary": "Error in structured processing", "relevant_sources": [], "confidence_level": "low"}
_RAW = "Unable to parse structured analysis. Raw response: {}..."
_MALFORMED = "Fallback parsing used due to malformed JSON"


def _ranked(value: object) -> list[float]:
    """Scores of a valid ranking object; anything else raises."""
    blocks = value["block_rankings"]  # type: ignore[index]
    if not isinstance(blocks, list):
        raise ValueError
    out = []
    for b in blocks:
        if not isinstance(b["reasoning"], str):
            raise ValueError
        score = b["relevance_score"]
        if isinstance(score, bool):
            score = float(score)
        out.append(float(score))
    return out


def read_rankings(reply: str | None, expected: int) -> list[float]:
    """Scores of a reply for ``expected`` blocks.

    A valid JSON reply is taken as it is, also where it has more or fewer scores than blocks; else JSON
    inside it, else numbers after "score" or "relevance" (clamped), else any numbers from 0 to 1, else 0.5.
    A JSON value that isn't an object, an unreadable number and a missing reply give 0.5 throughout.
    """
    if reply is None:
        return [NEUTRAL] * expected
    try:
        value = json.loads(reply)
        if not isinstance(value, dict):
            return [NEUTRAL] * expected
        return _ranked(value)
    except (ValueError, KeyError, TypeError):
        pass
    for place in _PLACES:
        if m := place.search(reply):
            try:
                return _ranked(json.loads(m[1]))
            except (ValueError, KeyError, TypeError):
                continue
    try:
        scores = [min(1.0, max(0.0, float(x))) for x in _SCORE.findall(reply)[:expected]]
    except ValueError:
        return [NEUTRAL] * expected
    spare = iter(float(x) for x in _NUMBER.findall(reply) if re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", x) and float(x) <= 1)
    while len(scores) < expected:
        scores.append(next(spare, NEUTRAL))
    return scores


def read_answer(reply: str | None) -> dict:
    """The structured answer of a reply; a present field keeps its value, also null, a missing one gets its default."""
    text = reply or ""
    try:
        value = json.loads(text)
    except ValueError:
        value = None
        for place in _PLACES:
            if m := place.search(text):
                try:
                    found = json.loads(m[1])
                    return {**PART, "final_answer": text[:500], **found}
                except (ValueError, TypeError):
                    continue
        return {"step_by_step_analysis": _RAW.format(text[:500]), "reasoning_summary": _MALFORMED, "relevant_sources": [], "confidence_level": "low", "final_answer": text[:1000]}
    if not isinstance(value, dict):
        return {**FAILED, "final_answer": text}
    return {**WHOLE, **value}


ANSWER = "struct<step_by_step_analysis: string, reasoning_summary: string, relevant_sources: array<string>, confidence_level: string, final_answer: string>"


def plain_answer(reply: Column) -> Column:
    """The structured answer of a second, plain call: the reply itself under the defaults of a failed one; null: no answer."""
    fields = [(F.array().cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(k) for k, v in FAILED.items()]
    return F.struct(*fields, F.coalesce(reply, F.lit("")).alias("final_answer"))


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def parse_rankings(reply: Column, expected: Column) -> Column:
    def run(replies: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([read_rankings(r, n) for r, n in zip(replies.to_pylist(), counts.to_pylist())], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(reply, expected)


def parse_answer(reply: Column) -> Column:
    def run(replies: pa.Array) -> pa.Array:
        got = [read_answer(r) for r in replies.to_pylist()]
        plain = ["step_by_step_analysis", "reasoning_summary", "confidence_level", "final_answer"]
        cols = {k: pa.array([_text(g[k]) for g in got], pa.string()) for k in plain}
        lists = [g["relevant_sources"] if isinstance(g["relevant_sources"], list) else None if g["relevant_sources"] is None else [g["relevant_sources"]] for g in got]
        cols["relevant_sources"] = pa.array([None if x is None else [_text(y) for y in x] for x in lists], pa.list_(pa.string()))
        names = ["step_by_step_analysis", "reasoning_summary", "relevant_sources", "confidence_level", "final_answer"]
        return pa.StructArray.from_arrays([cols[n] for n in names], names)

    return F.arrow_udf(run, ANSWER)(reply)
