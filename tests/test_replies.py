"""Reading model replies: each step of the cascade."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import replies


def ranking(*scores):
    return json.dumps({"block_rankings": [{"reasoning": "r", "relevance_score": s} for s in scores]})


@pytest.mark.parametrize(
    ("reply", "n", "scores"),
    [
        (ranking(0.2, 1.7), 2, [0.2, 1.7]), (ranking(0.2), 2, [0.2]), ("```json\n" + '{"block_rankings": []}' + "\n```", 2, []), ("score: 0.9", 2, [0.9, 0.9]), ("no idea", 2, [0.5, 0.5]),
        ("relevance 7 score .2", 2, [1.0, 0.2]), ("[1]", 2, [0.5, 0.5]), ("score: 0..5", 1, [0.5]), ("2 0.4 9", 2, [0.4, 0.5]), (None, 1, [0.5]), ('{"block_rankings": [{"relevance_score": 0.3}]}', 1, [0.3]), ("", 0, []),
    ],
)
def test_rankings(reply, n, scores):
    assert replies.read_rankings(reply, n) == scores


def test_answers():
    whole = replies.read_answer('{"final_answer": "x", "confidence_level": null}')
    assert whole["final_answer"] == "x" and whole["confidence_level"] is None and whole["reasoning_summary"] == "Summary not available"
    part = replies.read_answer('text ```json\n{"a": 1}\n``` more')
    assert part["confidence_level"] == "low" and part["final_answer"].startswith("text") and part["reasoning_summary"] == "Extracted response"
    raw = replies.read_answer("y" * 2000)
    assert len(raw["final_answer"]) == 1000 and raw["relevant_sources"] == []
    assert replies.read_answer("[1]")["final_answer"] == "[1]"
    assert replies.read_answer(None)["final_answer"] == ""


def test_columns(spark):
    df = spark.createDataFrame([(ranking(0.1), 1), (None, 2)], "r string, n int")
    assert [r[0] for r in df.select(replies.parse_rankings(F.col("r"), F.col("n"))).collect()] == [[0.1], [0.5, 0.5]]
    a = spark.createDataFrame([('{"final_answer": 3, "relevant_sources": "s"}',)], "r string").select(replies.parse_answer(F.col("r")).alias("a")).first()["a"]
    assert a["final_answer"] == "3" and a["relevant_sources"] == ["s"]
