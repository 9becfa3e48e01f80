"""Command line: ``python -m quillon --store DIR [--files PATH ...] [--log DIR] [question ...]``; without a question it asks for them."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterable

from pyspark.sql import Row

from quillon.plans.pipeline import Pipeline
from quillon.session import local_session, ship

#: Characters of the analysis that a report shows, and what ends the questions.
ANALYSIS_CHARS, QUIT = 400, "quit"


def report(row: Row) -> str:
    """What is shown of one answered question."""
    m, analysis = row.retrieval_metrics, row.step_by_step_analysis or "No analysis"
    lines = [f"Confidence: {row.confidence_level}", f"Documents: {m.final_results or 0}"]
    if m.final_results:
        lines.append(f"Score Range: {m.min_score:.3f} - {m.max_score:.3f}")
    lines += ["", "--- Reasoning ---", row.reasoning_summary or "No summary", "", "--- Analysis ---", analysis[:ANALYSIS_CHARS] + "..." * (len(analysis) > ANALYSIS_CHARS), "", "--- Sources ---"]
    lines += [f"  {i}. {x}" for i, x in enumerate(row.relevant_sources or [], 1)] or ["  No sources identified"]
    return "\n".join([*lines, "", "--- Answer ---", row.answer or ""])


def asked(first: str, read: Callable[[str], str] = input) -> Iterable[str]:
    """The question given, else those typed until ``quit``."""
    if first:
        yield first
        return
    while (question := read("Question: ")).strip().lower() != QUIT:
        if question.strip():
            yield question


def main(argv: list[str] | None = None, read: Callable[[str], str] = input) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description="Answers questions about report files.")
    parser.add_argument("--store", required=True, help="folder of the stored reports and their index")
    parser.add_argument("--files", nargs="+", default=[], help="report files or folders to add")
    parser.add_argument("--log", help="folder of the question log; without it, log in the store")
    parser.add_argument("question", nargs="*")
    given = parser.parse_args(argv)
    spark = local_session()
    ship(spark)
    pipeline = Pipeline(spark, given.store)
    if given.files:
        print(", ".join(f"{k}: {v}" for k, v in pipeline.ingest(*given.files).items()))
    elif pipeline.store.load("chunks") is None:
        print("The store holds no documents; name some with --files.")
        return 1
    pipeline.index()
    for question in asked(" ".join(given.question), read):
        rows = pipeline.answer(spark.createDataFrame([(1, question)], "qid long, question string"), given.log or f"{given.store}/log")
        print(report(rows.first()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
