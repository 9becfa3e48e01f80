"""From hits to parent pages, scores and a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scores import combined
from quillon.functions.text import filled, page_numbers, truncated

from .models import BLOCKS_LABEL, CONTEXT_LABEL, QUERY_LABEL, QUESTION_LABEL

#: Hits of a question, blocks of a rerank batch, results kept, weight of the model's score.
TOP_K, BATCH, TOP_N, WEIGHT = 30, 2, 10, 0.7
#: Characters of a block alone in its batch and beside others.
ALONE_CHARS, SHARED_CHARS = 1200, 800
#: Fixed value: what separates the pages of a parent that has several.
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def project_hits(hits: DataFrame) -> DataFrame:
    """Hits with defaults for what their metadata lacks: page 0, chunk 1, empty file, type ``unknown``."""
    return hits.withColumns(
        {"page": F.coalesce("page", F.lit(0)), "chunk": F.coalesce("chunk", F.lit(1)), "source_file": F.coalesce("source_file", F.lit("")), "document_type": F.coalesce("document_type", F.lit("unknown"))}
    )


def page_content_map(pages: DataFrame, compat: bool = False) -> DataFrame:
    """Text by page: by (doc_id, page), or with ``compat`` by page number alone, the last document winning."""
    if not compat:
        return pages.groupBy("doc_id", "page").agg(F.max("text").alias("text"))
    return pages.groupBy("page").agg(F.max_by("text", F.struct("doc_id", "text")).alias("text"))


def parent_pages(hits: DataFrame, compat: bool = False) -> DataFrame:
    """The best hit of each page combination of a question: ``hits`` columns with ``pages`` and ``position``.

    ``hits(qid, rank, page, page_range, spans_pages, ...)`` holds at most the hits of one search a question.
    Combinations are told apart by document as well, with ``compat`` by page numbers alone.
    """
    key = ["qid", "pages"] if compat else ["qid", "doc_id", "pages"]
    covered = hits.withColumn("pages", page_numbers(F.col("page_range"), F.col("spans_pages"), F.col("page")))
    first = covered.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("rank"))).where("_r = 1").drop("_r")
    return first.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy("rank")))


def parent_content(parents: DataFrame, pages: DataFrame, compat: bool = False) -> DataFrame:
    """``qid, rank, text``: the page's text; of several pages those that aren't blank, each under ``[Page n]``."""
    content = page_content_map(pages, compat).withColumnRenamed("page", "p")
    keys = ["p"] if compat else ["doc_id", "p"]
    asked = parents.select("qid", "rank", *([] if compat else ["doc_id"]), F.size("pages").alias("k"), F.explode("pages").alias("p"))
    joined = asked.join(content, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))
    part = F.when(F.col("k") == 1, F.col("text")).when(filled(F.col("text")), F.concat(F.lit("[Page "), F.col("p").cast("string"), F.lit("]\n"), F.col("text")))
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("p", part.alias("t")))))
    return joined.groupBy("qid", "rank").agg(F.array_join(F.transform(parts, lambda x: x["t"]), PAGE_BREAK).alias("text"))


def batches(docs: DataFrame, size: int = BATCH) -> DataFrame:
    """Documents of a question by ``rank`` with ``batch`` and ``slot`` (from 0) and the batch's ``blocks``."""
    n = F.row_number().over(W.partitionBy("qid").orderBy("rank")) - 1
    placed = docs.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size).cast("int"), "slot": (F.col("_n") % size).cast("int")}).drop("_n")
    return placed.withColumn("blocks", F.count(F.lit(1)).over(W.partitionBy("qid", "batch")).cast("int"))


def blocks(placed: DataFrame) -> DataFrame:
    """Texts cut for the prompt: longer alone in a batch than beside others."""
    limit = F.when(F.col("blocks") == 1, ALONE_CHARS).otherwise(SHARED_CHARS)
    return placed.withColumn("block", truncated(F.col("text"), limit))


def block_prompts(placed: DataFrame) -> DataFrame:
    """``qid, batch, blocks, prompt``: the numbered blocks of each batch."""
    line = F.concat(F.lit("\nBlock "), (F.col("slot") + 1).cast("string"), F.lit(":\n"), F.coalesce("block", F.lit("")), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("slot", line.alias("t"))))
    return blocks(placed).groupBy("qid", "batch").agg(F.max("blocks").alias("blocks"), F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("prompt"))


#: What a ranking prompt asks for and the form of its reply.
RANKING_RULES = "Judge how far each of the text blocks answers the query. Score a block between 0.0 (off topic) and 1.0 (answers the query in full) by what it says itself, and give a short reason."
RANKING_SCHEMA = '{"block_rankings": [{"reasoning": "string", "relevance_score": float}]}'


def rerank_prompts(placed: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, batch, blocks, prompt``: the whole prompt of each batch, with rules, form of the reply, count, query and blocks."""
    lead = F.concat(F.lit(f"{RANKING_RULES}\n\nReply with one JSON object of this form:\n{RANKING_SCHEMA}\n\nGive one entry for each of the "), F.col("blocks").cast("string"), F.lit(" blocks, in their order.\n"))
    asked = block_prompts(placed).join(questions.select("qid", "question"), "qid")
    return asked.select("qid", "batch", "blocks", F.concat(lead, F.lit(QUERY_LABEL), F.coalesce("question", F.lit("")), F.lit(BLOCKS_LABEL), "prompt").alias("prompt"))


def answer_prompts(asked: DataFrame, system: str) -> DataFrame:
    """``asked(qid, question, context)`` with ``prompt`` (instructions, context, question) and the shorter ``plain`` of a second call."""
    context, question = F.coalesce("context", F.lit("")), F.coalesce("question", F.lit(""))
    said = F.concat(F.lit(CONTEXT_LABEL), context, F.lit(QUESTION_LABEL), question)
    return asked.withColumns({"prompt": F.concat(F.lit(f"{system}\n"), said), "plain": F.concat(F.lit("Answer the question from the context.\n"), said)})


def with_scores(placed: DataFrame, scores: DataFrame, weight: float = WEIGHT, compat: bool = False) -> DataFrame:
    """Documents with the scores of their batch's reply (``scores(qid, batch, scores)``) by slot.

    A document without a score gets 0.5; with ``compat`` it is lost, as are scores without a document.
    """
    each = scores.select("qid", "batch", F.posexplode("scores").alias("slot", "llm_score"))
    joined = placed.drop("llm_score").join(each, ["qid", "batch", "slot"], "inner" if compat else "left")
    score = F.coalesce("llm_score", F.lit(0.5))
    return joined.withColumns({"llm_score": score, "relevance_score": score, "combined_score": combined(score, F.col("distance"), weight)})


def best(scored: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` best of each question by ``combined_score``, ties by ``rank``, with their ``position``."""
    order = W.partitionBy("qid").orderBy(F.col("combined_score").desc_nulls_last(), "rank")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def context(results: DataFrame) -> DataFrame:
    """``qid, context``: the results of each question (at most ``TOP_N``), numbered and with their pages."""
    line = F.concat(F.lit("Document "), F.col("position").cast("string"), F.lit(" (Page "), F.col("page").cast("string"), F.lit(", "), F.col("source_file"), F.lit("):\n"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("position", line.alias("t"))))
    return results.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def retrieval_metrics(results: DataFrame, score: Column | None = None) -> DataFrame:
    """``qid, avg_score, max_score, min_score, score_range, final_results``."""
    s = F.col("combined_score") if score is None else score
    mean = F.round(F.avg(s.cast("decimal(30, 12)")), 4).cast("double")  # exact, so that no order of rows changes it
    return results.groupBy("qid").agg(mean.alias("avg_score"), F.round(F.max(s), 4).alias("max_score"), F.round(F.min(s), 4).alias("min_score"), F.round(F.max(s) - F.min(s), 4).alias("score_range"), F.count(F.lit(1)).alias("final_results"))
