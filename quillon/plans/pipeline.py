"""The whole way from files to logged answers, as lazily planned steps over a store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.replies import parse_answer, parse_rankings, plain_answer
from quillon.functions.scores import throughput
from quillon.functions.tokens import counted
from quillon.operators import chunking, knn, models, retrieval
from quillon.session import durable
from quillon.sources import files
from quillon.sources.store import Store, append_log

#: Fixed value: what separates the parts of a system prompt.
DELIMITER = "\n\n---\n\n"
SCHEMA_LEAD = "Reply with JSON alone, of this schema:\n```json\n{}\n```"
INSTRUCTIONS = "Answer the question from the context alone, briefly and in the question's language."
ANSWER_SCHEMA = '{"step_by_step_analysis": "string", "reasoning_summary": "string", "relevant_sources": ["string"], "confidence_level": "high, medium or low", "final_answer": "string"}'


def system_prompt(instructions: str, schema: str = "", example: str = "") -> str:
    """Instructions, the required schema and an example, those that are given, set apart by a delimiter."""
    return DELIMITER.join([instructions.strip(), *([SCHEMA_LEAD.format(schema)] if schema else []), *([example.strip()] if example else [])])


class Pipeline:
    """Ingest files, index their chunks, retrieve, answer and log; each step returns or stores DataFrames.

    ``embed`` maps texts to vectors, ``score`` and ``generate`` a prompt to a reply, ``count`` a text to its
    number of tokens.  With ``lists`` the search goes through so many inverted lists, ``probes`` of them for a
    question; without, it is exact.
    """

    def __init__(
        self, spark: SparkSession, folder: str, embed: models.Embed = models.hashed, score: models.Ask = models.overlap, generate: models.Ask = models.extract,
        count: Callable[[str], int] | None = None, lists: int = 0, probes: int = 4, system: str | None = None,
    ):
        self.spark, self.store = spark, Store(spark, folder)
        self.embed, self.score, self.generate, self.count, self.lists, self.probes = embed, score, generate, count, lists, probes
        self.system = system_prompt(INSTRUCTIONS, ANSWER_SCHEMA) if system is None else system
        self._fitted: knn.Lists | None = None

    def ingest(self, *paths: str) -> dict[str, int]:
        """Parse, chunk and add the files that the store doesn't have; counts of files, pages and chunks. No readable file is an error."""
        parsed = durable(files.read_files(self.spark, *paths))
        counts = {r[0]: r[1] for r in parsed.groupBy(F.col("document_type") == "failed").count().collect()}
        if not counts.get(False):
            raise RuntimeError("none of the files could be read")
        reports, pages = files.reports_of(parsed), files.pages_of(parsed)
        known = self.store.load("reports")
        if known is not None:
            new = known.select("doc_id")
            reports, pages = reports.join(new, "doc_id", "left_anti"), pages.join(new, "doc_id", "left_anti")
        batch = f"files-{uuid.uuid4().hex}"
        reports, pages = durable(reports), durable(pages)
        chunks = durable(chunking.keyed(chunking.chunk_documents(pages, reports)))
        for name, rows in (("pages", pages), ("chunks", chunks), ("reports", reports)):
            self.store.put(name, rows, batch)
        return {"parsed": counts.get(False, 0), "failed": counts.get(True, 0), "pages": pages.count(), "chunks": chunks.count()}

    def index(self) -> DataFrame:
        """Embed and add the chunks that the index doesn't have; the stored index."""
        chunks, known = self.store.load("chunks"), self.store.load("index")
        if chunks is None:
            raise FileNotFoundError(f"{self.store.folder} holds no chunks")
        new = chunks if known is None else chunks.join(known.select("vec_id"), "vec_id", "left_anti")
        new = durable(new.select("*", models.embedded(F.col("page_content"), self.embed).alias("embedding")))
        if known is None or not new.isEmpty():
            self.store.put("index", new, f"index-{uuid.uuid4().hex}")
            self._fitted = None
        return self.store.load("index")

    def near(self, index: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
        """``qid, rank, vec_id, distance`` of the chunks nearest to each question."""
        if not self.lists:
            return knn.knn_batch(index, asked, top_k)
        self._fitted = self._fitted or knn.Lists.fit(index, self.lists)
        return knn.knn_lists(index, asked, self._fitted, self.probes, top_k)

    def retrieve(self, questions: DataFrame, top_k: int = retrieval.TOP_K, top_n: int = retrieval.TOP_N) -> DataFrame:
        """Best parent pages of ``questions(qid bigint, question)`` with their scores."""
        return self.search(questions, self.index(), self.store.load("pages"), top_k, top_n)

    def search(self, questions: DataFrame, index: DataFrame, pages: DataFrame, top_k: int = retrieval.TOP_K, top_n: int = retrieval.TOP_N) -> DataFrame:
        """``retrieve`` over ``index(vec_id, embedding, doc_id, page, ...)`` and ``pages(doc_id, page, text)`` of one's own."""
        asked = questions.select(F.col("qid").alias("vec_id"), models.embedded(F.col("question"), self.embed).alias("embedding"))
        facts = {"chunk": "int", "page_range": "string", "spans_pages": "boolean", "source_file": "string", "document_type": "string"}
        kept = index.select("vec_id", "doc_id", "page", *[F.col(c) if c in index.columns else F.lit(None).cast(t).alias(c) for c, t in facts.items()])
        hits = self.near(index, asked, top_k).join(kept, "vec_id")
        parents = durable(retrieval.parent_pages(retrieval.project_hits(hits)))
        placed = durable(retrieval.batches(parents.join(retrieval.parent_content(parents, pages), ["qid", "rank"])))
        replies = models.replied(retrieval.rerank_prompts(placed, questions), self.score)
        scores = replies.select("qid", "batch", parse_rankings(F.col("reply"), F.col("blocks")).alias("scores"))
        return retrieval.best(retrieval.with_scores(placed, scores), top_n)

    def respond(self, questions: DataFrame, results: DataFrame) -> DataFrame:
        """``qid, question, context, a (the structured answer), input_tokens, output_tokens, seconds, second_call``."""
        asked = questions.select("qid", "question").join(retrieval.context(results), "qid", "left")
        prompts = retrieval.answer_prompts(asked, self.system).withColumn("input_tokens", counted(F.col("prompt"), self.count))
        replies = models.replied(prompts, self.generate, "plain")
        read = replies.withColumn("a", F.when(F.col("second_call"), plain_answer(F.col("reply"))).otherwise(parse_answer(F.col("reply"))))
        return read.withColumn("output_tokens", counted(F.col("a.final_answer"), self.count))

    def answer(self, questions: DataFrame, log: str | None = None) -> DataFrame:
        """Log rows: answer, confidence, sources, retrieval and performance figures of each question, appended to the folder ``log``.

        Questions are answered side by side: the retrieval time is that of the batch, the total time what passes
        from the beginning to a question's answer.
        """
        began = time.time()
        results = durable(self.retrieve(questions))
        found = time.time()
        answers = durable(self.respond(questions, results))
        total, tokens = F.lit(found - began) + F.col("seconds"), F.col("input_tokens") + F.col("output_tokens")
        times = {"retrieval_time_s": F.round(F.lit(found - began), 3), "generation_time_s": F.round("seconds", 3), "total_time_s": F.round(total, 3), "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"),
                 "total_tokens": tokens, "throughput_tokens_per_second": throughput(tokens, total), "start_time": F.lit(began), "end_time": F.lit(began) + total}
        rows = answers.join(retrieval.retrieval_metrics(results), "qid", "left").select(
            "qid", "question", F.col("a.final_answer").alias("answer"), F.coalesce("a.confidence_level", F.lit("unknown")).alias("confidence_level"), F.coalesce("a.relevant_sources", F.array().cast("array<string>")).alias("relevant_sources"),
            F.coalesce("a.reasoning_summary", F.lit("")).alias("reasoning_summary"), F.col("a.step_by_step_analysis").alias("step_by_step_analysis"),
            F.struct("avg_score", "max_score", "min_score", "score_range", "final_results").alias("retrieval_metrics"), F.struct(*[c.alias(k) for k, c in times.items()]).alias("performance_metrics"), F.lit(False).alias("used_existing_vectordb"),
        )
        if log:
            rows = durable(rows)
            append_log(rows.drop("qid", "step_by_step_analysis"), log)
        return rows
