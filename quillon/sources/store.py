"""Stored reports, pages, chunks and vectors as Parquet tables of one folder, and the question log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


_BATCH = "written_batch"


class Store:
    """A folder with the tables ``reports``, ``pages``, ``chunks`` and ``index``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        """Write a table as a whole, or append to it."""
        df.withColumn(_BATCH, F.lit("all")).write.mode(mode).partitionBy(_BATCH).parquet(f"{self.folder}/{name}")

    def put(self, name: str, df: DataFrame, batch: str) -> None:
        """Write the rows of one batch; a batch that is written again takes the place of its first rows."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{_BATCH}={batch}")

    def load(self, name: str, but: str | None = None) -> DataFrame | None:
        """A table (without the rows of the batch ``but``), or none where it was never written."""
        try:
            df = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return (df if but is None else df.where(F.col(_BATCH) != but)).drop(_BATCH)

    def exists(self) -> bool:
        return self.load("index") is not None and self.load("pages") is not None

    def stats(self, model: str = "hashed") -> DataFrame:
        """``document_count, persist_directory, embedding_model``."""
        index = self.load("index")
        if index is None:
            raise FileNotFoundError(f"{self.folder} holds no index")
        return index.agg(F.count(F.lit(1)).alias("document_count")).withColumns({"persist_directory": F.lit(self.folder), "embedding_model": F.lit(model)})


def append_log(log: DataFrame, folder: str, kind: str = "json") -> None:
    """Append question-log rows; in CSV, nested fields are written as JSON text."""
    if kind == "csv":
        nested = {n: F.to_json(n) for n, t in log.dtypes if t.startswith(("struct", "array", "map"))}
        log.withColumns(nested).write.mode("append").option("header", "true").csv(folder)
    else:
        log.write.mode("append").format(kind).save(folder)
