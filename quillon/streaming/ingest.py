"""Incremental ingest: files that appear in a folder are parsed, chunked and appended once."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.chunking import chunk_documents, keyed
from quillon.sources import files
from quillon.sources.store import Store

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watch ``source`` and append reports, pages and chunks of new files to the store in ``folder``.

    The checkpoint remembers the files read.  Each table has the rows of a batch in a place of their own, which
    a batch that is run again after a failure overwrites, so that nothing is stored twice; reports that an
    earlier batch stored are left out.  ``Pipeline.index`` then embeds what it hasn't yet.
    """
    store = Store(spark, folder)
    own = zlib.crc32(checkpoint.encode())

    def append(batch: DataFrame, number: int) -> None:
        name = f"stream-{own:08x}-{number}"
        parsed = files.parse_files(batch)
        reports = files.reports_of(parsed)
        known = store.load("reports", but=name)
        if known is not None:
            reports = reports.join(known.select("doc_id"), "doc_id", "left_anti")
        reports = reports.persist()
        pages = files.pages_of(parsed).join(reports.select("doc_id"), "doc_id", "left_semi").persist()
        store.put("pages", pages, name)
        store.put("chunks", keyed(chunk_documents(pages, reports)), name)
        store.put("reports", reports, name)
        pages.unpersist()
        reports.unpersist()

    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(source)
    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
