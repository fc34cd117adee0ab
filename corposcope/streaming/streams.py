"""Structured Streaming: metrics, dedupe and status, with batch twins; ingestion by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposcope.functions.text import index_tokens, is_garbled
from corposcope.operators.structure import chunk_blocks
from corposcope.sources.corpus import blocks_of, build_postings, pages_of
from corposcope.sources.index import positions


def rolling_metrics(events: DataFrame) -> DataFrame:
    """Five-minute sums each minute by metric; the same expression for batch and stream."""
    w = F.window("ts", "5 minutes", "1 minute")
    return events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def stream_metrics(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event time; rows later than the watermark are dropped and counted in the query's progress."""
    return rolling_metrics(events.withWatermark("ts", late))


def stream_dedupe(items: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_status(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def ingest_batch(out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the blocks of new documents (doc_id, text), and a marker for each document.

    Both folders are named by the batch, so a repeated batch overwrites itself.
    Of several rows of a document in one batch the last by ``changed_at`` counts, or
    where that column is missing the one of the largest text.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        order = [F.col("changed_at")] if "changed_at" in batch.columns else []
        last = batch.groupBy("doc_id").agg(F.max_by("text", F.struct(*order, "text")).alias("text"))
        last.select("doc_id").write.mode("overwrite").parquet(f"{out}/changed/epoch={epoch}")
        blocks_of(last).write.mode("overwrite").parquet(f"{out}/blocks/epoch={epoch}")

    return write


def stream_ingest(documents: DataFrame, out: str, checkpoint: str):
    return documents.writeStream.foreachBatch(ingest_batch(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_blocks(spark: SparkSession, out: str) -> DataFrame:
    """Blocks of each document from the last batch that brought it; none where that one was empty."""
    newest = spark.read.parquet(f"{out}/changed").groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{out}/blocks").join(newest, ["doc_id", "epoch"]).drop("epoch")


def postings_batch(out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: postings of changed documents (doc_id, text; null text deletes) and a marker for each.

    Both folders are named by the batch, so a repeated batch overwrites itself.
    Of several rows of a document in one batch the last by ``changed_at`` counts.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by("text", F.struct("changed_at", "text")).alias("text"))
        last.select("doc_id").write.mode("overwrite").parquet(f"{out}/changed/epoch={epoch}")
        build_postings(last, "doc_id", index_tokens(F.col("text"))).write.mode("overwrite").parquet(f"{out}/postings/epoch={epoch}")

    return write


def stream_postings(changes: DataFrame, out: str, checkpoint: str):
    """An inverted index that follows inserts, updates and deletes."""
    return changes.writeStream.foreachBatch(postings_batch(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_postings(spark: SparkSession, out: str) -> DataFrame:
    """(token, doc_id, tf) of each document as last changed."""
    newest = spark.read.parquet(f"{out}/changed").groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{out}/postings").join(newest, ["doc_id", "epoch"]).select("token", "doc_id", "tf")


def ingested(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables of a batch of documents (doc_id, text, changed_at): pages, chunks, postings, changed and errors.

    A row without an id, without a text or with one that can't be read goes to ``errors`` with the
    reason, and the other documents go on. Of several good rows of a document the last by
    ``changed_at`` counts, of equals the largest text. A blank text is good, and leaves the document without rows.
    """
    error = F.when(F.col("doc_id").isNull(), "no id").when(F.col("text").isNull(), "no text").when((F.trim("text") != "") & is_garbled(F.col("text")), "unreadable text")
    marked = documents.select("doc_id", "text", "changed_at", error.alias("error"))
    last = marked.filter("error IS NULL").groupBy("doc_id").agg(F.max_by("text", F.struct("changed_at", "text")).alias("text"))
    return {
        "errors": marked.filter("error IS NOT NULL").select("doc_id", "changed_at", "error"),
        "changed": last.select("doc_id"),
        "pages": pages_of(last),
        "chunks": chunk_blocks(blocks_of(last)),
        "postings": positions(last.withColumnRenamed("doc_id", "row_id")).withColumnRenamed("row_id", "doc_id"),
    }


def library_batch(out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes every table of ``ingested`` to a folder of the batch.

    A batch that is repeated after a loss overwrites its own folders, so each table holds it once. ``changed`` comes
    last: a document counts as changed only when its other tables are whole.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            tables = ingested(kept)
            for name in ("errors", "pages", "chunks", "postings", "changed"):
                tables[name].write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        finally:
            kept.unpersist()

    return write


def stream_library(documents: DataFrame, out: str, checkpoint: str):
    """Documents as they come in, as pages, chunks and an index, with an error table for bad rows."""
    return documents.writeStream.foreachBatch(library_batch(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of a table (pages, chunks, postings) for each document from the last batch that brought a good version of it."""
    newest = spark.read.parquet(f"{out}/changed").groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{out}/{name}").join(newest, ["doc_id", "epoch"]).drop("epoch")
