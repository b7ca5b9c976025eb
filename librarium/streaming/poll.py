"""Books parsed as they arrive: a file stream in small batches instead of a timer that polls a status column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from librarium.plans import segment


def parsed(texts: DataFrame, key: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """(key, index, title, words, images): chapters of texts with their statistics; failed texts give no rows."""
    bodies = segment.with_body(texts.select(key, text), key, text, pattern)
    content = segment.text_elements(F.col("body"), F.col("title"))
    rows = bodies.select(key, "index", "title", content.alias("_content"))
    return rows.select(key, "index", "title", segment.element_words(F.col("_content")).alias("words"), segment.element_images(F.col("_content")).alias("images"))


def statuses(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The state in which parsing leaves each book: completed, or failed without a text."""
    return texts.select(key, F.when(F.col(text).isNull(), "failed").otherwise("completed").alias("parse_status"))


# ---------------------------------------------------------------- states


def claim(books: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """Requested books that wait (pending or without a state, not parsed) become `parsing`; all others stay.

    A book asked for several times is taken up once, one that is being parsed or is done is not taken up again: the
    state is the lock, as the table is replaced as a whole.
    """
    hit = requests.select(key).distinct().withColumn("_hit", F.lit(True))
    waits = ~F.col("chapters_parsed") & (F.coalesce(F.col("parse_status"), F.lit("pending")) == "pending")
    out = books.join(hit, key, "left").withColumn("parse_status", F.when(F.col("_hit") & waits, F.lit("parsing")).otherwise(F.col("parse_status")))
    return out.select(books.columns)


def finish(books: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """Books in the state `parsing` become completed if documents came of them, else failed; all others stay.

    documents: the key of each document. To parse a book anew, `mutate.reset` it and claim it again.
    """
    done = documents.select(key).distinct().withColumn("_done", F.lit(True))
    mine, ok = F.col("parse_status") == "parsing", F.coalesce(F.col("_done"), F.lit(False))
    out = books.join(done, key, "left").withColumns({"parse_status": F.when(mine, F.when(ok, "completed").otherwise("failed")).otherwise(F.col("parse_status")), "chapters_parsed": F.when(mine & ok, F.lit(True)).otherwise(F.col("chapters_parsed"))})
    return out.select(books.columns)


def on_demand(requests: DataFrame, stored: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chapters of the requested texts: those that are stored are read, the others are parsed; `stored` says which.

    stored: chapters as `parsed` gives them. What was parsed can be appended to it; the result does not depend on how
    often or where it is asked for, so no lock is needed.
    """
    wanted = requests.select(key).distinct()
    have = stored.join(wanted, key, "left_semi").withColumn("stored", F.lit(True))
    missing = texts.select(key, text).join(wanted, key, "left_semi").join(stored.select(key).distinct(), key, "left_anti")
    return have.unionByName(parsed(missing, key, text).withColumn("stored", F.lit(False)))


# ---------------------------------------------------------------- streams


def parse_stream(
    spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, *, key: str = "doc_id", text: str = "text", files_per_batch: int = 5, every: str | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Parse the files that appear in a folder, `files_per_batch` at a time, into out/chapters and out/status.

    every: a time between batches ("60 seconds"); without it the stream takes what is there and ends. Each batch is
    written under its own number and replaced if the batch runs again after a failure, so nothing is lost or doubled.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        # the batch is under way: what a status page shows until its result replaces it
        batch.select(key, F.lit("parsing").alias("parse_status")).write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        parsed(batch, key, text).write.mode("overwrite").parquet(f"{out}/chapters/batch={number}")
        statuses(batch, key, text).write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        if on_batch:
            on_batch(batch, number)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def state(query: StreamingQuery) -> dict:
    """What a status page shows: whether the stream runs, and its last batch."""
    last = query.lastProgress
    return {"running": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}


def stop(query: StreamingQuery) -> None:
    query.stop()
    query.awaitTermination()
