"""Page events of running conversions: the same rules for a stream and for a table.

The latest event of a page counts, by sequence number and not by arrival, so
that repeated and reordered events change nothing. On a stream the state is one
struct for each (document, page), kept by Spark's own aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ndjson import EVENT, parsed

KEY = ("doc_id", "page_no")


def latest(events: DataFrame) -> DataFrame:
    """doc_id, page_no, seq, status, duration, warning: the last event of each page; works on streams in update or complete mode."""
    has = events.columns
    warning = F.col("warning") if "warning" in has else F.lit(None).cast("string")
    last = F.max_by(F.struct("seq", "status", "duration", warning.alias("warning")), "seq")
    # a success clears what was wrong before
    out = events.groupBy(*KEY).agg(last.alias("e")).select(*KEY, "e.*")
    return out.withColumn("warning", F.when(F.col("status") != "done", F.coalesce("warning", F.lit("failed"))))


def progress(state: DataFrame, total: int | None = None) -> DataFrame:
    """doc_id, done, failed, mean_seconds, left_seconds."""
    s = state.groupBy("doc_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(F.when(F.col("duration") > 0, F.col("duration"))).alias("mean"))
    left = F.greatest(F.lit(total or 0) - F.col("done"), F.lit(0))
    return s.select("doc_id", "done", "failed", F.round("mean", 9).alias("mean_seconds"), F.when(F.lit(total is not None) & F.col("mean").isNotNull(), F.ceil(left * F.round("mean", 9))).cast("long").alias("left_seconds"))


def worklist(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages that a run that starts again has to do: all but those done."""
    return pages.join(state.filter("status = 'done'"), list(KEY), "left_anti")


def usable_state(state: DataFrame, key: str, total: int, scale: float) -> DataFrame:
    """State of an earlier run (with state_key, total, scale): another key makes it void; without a key total and scale must agree."""
    same = F.when(F.col("state_key").isNotNull(), F.col("state_key") == key).otherwise((F.col("total") == total) & (F.col("scale") == scale))
    return state.filter(same)


def lost(state: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that count as done and have no text."""
    return state.filter("status = 'done'").join(pages, list(KEY), "left_anti").select(*KEY)


def outcome(cancelled, timeout, ok, fatal):
    """How a run ended; the first that holds counts."""
    return F.when(cancelled, "cancelled").when(timeout, "E_OCR_TIMEOUT").when(ok, "ok").when(fatal, "E_OCR_RUN").otherwise("crashed")


def formula_failures(events: DataFrame) -> DataFrame:
    """doc_id, failures, first: how many, and what the first said. events: seq, failures, message."""
    hit = events.filter("failures > 0")
    return hit.groupBy("doc_id").agg(F.sum("failures").alias("failures"), F.min_by("message", "seq").alias("first"))


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """Lines of JSON that land in a folder, as events; damaged lines are passed over."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "line")
    return parsed(lines)


def upsert(events: DataFrame, table: str, checkpoint: str):
    """A running query that keeps latest() as the in-memory table ``table``; production sinks take foreachBatch."""
    state = latest(events)
    return state.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()


def cleaned(events: DataFrame) -> DataFrame:
    """Events whose md has wrapped lines joined and injected spaces taken out, fenced stretches left; stateless, so it stands before the state."""
    from ..functions import cjk

    return events.withColumn("md", cjk.clean_text(F.col("md")))


def upsert_files(events: DataFrame, folder: str, checkpoint: str):
    """A running query that adds each batch's events to ``folder`` as Parquet; state(folder) is their latest().

    Nothing goes through the driver, and Spark's file sink writes each batch once, whatever is lost on the way.
    """
    return events.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).start()


def state(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The latest event of each page of a folder that upsert_files() writes."""
    return latest(spark.read.schema(schema).parquet(folder))


__all__ = ["EVENT", "KEY", "cleaned", "formula_failures", "latest", "lost", "outcome", "progress", "read_stream", "state", "upsert_files", "upsert", "usable_state", "worklist"]
