"""Streams of tool payloads to an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ctxlake.operators.sessions import checked, extract_events, output_text, source_label
from ctxlake.operators.store import OFFLOAD_BYTES


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of JSON lines (session, ts, event, payload) that arrive in a folder."""
    return spark.readStream.schema("session string, ts long, event string, payload string").json(folder)


def dispatched(stream: DataFrame) -> DataFrame:
    """(session, ts, kind, summary) of a stream: what tools did, and a turn for each stop. Other events give nothing."""
    tools = extract_events(stream.where("event = 'PostToolUse'"))
    turns = stream.where("event = 'Stop'").select("session", "ts", F.lit("turn").alias("kind"), F.lit("turn ended").alias("summary"))
    return tools.unionByName(turns)


def offloaded(stream: DataFrame, threshold: int = OFFLOAD_BYTES) -> DataFrame:
    """(session, ts, source, content): outputs that are too large to be kept inline."""
    text = output_text(F.col("payload"))
    rows = stream.where("event = 'PostToolUse'").select("session", "ts", source_label(F.col("payload")).alias("source"), text.alias("content"))
    return rows.where(F.octet_length("content") > threshold)


def log_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's events to the log at ``path`` (read it with sources.exports.read_events). A batch writes a folder
    of its own number, so one that is run again after a failure writes the same place once."""

    def write(batch: DataFrame, number: int) -> None:
        good, _ = checked(dispatched(batch))
        rows = good.withColumn("seq", (F.lit(number).cast("long") * 2**40) + F.monotonically_increasing_id() % 2**40)
        rows.select("session", "seq", "ts", "kind", "summary").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
