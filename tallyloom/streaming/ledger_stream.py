"""The ledger as a stream: batches arrive, duplicates are refused for good, projections are rebuilt from the whole table.

Order in a ledger is causal, not temporal, so nothing is ever late and no watermark drops anything from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.conventions import ENTRY, convention_state
from tallyloom.operators.ledger import type_class


def batch_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Batch files as they arrive."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path)


def accept_batches(stream: DataFrame, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the events of batches (batch_id, submitted_at, events) whose id the ledger table doesn't hold.

    Events of a type that writers may not submit refuse their whole batch. A micro-batch that runs again finds its own batches in the
    table and appends nothing, so each batch is taken once. The table is the memory of ids: it has no horizon.
    """
    spark = stream.sparkSession

    def take(new: DataFrame, _: int) -> None:
        first = new.groupBy("batch_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "batch_id"]), "submitted_at").alias("b")).select("batch_id", "b.*")
        bad = F.exists("events", lambda e: type_class(e.event_type) != "writable")
        fine = first.filter(~F.coalesce(bad, F.lit(False)))
        try:
            known = spark.read.parquet(table_path).select("batch_id").distinct()
            fine = fine.join(known, "batch_id", "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fine.select("batch_id", "submitted_at", F.posexplode("events").alias("place", "event")).select("batch_id", "submitted_at", "place", "event.*").write.mode("append").parquet(table_path)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def convention_stream(log: DataFrame) -> DataFrame:
    """Entries after each micro-batch of a log (kind, token, pos, op, weight): state by (kind, token), kept without a horizon."""
    state = "origin string, weight long, support long, strain long, defeated boolean"
    return log.groupBy("kind", "token").applyInPandasWithState(convention_state, ENTRY, state, "update", "NoTimeout")


def rolling_counts(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in sliding windows; for event tables, which do have a clock."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
