"""The ledger as a stream: projections that every batch of events refreshes, and windows that allow for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.overlay import compacted, reduce_projection
from tessera.sources.files import read_snapshot, write_snapshot


def projection(events: DataFrame, record: str = "record") -> DataFrame:
    """The value in force of each record over a stream (output mode ``update`` or ``complete``).

    The order of events is instant, layer, id, and the highest layer wins: a late event of a lower layer refreshes the source
    pointer and leaves the value. Max-by states are of one row a record, whatever the number of its events; the
    adjustment pointer needs more than that and is in the snapshots of :func:`maintain_snapshot`.
    """
    key = F.struct("instant", "precedence", "event_id")
    top = F.max_by(F.struct("payload", "state", "version", "precedence"), F.struct("precedence", key))
    out = events.groupBy(record).agg(top.alias("_top"), F.max_by("event_id", F.when(F.col("precedence") == 1, key)).alias("source_event"), F.max_by("event_id", F.when(F.col("precedence") == 3, key)).alias("decision_event"), F.count("*").alias("n_events"))
    return out.select(record, "_top.payload", "_top.state", "_top.version", F.col("_top.precedence").alias("layer"), "source_event", "decision_event", "n_events")


def windowed_totals(events: DataFrame, instant: str, value: str, keys: list[str], size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, keys, n, total) by tumbling windows; events later than ``late`` after the newest are dropped."""
    by_window = events.withWatermark(instant, late).groupBy(F.window(instant, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by_window.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def maintain_snapshot(events: DataFrame, ledger: str, root: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to the ledger table, and write the projection of all events as the snapshot's next version.

    Beside the snapshot, ``<root>-events`` has the events that a later one may still need, so a batch reads these and its
    own events, never the ledger. A batch's number is its version, and a version counts once its write was completed: a batch
    that runs again after a failure changes nothing, or finishes what was begun.
    """

    def last(spark: SparkSession, folder: str) -> int:
        try:
            return read_snapshot(spark, folder)[1]
        except FileNotFoundError:  # no version so far
            return -1

    def step(batch: DataFrame, number: int) -> None:
        spark, needed = batch.sparkSession, f"{root}-events"
        batch.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        if last(spark, root) >= number:
            return
        if (held := last(spark, needed)) < number:
            # The events of batches that the last version lacks: this one's, or all where there is no version.
            fresh = spark.read.parquet(ledger).filter(F.col("batch").between(held + 1, number)).drop("batch")
            open_events = fresh if held < 0 else fresh.withColumn("n", F.lit(1).cast("long")).unionByName(read_snapshot(spark, needed, held)[0])
            write_snapshot(compacted(open_events), needed, number, again=True)
        kept = read_snapshot(spark, needed, number)[0]
        counts = kept.groupBy("record").agg(F.sum("n").alias("n_events"))
        write_snapshot(reduce_projection(kept).drop("n_events").join(counts, "record"), root, number, again=True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
