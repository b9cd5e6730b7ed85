"""The scan checks on a stream: decode, judge and count per window.

Decoding is stateless. State is bounded by the watermark: repeated scans are dropped within
it and windows close behind it. Totals that are kept hold each micro-batch in a folder of its
own, so a batch that runs again after a loss replaces its rows instead of adding to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.operators import scans as N


def judge_scans(df: DataFrame) -> DataFrame:
    """Adds ``verdict``: valid, check digit mismatch, rejected or no article."""
    d = N.decode_article_scans(df)
    a = F.col("article")
    return d.withColumn(
        "verdict",
        F.when(a.isNotNull() & (a["type"] == "sscc"), "sscc")
        .when(a["checkDigit"] == a["expectedCheckDigit"], "valid")
        .when(a.isNotNull(), "check digit mismatch")
        .when(F.col("reject_reason").isNotNull(), "rejected").otherwise("no article"),
    )


def stream_audit(scans: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Verdict counts per time window, for a stream or a batch of scans with an event time ``ts``."""
    if scans.isStreaming:
        unique = scans.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["label_id", "scan_seq"])
    else:
        unique = scans.dropDuplicates(["label_id", "scan_seq"])
    judged = judge_scans(unique)
    return judged.groupBy(F.window("ts", window).alias("w"), "verdict").agg(F.count("*").alias("scans")).select(
        F.col("w.start").alias("window_start"), "verdict", "scans")


def run(scans: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 hour",
        window: str = "1 day"):
    """Starts the audit with a ``foreachBatch`` sink; the checkpoint lets it resume after a loss."""
    return (
        stream_audit(scans, delay, window).writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    )


# -- totals that are kept ---------------------------------------------------------------------

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_totals(scans: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Verdict counts per window of a stream or a batch; a scan delivered again counts once.

    A repeat has the label, number and event time of the first delivery, so stream and batch agree on it however far
    apart the two arrive within ``delay``. A scan later than ``delay`` behind the newest one is not counted by a stream."""
    keys = ["label_id", "scan_seq", "ts"]
    unique = (scans.withWatermark("ts", delay) if scans.isStreaming else scans).dropDuplicates(keys)
    return judge_scans(unique).groupBy(F.window("ts", window).alias("w"), "verdict").agg(F.count("*").alias("scans")).select(
        F.col("w.start").alias("window_start"), "verdict", "scans")


def batch_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that may run twice for one batch: it overwrites the folder of that batch."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def keep_totals(scans: DataFrame, folder: str, checkpoint: str, delay: str = "1 hour", window: str = "1 day"):
    """Starts the stream; every batch writes the new totals of the windows it touched. State lies on disk, so windows
    and repeats within ``delay`` may outgrow memory."""
    conf = scans.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ON_DISK)
    try:
        return (
            live_totals(scans, delay, window).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(batch_writer(folder)).trigger(availableNow=True).start()
        )
    finally:
        conf.set(STATE_STORE, before)


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The latest total of every window and verdict."""
    rows = spark.read.schema("window_start timestamp, verdict string, scans bigint, batch bigint").parquet(folder)
    return rows.groupBy("window_start", "verdict").agg(F.max_by("scans", "batch").alias("scans"))
