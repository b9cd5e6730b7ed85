"""Which labels enter an audit, and why the others do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The limits of one interactive batch; a bulk audit has no limit of files.
MAX_FILES_PER_BATCH = 20
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_PAYLOAD_CHARS = 500_000
MAX_PAGES = 40
MAX_PIXELS = 50_000_000


def with_admission(df: DataFrame, payload_col: str | None = None, max_files: int | None = None) -> DataFrame:
    """Adds ``reject_reason`` (null = admitted).

    With ``max_files``, a per-batch limit keeps the first files of a batch. It is found without windowing whole
    batches: each task keeps only its own lowest candidates, so a batch that holds a third of
    all labels sends a handful of rows per task, not its labels."""
    name, kind = F.lower(F.coalesce("filename", F.lit(""))), F.lower(F.coalesce("file_type", F.lit("")))
    supported = (kind == "application/pdf") | kind.startswith("image/") | name.rlike(r"\.(pdf|png|jpe?g|webp|bmp)\z")
    pixels = F.coalesce(F.col("pixel_width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("pixel_height"), F.lit(0))
    reason = (
        F.when(~supported, "unsupported file type")
        .when(F.col("file_bytes") > MAX_FILE_BYTES, "file too large")
        .when(F.col("page_count") > MAX_PAGES, "too many pages")
        .when(pixels > MAX_PIXELS, "image too large")
    )
    if payload_col:
        reason = reason.when(F.length(payload_col) > MAX_PAYLOAD_CHARS, "payload too long")
    df = df.withColumn("reject_reason", reason.otherwise(F.lit(None).cast("string")))
    if max_files is None:
        return df
    # the limit-th smallest label id of each batch, by a bounded top-k that merges partial lists
    salted = (
        df.filter("reject_reason is null")
        .select("batch_id", "label_id", F.pmod(F.xxhash64("label_id"), F.lit(64)).alias("_salt"))
    )
    rank = F.row_number().over(Window.partitionBy("batch_id", "_salt").orderBy("label_id"))
    few = salted.withColumn("_r", rank).filter(F.col("_r") <= max_files).drop("_r", "_salt")
    top = F.row_number().over(Window.partitionBy("batch_id").orderBy("label_id"))
    cut = few.withColumn("_r", top).filter(F.col("_r") == max_files).select("batch_id", F.col("label_id").alias("_last"))
    over = F.col("reject_reason").isNull() & (F.col("label_id") > F.col("_last"))
    return df.join(cut, "batch_id", "left").withColumn(
        "reject_reason", F.when(over, "beyond batch file limit").otherwise(F.col("reject_reason"))
    ).drop("_last")


def admit_labels(df: DataFrame, payload_col: str | None = None, max_files: int | None = None):
    """(accepted, rejected) label tables; every rejected row carries its reason."""
    marked = with_admission(df, payload_col, max_files)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")
