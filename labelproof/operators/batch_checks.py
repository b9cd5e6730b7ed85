"""Checks across the labels of a batch that the label specifications ask for.

All of them reduce with partial aggregates first, so one consignment number that owns a
third of the rows arrives at its reducer as one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REUSE_DAYS = 730
MAX_UNIT_TYPES = 12
SINGLE_ITEM_UNITS = ["SAT"]
SINGLE_ITEM_PRODUCTS = ["FPP", "FPA"]


def duplicate_consignments(df: DataFrame) -> DataFrame:
    """Consignment numbers used more than once: uses, customers, and reuse within two years.

    Input: consignment_id, customer_id, day (days since epoch). Uses are first folded into
    two-year buckets; two uses in one bucket are close by construction and only the edges of
    neighbouring buckets remain to compare."""
    day = F.col("day")
    buckets = df.groupBy("consignment_id", F.floor(day / REUSE_DAYS).alias("b")).agg(
        F.count("*").alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi"))
    w = Window.partitionBy("consignment_id").orderBy("b")
    near = buckets.withColumn("gap", F.col("lo") - F.lag("hi").over(w))
    reuse = near.groupBy("consignment_id").agg(
        F.sum("n").alias("uses"),
        F.bool_or((F.col("n") > 1) | (F.coalesce(F.col("gap"), F.lit(REUSE_DAYS)) < REUSE_DAYS)).alias("reused_in_2_years"),
    ).filter(F.col("uses") > 1)
    customers = df.groupBy("consignment_id", "customer_id").agg(F.lit(1).alias("one")).groupBy("consignment_id").agg(
        F.count("*").alias("customers"))
    return reuse.join(customers, "consignment_id")


def atl_consistency(df: DataFrame) -> DataFrame:
    """Consignments whose labels carry more than one ATL code. Input: connote, atl_number."""
    pairs = df.filter(F.col("atl_number").isNotNull()).groupBy("connote", "atl_number").agg(F.count("*").alias("n"))
    return pairs.groupBy("connote").agg(
        F.count("*").alias("codes"), F.sum("n").alias("labels"), F.min("atl_number").alias("first_code")
    ).filter(F.col("codes") > 1)


def unit_type_limit(df: DataFrame) -> DataFrame:
    """More than 12 unit types, or several items where only one is allowed.

    Input: connote, unit_type, product_code."""
    single = F.col("unit_type").isin(*SINGLE_ITEM_UNITS) | F.col("product_code").isin(*SINGLE_ITEM_PRODUCTS)
    units = df.groupBy("connote", "unit_type").agg(F.count("*").alias("n"), F.bool_or(single).alias("s"))
    out = units.groupBy("connote").agg(
        F.count("*").alias("unit_types"), F.sum("n").alias("items"), F.bool_or("s").alias("single_item"))
    return out.withColumns(
        {
            "too_many_types": F.col("unit_types") > MAX_UNIT_TYPES,
            "not_single": F.col("single_item") & (F.col("items") > 1),
        }
    ).filter("too_many_types or not_single")


def item_sequence(df: DataFrame) -> DataFrame:
    """Item numbers of a consignment against its stated quantity. Input: connote, item_no, quantity."""
    items = df.groupBy("connote", "item_no").agg(F.count("*").alias("n"), F.max("quantity").alias("q"))
    out = items.groupBy("connote").agg(
        F.sum("n").alias("labels"), F.count("*").alias("distinct_items"), F.max("item_no").alias("highest_item"),
        F.max("q").alias("quantity"), F.count_if(F.col("n") > 1).alias("repeated_items"))
    complete = (F.col("distinct_items") == F.col("quantity")) & (F.col("highest_item") == F.col("quantity"))
    return out.withColumn("complete", complete & (F.col("repeated_items") == 0))


def location_check(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Postcode, suburb and depot against a location table (postcode, suburb, depot).

    No broadcast hint: the location table is the caller's and Spark decides by its size."""
    loc = locations.select("postcode", "suburb", F.col("depot").alias("expected_depot"))
    joined = df.join(loc, ["postcode", "suburb"], "left")
    status = (
        F.when(F.col("expected_depot").isNull(), "unknown location")
        .when(F.col("expected_depot") == F.col("depot"), "match").otherwise("depot mismatch"))
    return joined.withColumn("location_status", status)
