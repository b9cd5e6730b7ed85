"""Scan-table jobs: standardise, classify, deduplicate and decode barcode scans.

Decodes are narrow projections. Only dedupe, distinct articles, reject lists and
diagnostics shuffle, and each of those combines on the map side first, so a label
that owns a large share of all scans does not land on one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions import codes as C
from labelproof.functions import refdata as R
from labelproof.functions import strings as S


def normalize_scans(df: DataFrame) -> DataFrame:
    return df.withColumn("normalized", C.normalize(F.col("raw_value"))).withColumn(
        "compact", F.replace(F.col("normalized"), F.lit("|"), F.lit(""))
    )


def strip_scans(df: DataFrame) -> DataFrame:
    return df.withColumn("stripped", C.strip(F.col("raw_value")))


# -- classification -----------------------------------------------------------


def looks_like_datamatrix(norm: Column, fmt: Column | None = None) -> Column:
    by_content = norm.contains("420") | norm.contains("8008") | norm.contains("|92")
    if fmt is None:
        return by_content
    return by_content | S.test(F.coalesce(fmt, F.lit("")), r"data[_\s-]?matrix", "i")


def classify_scans(df: DataFrame) -> DataFrame:
    """Adds is_datamatrix / is_qr / is_linear, the scan kind and the display name."""
    fmt = F.lower(F.coalesce(F.col("format"), F.lit("")))
    raw = F.coalesce(F.col("raw_value"), F.lit(""))
    kind = F.coalesce(F.col("kind"), F.lit(""))
    df = df.withColumns(
        {
            "is_datamatrix": fmt.contains("data") | raw.contains("(420)") | raw.contains("8008") | raw.contains("|420"),
            "is_qr": fmt.contains("qr") | (kind == "qr"),
        }
    )
    dm, qr = F.col("is_datamatrix"), F.col("is_qr")
    df = df.withColumn("is_linear", ~dm & ~qr & (fmt.contains("128") | (kind == "linear")))
    named = F.coalesce(S.blank_to_null(F.col("format")), F.lit("Barcode"))
    return df.withColumns(
        {
            "scan_kind": F.when(dm, "GS1 DataMatrix").when(qr, "QR Barcode")
            .when(F.col("is_linear"), "Linear Barcode").otherwise(named),
            "display_name": F.when(fmt.contains("data"), "GS1 DataMatrix").when(qr, "QR Barcode")
            .when(fmt.contains("128") | (kind == "linear"), "Linear / Code128")
            .otherwise(F.coalesce(S.blank_to_null(F.col("format")), F.lit("barcode"))),
        }
    )


def freight_role(v: Column) -> Column:
    return v.rlike(C.FREIGHT_ITEM) | v.rlike(C.SSCC_20)


def atl_role(v: Column) -> Column:
    return v.rlike(r"^C\d{9}\z")


def routing_role(v: Column) -> Column:
    plain = S.extract(v, r"^([A-Z0-9]{3})\d{4}[A-Z0-9]{2,3}$")
    gs1 = S.extract(v, r"^421036\d{4}403([A-Z0-9]{3})$")
    known = R.label_codes()
    return F.coalesce(plain.isin(*known), F.lit(False)) | F.coalesce(gs1.isin(*known), F.lit(False))


def scan_roles(df: DataFrame) -> DataFrame:
    """StarTrack role flags from the value's shape; routing needs a known label code."""
    df = df.withColumn("role_value", C.role_value(F.col("raw_value")))
    v = F.col("role_value")
    return df.withColumns(
        {"is_freight": freight_role(v), "is_atl": atl_role(v), "is_routing": routing_role(v)}
    )


# -- dedupe -------------------------------------------------------------------

BOX_COLUMNS = ["bounding_box", "page_bounding_box", "location_quality", "target_box", "bar_count"]
ORIGIN_COLUMNS = ["source", "region_label", "variant_label"]


def dedupe_scans(df: DataFrame) -> DataFrame:
    """One row per (label, format, value without white space).

    The earliest row wins; boxes, quality and bar count fill from the earliest row that
    has them; the origin triple follows the first row that proves a page position."""
    seq = F.col("scan_seq")
    keyed = df.filter(F.coalesce(F.col("raw_value"), F.lit("")) != "").withColumns(
        {
            "_format": F.coalesce(S.blank_to_null(F.col("format")), F.lit("unknown")),
            "_value": S.drop_white_space(F.col("raw_value")),
        }
    )
    fill = [c for c in BOX_COLUMNS if c in df.columns]
    origin = [c for c in ORIGIN_COLUMNS if c in df.columns] if "page_bounding_box" in df.columns else []
    keep = [c for c in df.columns if c not in {"label_id", *fill, *origin}]
    aggs = [F.min_by(F.struct(*keep, *origin), seq).alias("_first")]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c) for c in fill]
    if origin:
        boxed = F.when(F.col("page_bounding_box").isNotNull(), seq)
        aggs.append(F.min_by(F.when(boxed.isNotNull(), F.struct(*origin)), boxed).alias("_origin"))
    out = keyed.groupBy("label_id", "_format", "_value").agg(*aggs)
    cols = ["label_id"]
    cols += [S.trim(F.col("_first.raw_value")).alias(c) if c == "raw_value" else F.col(f"_first.{c}").alias(c) for c in keep]
    cols += fill
    cols += [
        F.when(F.col("_origin").isNotNull(), F.col(f"_origin.{c}")).otherwise(F.col(f"_first.{c}")).alias(c)
        for c in origin
    ]
    return out.select(*cols)


# -- decodes --------------------------------------------------------------------


def decode_article_scans(df: DataFrame) -> DataFrame:
    """Adds the parsed GS1 view of every scan and its article (or the reject reason)."""
    df = normalize_scans(df)
    n, c = F.col("normalized"), F.col("compact")
    gtin = c.startswith(C.GTIN_PREFIX)
    df = df.withColumns(
        {
            "symbology_type": F.when(c.rlike(C.SSCC_20), "GS1-128/SSCC")
            .when(n.contains("420") | n.contains("8008"), "GS1-DataMatrix-like").otherwise("GS1-128/Article-like"),
            "whole_sscc": c.rlike(C.SSCC_20),
            "has_ai01": F.when(~c.rlike(C.SSCC_20), c.startswith("01")),
            "has_gtin": F.when(~c.rlike(C.SSCC_20), gtin),
            "has_ai91": F.when(
                ~c.rlike(C.SSCC_20),
                F.when(gtin, F.substring(c, 17, 2) == "91").otherwise(c.contains("91")),
            ),
            "_source": F.when(c.rlike(C.SSCC_20), c).otherwise(C.article_source(n, c)),
        }
    )
    # staged so that each step is computed once: where it sits, cleaned, cut to its valid length
    df = df.withColumn("_clean", C.clean_article(F.col("_source")))
    bare = F.when(c.rlike(r"^[A-Z0-9]{10,30}\z"), c)
    df = df.withColumn("_clean", F.coalesce(S.blank_to_null(F.col("_clean")), bare))
    df = df.withColumn("article_candidate", C.trim_article(F.col("_clean"))).drop("_source", "_clean")
    df = C.with_article(df)
    return df.withColumn(
        "reject_reason",
        F.when(
            F.col("article_candidate").isNotNull() & F.col("article").isNull(),
            C.article_reject_reason(F.col("article_candidate")),
        ),
    )


def last_segment(norm: Column, ai: str, length: int) -> Column:
    """Value of the last separator-delimited segment that opens with ``ai``; null when none."""
    has = norm.rlike(rf"(?s)(^|\|){ai}")
    return F.when(has, F.regexp_extract(norm, rf"(?s)^(?:.*\|)?{ai}([^|]{{0,{length}}})", 1))


def decode_datamatrix_scans(df: DataFrame) -> DataFrame:
    """AI 420 / 92 / 8008 by segment, then by pattern on the joined string."""
    if "normalized" not in df.columns:
        df = normalize_scans(df)
    n, c = F.col("normalized"), F.col("compact")

    def ai(code: str, seg: int, digits: int) -> Column:
        return F.coalesce(last_segment(n, code, seg), S.extract(c, rf"{code}(\d{{{digits}}})"))

    df = df.withColumns(
        {
            "looks_datamatrix": looks_like_datamatrix(n),
            "dm_postcode": ai("420", 4, 4),
            "dm_dpid": ai("92", 8, 8),
            "dm_datetime": ai("8008", 12, 12),
        }
    )
    return df.withColumns(
        {
            "has_ai420": F.col("dm_postcode").isNotNull(),
            "has_ai92": F.col("dm_dpid").isNotNull(),
            "has_ai8008": F.col("dm_datetime").isNotNull(),
            "invalid_literal_separators": F.coalesce(F.col("raw_value"), F.lit("")).rlike(r"(?i)FNC1|_1|\$"),
        }
    )


def with_stripped(df: DataFrame) -> DataFrame:
    if "_stripped" in df.columns:
        return df
    df = df.withColumn("_stripped", C.strip(F.col("raw_value")))
    return df.withColumn("_bare", C.bare(F.col("_stripped")))


def decode_sscc_scans(df: DataFrame) -> DataFrame:
    return C.with_sscc(with_stripped(df)).withColumn(
        "sscc_reason",
        F.when(F.col("sscc").isNull(), F.lit("No AI 00 + 18 digit SSCC found.")).otherwise(F.col("sscc.reason")),
    )


def decode_freight_scans(df: DataFrame) -> DataFrame:
    bars = F.col("bar_count") if "bar_count" in df.columns else F.lit(None).cast("int")
    df = with_stripped(df)
    return df.withColumn("freight", C.freight(F.col("raw_value"), F.col("_bare"), bars)).withColumn(
        "freight_reason",
        F.when(F.col("freight").isNull(), F.lit("Not a StarTrack 20-character freight item barcode.")),
    )


def decode_routing_scans(df: DataFrame) -> DataFrame:
    # staged: the parts are found once, however often a struct or a reason names them
    df = with_stripped(df).withColumns({f"_route_{n}": c for n, c in C.routing_parts(F.col("_bare")).items()})
    parts = {n: F.col(f"_route_{n}") for n in ("gs1", "label")} | {"compact": F.col("_bare")}
    return df.withColumns(
        {"routing": C.routing(F.col("raw_value"), parts), "routing_reason": C.routing_reject_reason(parts)}
    ).drop("_route_gs1", "_route_label")


def decode_atl_scans(df: DataFrame) -> DataFrame:
    df = with_stripped(df)
    return df.withColumn("atl", C.atl(F.col("raw_value"), F.col("_bare"))).withColumn(
        "atl_reason", F.when(F.col("atl").isNull(), F.lit("Not a StarTrack ATL barcode."))
    )


def decode_qr_scans(df: DataFrame) -> DataFrame:
    df = df.withColumn("_qr_text", C.qr_text(F.col("raw_value")))
    return df.withColumn("qr", C.qr(F.col("raw_value"), F.col("_qr_text"))).drop("_qr_text").withColumn(
        "qr_reason", F.when(F.col("qr").isNull(), F.lit("Not a StarTrack fixed-width QR payload."))
    )


# -- per-label tables -------------------------------------------------------------


def present(decoded: DataFrame, column: str, *more: str) -> DataFrame:
    """Scans that have ``column``. A generator rather than a filter: Spark would push a filter
    below the staged decode and evaluate the decode once more inside the condition."""
    kept = decoded.select("label_id", "scan_seq", *more, F.explode_outer(F.array(column)).alias(column))
    return kept.filter(F.col(column).isNotNull())


def distinct_articles(decoded: DataFrame) -> DataFrame:
    """One row per (label, article id): first position kept, parsed fields attached."""
    return (
        present(decoded, "article")
        .groupBy("label_id", F.col("article.articleId").alias("article_id"))
        .agg(F.min("scan_seq").alias("first_seq"), F.max_by("article", "scan_seq").alias("article"))
    )


def invalid_candidates(decoded: DataFrame) -> DataFrame:
    """Reject table: candidates that could not be parsed, one row each per label, with the reason."""
    return (
        present(decoded, "reject_reason", "article_candidate")
        .groupBy("label_id", F.col("article_candidate").alias("candidate"))
        .agg(F.min("scan_seq").alias("first_seq"), F.max_by("reject_reason", "scan_seq").alias("reason"))
    )


EXPECTED_SCANS = {"eparcel": 2, "startrack": 3}


def additional_scans(df: DataFrame, carrier: str = "eparcel") -> DataFrame:
    """Scans beyond the expected number that fit no required role.

    Counts are aggregated before the shuffle and only the few candidate rows are joined,
    so the whole scan table is never windowed by label."""
    busy = df.groupBy("label_id").agg(F.count("*").alias("n")).filter(F.col("n") > EXPECTED_SCANS[carrier])
    c = scan_roles(classify_scans(df))
    raw = F.coalesce(F.col("raw_value"), F.lit(""))
    compact = S.drop_white_space(raw)
    wanted = (raw != "") & F.col("is_linear") & ~compact.rlike(r"^(\]C1)?\(?00\)?\d{18}\z")
    if carrier == "startrack":
        wanted = wanted & ~F.col("is_routing") & ~F.col("is_atl") & ~F.col("is_freight")
    else:
        wanted = wanted & ~compact.rlike(r"^(\]C1)?\(?01\)?")
    return c.filter(wanted).join(busy.select("label_id"), "label_id", "left_semi").select(*df.columns, "display_name")


SLOW_SCAN_MS = 1000


def scan_diagnostics_summary(df: DataFrame) -> DataFrame:
    """Decode counts, skips and durations by label, kind and target."""
    d = F.col("duration_ms")
    return df.groupBy("label_id", "kind", "target").agg(
        F.count("*").alias("scans"),
        F.sum("decoded_count").alias("decoded"),
        F.count_if(F.col("skipped")).alias("skipped"),
        F.sum(d).alias("total_ms"),
        F.max(d).alias("max_ms"),
        F.count_if(d >= SLOW_SCAN_MS).alias("slow_scans"),
    )


def verify_check_digits(df: DataFrame) -> DataFrame:
    """Whole-table check of ``kind`` sscc/article values in ``value``: expected, actual, valid."""
    v = F.upper(F.col("value"))
    sscc = F.col("kind") == "sscc"
    # SSCC: the 17 digits before the check digit; article: letters become digits first
    digits = F.when(sscc, F.right(F.regexp_replace(v, r"\D", ""), F.lit(18))).otherwise(C.to_digits(v))
    df = df.withColumn("_digits", F.substring(digits, F.lit(1), F.length(digits) - 1))
    df = df.withColumns({"expected": C.check_digit_any(F.col("_digits")), "actual": F.right(v, F.lit(1))}).drop("_digits")
    return df.withColumn("valid", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))
