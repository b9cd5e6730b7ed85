"""Assembles one evidence row per label: page, text, barcodes, articles and derived lists.

Labels and scans are each hashed once on ``label_id``. Raw scans (tens of bytes) cross the
network, not their decoded form; decoding runs after the exchange and the per-label
gathering and the join reuse the same partitioning.

Every scan of a label takes part, whatever its ``scan_seq``; scans without one come first.
Decoding runs on scan rows before they are gathered.

A gathered list and a struct that several steps read are opaque to the optimizer, so an audit that reads a part of the
evidence says so (``reads``): parts of scans and facts that no column it reads comes from are left out, not derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions import strings as S
from labelproof.operators import label_text as X
from labelproof.operators import scans as N

ASSUMED_SHORT_EDGE_MM = 100


# -- page -----------------------------------------------------------------------------


def page_context(df: DataFrame) -> DataFrame:
    """Adds the ``page`` struct: sizes, raster flag and the DPI estimate of raster images."""
    pw, ph = (F.nullif(F.col(c), F.lit(0)) for c in ("pixel_width", "pixel_height"))
    raster = F.coalesce(pw.isNotNull() & (F.coalesce(F.col("width_mm"), F.lit(0.0)) == 0), F.lit(False))
    dpi = F.floor(F.least(pw, ph) / F.lit(ASSUMED_SHORT_EDGE_MM / 25.4) + 0.5).cast("int")
    return df.withColumn(
        "page",
        F.struct(
            F.col("width_mm").alias("widthMm"), F.col("height_mm").alias("heightMm"),
            F.coalesce(F.nullif(F.col("page_count"), F.lit(0)), F.lit(1)).alias("pageCount"),
            pw.alias("pixelWidth"), ph.alias("pixelHeight"), raster.alias("isRasterImage"),
            F.when(raster & pw.isNotNull() & ph.isNotNull(), dpi).alias("estimatedDpi"),
        ),
    )


# -- SSCC options -----------------------------------------------------------------------


def sscc_expectation(df: DataFrame) -> DataFrame:
    """Adds ``expected_sscc``: usable company prefix and extension digit, or why they are not."""
    raw_p = S.trim(F.coalesce(F.col("sscc_company_prefix"), F.lit("")))
    raw_e = S.trim(F.coalesce(F.col("sscc_extension_digit"), F.lit("")))
    dp, de = F.regexp_replace(raw_p, r"\D", ""), F.regexp_replace(raw_e, r"\D", "")
    ext = F.when(de.startswith("00"), F.substring(de, 3, 1)).otherwise(F.left(de, F.lit(1)))
    ext = F.when(raw_e != "", ext).otherwise("")
    ext_reason = F.when((raw_e != "") & (ext == ""), "Enter the SSCC extension digit, for example 3 or 003.").otherwise("")
    prefix = F.when(dp.startswith("00"), F.substr(dp, F.lit(4))).otherwise(dp)
    bad_length = (F.length(prefix) < 4) | (F.length(prefix) > 12)
    reason = (
        F.when(raw_p == "", ext_reason)
        .when(prefix == "", "Enter the GS1 Company Prefix digits, for example 9315345.")
        .when(bad_length, "GS1 Company Prefix should usually be 4 to 12 digits.")
        .otherwise(ext_reason)
    )
    return df.withColumn(
        "expected_sscc",
        F.struct(
            (label_format() == "sscc").alias("provided"),
            F.when((raw_p == "") & (raw_e == ""), "").otherwise(raw_p).alias("raw"),
            F.when((raw_p != "") & (prefix == ""), "").otherwise(ext).alias("extensionDigit"),
            F.when(raw_p == "", "").otherwise(prefix).alias("companyPrefix"),
            reason.alias("reason"),
        ),
    )


def label_format() -> Column:
    return F.when(F.col("label_format") == "sscc", "sscc").otherwise("standard")


# -- what a column is derived from ----------------------------------------------------

#: Evidence column, or a field of one -> parts of a scan, facts. Columns that are not named here need neither.
NEEDS: dict[str, dict[str, tuple[set[str], set[str]]]] = {
    "eparcel": {
        "barcodes.linearPresent": ({"linear_evidence"}, set()),
        "barcodes.dataMatrixPresent": ({"dm_evidence"}, set()),
        "barcodes.gs1": ({"gs1", "is_linear_parse", "is_dm"}, set()),
        "barcodes.datamatrix": ({"is_dm", "dm"}, set()),
        "barcodes.sscc": ({"sscc"}, set()),
        "articles": ({"article"}, set()),
        "derived.linearArticleIds": ({"is_linear_parse", "article"}, set()),
        "derived.dmArticleIds": ({"is_dm", "article"}, set()),
        "derived.invalidArticleReasons": ({"reject"}, set()),
        "derived.invalidSsccReasons": ({"sscc"}, set()),
        "detected": ({"article", "sscc", "is_dm"}, set()),
        "variant": ({"article"}, {"labelType"}),
        "invalid_candidates": ({"reject"}, set()),
    },
    "startrack": {
        "facts.labelCode": ({"qr", "freight", "routing"}, set()),
        "facts.connoteNumber": ({"qr", "freight"}, set()),
        "facts.consignmentIds": ({"qr", "freight"}, set()),
        "facts.articleIds": ({"qr", "freight", "sscc"}, set()),
        "facts.weightKg": ({"qr"}, set()),
        "facts.cube": ({"qr"}, set()),
        "facts.unit": ({"qr"}, set()),
        "facts.toBlock": ({"qr"}, set()),
        "facts.postcodeLines": ({"qr"}, set()),
        "facts.decodedDataUsedForFacts": ({"qr", "freight", "routing", "sscc"}, set()),
        "barcodes.qrPresent": ({"qr"}, set()),
        "barcodes.freightPresent": ({"freight"}, set()),
        "barcodes.routingPresent": ({"routing"}, set()),
        "barcodes.qr": ({"qr"}, set()),
        "barcodes.freight": ({"freight"}, set()),
        "barcodes.routing": ({"routing"}, set()),
        "barcodes.atl": ({"atl"}, set()),
        "barcodes.sscc": ({"sscc"}, set()),
        "derived.qrPostcodes": ({"qr"}, set()),
        "derived.freightConnotes": ({"freight"}, set()),
        "derived.freightIds": ({"freight"}, set()),
        "derived.primaryProductCode": ({"freight", "qr"}, set()),
        "derived.expectedAtlNumbers": ({"qr"}, {"visibleAtlNumbers"}),
        "derived.atlExpected": ({"qr"}, {"visibleAtlNumbers", "authorityToLeavePresent"}),
        "derived.invalidSsccReasons": ({"sscc"}, set()),
        "derived.receiverEvidence": ({"qr"}, {"toBlock", "postcodeLines"}),
        "detected": ({"qr", "freight", "routing", "atl", "sscc"}, set()),
        "variant": ({"qr", "freight", "routing"}, {"labelCode"}),
        "sscc_only": ({"sscc", "freight"}, set()),
    },
}
#: Facts that come from the text lines by way of each other, or that scans fill in from each other.
TOGETHER = {"connoteNumber", "consignmentIds"}


def needs(carrier: str, reads: tuple[str, ...] | None) -> tuple[set[str] | None, set[str] | None]:
    """Parts of scans and facts that the columns ``reads`` come from; None for all."""
    if reads is None or "text" in reads or "visible_facts" in reads:
        return None, None
    table = NEEDS[carrier]
    parts, facts = set(), set()
    for name in reads:
        parent, _, field = name.partition(".")
        # a whole column needs what each of its fields does, a field what its column does as a whole
        found = [v for n, v in table.items() if n in (name, parent) or n.startswith(f"{name}.")]
        parts = parts.union(*[p for p, _ in found])
        facts = facts.union(*[f for _, f in found], {field} if parent == "facts" and field else set())
    if TOGETHER & facts:
        facts |= TOGETHER
    return parts, None if "facts" in reads else facts


def fields_read(name: str, reads: tuple[str, ...] | None) -> set[str] | None:
    """The fields of a column that are read; None for all."""
    return None if reads is None or name in reads else {r.partition(".")[2] for r in reads if r.startswith(f"{name}.")}


def read_parts(df: DataFrame, reads: tuple[str, ...] | None) -> DataFrame:
    """Of the columns that scans and text give, those that are read, or structs of those of their fields that are: to read
    another is an error, never a null."""
    if reads is None:
        return df
    out = []
    for c in df.columns:
        fields = [r.partition(".")[2] for r in reads if r.startswith(f"{c}.")]
        if c in reads or c in ALWAYS:
            out.append(F.col(c))
        elif fields:
            out.append(F.struct(*[F.col(f"{c}.{n}").alias(n) for n in fields]).alias(c))
    return df.select(*out)


# -- gathering scans ------------------------------------------------------------------


def decode_for(df: DataFrame, carrier: str, parts: set[str] | None = None) -> DataFrame:
    """Raw scans -> (label_id, item): everything the evidence needs from one scan; with ``parts``, the others are null."""
    if parts is not None:
        parts = parts | {"scan_seq", "raw"}
    raw = F.coalesce(F.col("raw_value"), F.lit(""))
    fmt, kind = F.coalesce(F.col("format"), F.lit("")), F.coalesce(F.col("kind"), F.lit(""))
    filled = raw != ""
    if carrier == "startrack":
        linear = filled & (fmt.rlike("(?i)128|code") | (kind == "linear"))
        qr_like = filled & (fmt.rlike("(?i)qr") | (kind == "qr"))
        for decode in (N.decode_sscc_scans, N.decode_freight_scans, N.decode_routing_scans, N.decode_atl_scans,
                       N.decode_qr_scans):
            df = decode(df)
        item = {
            "scan_seq": F.col("scan_seq"), "raw": raw,
            "sscc": F.when(filled, F.col("sscc")), "freight": F.when(linear, F.col("freight")),
            "routing": F.when(linear, F.col("routing")), "atl": F.when(linear, F.col("atl")),
            "qr": F.when(qr_like, F.col("qr")),
        }
        return df.select("label_id", S.struct_of(df, item, parts).alias("item"))
    df = N.decode_sscc_scans(N.decode_datamatrix_scans(N.decode_article_scans(df)))
    is_dm = filled & F.col("looks_datamatrix")
    gs1 = F.struct(
        raw.alias("raw"), F.col("compact"), F.left("compact", F.lit(16)).alias("prefix16"),
        F.coalesce("has_ai01", F.lit(False)).alias("hasAi01"), F.coalesce("has_ai91", F.lit(False)).alias("hasAi91"),
        F.coalesce("has_gtin", F.lit(False)).alias("hasAusPostGtin"),
    )
    dm = F.struct(
        raw.alias("raw"), "normalized", "compact", F.col("has_ai420").alias("hasAi420"),
        F.col("dm_postcode").alias("postcode"), F.col("has_ai92").alias("hasAi92"), F.col("dm_dpid").alias("dpid"),
        F.col("has_ai8008").alias("hasAi8008"), F.col("dm_datetime").alias("dateTime"),
        F.col("invalid_literal_separators").alias("invalidLiteralSeparators"),
    )
    reject = F.struct(F.col("article_candidate").alias("candidate"), F.col("reject_reason").alias("reason"))
    item = {
        "scan_seq": F.col("scan_seq"), "raw": raw,
        "linear_evidence": fmt.rlike(r"(?i)code[_\s-]?128|gs1") | F.coalesce("has_ai91", F.lit(False)),
        "dm_evidence": N.looks_like_datamatrix(F.col("normalized"), F.col("format")),
        "gs1": F.when(filled & (is_dm | ~F.col("whole_sscc")), gs1),
        "is_linear_parse": filled & ~is_dm & ~F.col("whole_sscc"),
        "is_dm": is_dm,
        "dm": F.when(is_dm, dm),
        "article": F.when(filled, F.col("article")),
        "reject": F.when(filled & F.col("reject_reason").isNotNull(), reject),
        "sscc": F.when(filled, F.col("sscc")),
    }
    return df.select("label_id", S.struct_of(df, item, parts).alias("item"))


def gather(scans: DataFrame, carrier: str, parts: set[str] | None = None) -> DataFrame:
    """(label_id, items): all of a label's scans in reading order."""
    cols = ["label_id", "scan_seq", "raw_value", "format", "kind"] + (["bar_count"] if carrier == "startrack" else [])
    # sorted while narrow: decoding keeps the order, so that gathering and the join never sort (and spill) decoded rows
    narrow = scans.select(*cols).repartition("label_id").sortWithinPartitions("label_id")
    decoded = decode_for(narrow, carrier, parts)
    return decoded.groupBy("label_id").agg(F.array_sort(F.collect_list("item")).alias("items"))


def pick(items: Column, field: str) -> Column:
    return F.filter(F.transform(items, lambda s: s[field]), lambda v: v.isNotNull())


def strings(arr: Column, field: str) -> Column:
    return F.filter(F.transform(arr, lambda v: v[field]), lambda v: v.isNotNull())


# -- evidence ---------------------------------------------------------------------------


def _labels(labels: DataFrame, carrier: str) -> DataFrame:
    df = labels.filter(F.col("carrier") == carrier)
    df = sscc_expectation(page_context(df))
    return df.withColumn("selected", F.struct(F.lit(carrier).alias("carrier"), label_format().alias("format")))


HEAD = ["label_id", "batch_id", "selected", "expected_sscc", "page"]
ALWAYS = {*HEAD, "filename", "source_page", "payload_id", "carrier"}


def joined(labels: DataFrame, scans: DataFrame, carrier: str, reads: tuple[str, ...] | None = None) -> tuple[DataFrame, list[str]]:
    """Label rows with facts and scans. Raw text crosses the exchange and is sorted for the join with the gathered scans;
    facts, which are several times as wide, are derived after the join."""
    parts, only = needs(carrier, reads)
    keep = [c for c in ("filename", "source_page", "payload_id") if c in labels.columns]
    lab = _labels(labels, carrier).select(*HEAD, *keep, "extracted_text", "linear_visible", "datamatrix_visible")
    df = lab.repartition("label_id").join(gather(scans, carrier, parts), "label_id", "left")
    if carrier == "startrack":
        names = S.test(F.coalesce("extracted_text", F.lit("")), r"STAR\s*TRACK|STARTRACK", "i")
        df = X.startrack_facts(df.withColumn("text_names_carrier", names), only=only)
    else:
        df = X.eparcel_facts(df, only=only)
    df = df.drop("extracted_text")
    return df.withColumn("items", F.coalesce("items", F.array().cast(df.schema["items"].dataType))), keep


def eparcel_evidence(labels: DataFrame, scans: DataFrame, reads: tuple[str, ...] | None = None) -> DataFrame:
    return read_parts(eparcel_columns(*joined(labels, scans, "eparcel", reads), reads), reads)


def eparcel_columns(df: DataFrame, keep: list[str], reads: tuple[str, ...] | None = None) -> DataFrame:
    items, facts = F.col("items"), F.col("facts")
    linear = F.filter(items, lambda s: s["is_linear_parse"])
    dms = F.filter(items, lambda s: s["is_dm"])
    df = df.withColumns(
        {
            "_linear": linear,
            "_dm": dms,
            "_all_articles": F.array_distinct(pick(items, "article")),
            "_ssccs": pick(items, "sscc"),
            "invalid_candidates": F.array_distinct(pick(items, "reject")),
        }
    )
    wanted = F.when(F.col("selected.format") == "sscc", "sscc").otherwise("eparcel-standard")
    df = df.withColumns(
        {
            "articles": F.filter(F.col("_all_articles"), lambda a: a["type"] == wanted),
            "_standard": F.filter(F.col("_all_articles"), lambda a: a["type"] == "eparcel-standard"),
            "_valid": F.filter(F.col("_ssccs"), lambda s: s["valid"]),
            "_invalid": F.filter(F.col("_ssccs"), lambda s: ~s["valid"]),
        }
    )
    to, frm = facts["toBlock"], facts["fromBlock"]
    text = F.struct(
        *[facts[n].alias(n) for n in df.schema["facts"].dataType.names if n != "dgBlock"],
        X.last_address_line(to).alias("toLastLine"), X.last_address_line(frm).alias("fromLastLine"),
        X.postcodes4(facts["postcodeLines"], to).alias("postcodes4"),
        F.when(facts["dateCodeMMDD"].isNotNull(), F.array(facts["dateCodeMMDD"]))
        .otherwise(F.array().cast("array<string>")).alias("labelDates"),
        facts["dangerousGoodsDeclarationPresent"].alias("dgPresent"),
        F.array_join(facts["dgBlock"], "\n").alias("dgBlock"),
    )
    barcodes = [
        F.exists(items, lambda s: s["linear_evidence"]).alias("linearPresent"),
        F.exists(items, lambda s: s["dm_evidence"]).alias("dataMatrixPresent"),
        F.coalesce("linear_visible", F.lit(False)).alias("linearVisible"),
        F.coalesce("datamatrix_visible", F.lit(False)).alias("dataMatrixVisible"),
        F.concat(F.transform("_linear", lambda s: s["gs1"]), F.transform("_dm", lambda s: s["gs1"])).alias("gs1"),
        F.transform("_dm", lambda s: s["dm"]).alias("datamatrix"),
        F.struct(F.col("_valid").alias("valid"), F.col("_invalid").alias("invalid")).alias("sscc"),
    ]
    ids = lambda arr: F.transform(pick(arr, "article"), lambda a: a["articleId"])
    derived = [
        ids(F.col("_linear")).alias("linearArticleIds"),
        ids(F.col("_dm")).alias("dmArticleIds"),
        F.array_join(F.transform("invalid_candidates", lambda a: F.concat(a["candidate"], F.lit(": "), a["reason"])), "\n")
        .alias("invalidArticleReasons"),
        F.array_join(F.transform("_invalid", lambda s: s["reason"]), "\n").alias("invalidSsccReasons"),
    ]
    has_std, has_sscc, has_dm = F.size("_standard") > 0, F.size("_valid") > 0, F.size("_dm") > 0
    mode = [
        F.when(has_std | has_dm | has_sscc, "eparcel").otherwise("unknown").alias("carrier"),
        F.when(has_std, "standard").when(has_sscc, "sscc").otherwise("unknown").alias("format"),
        F.coalesce(
            S.blank_to_null(F.concat_ws(
                "\n",
                F.when(has_std, F.concat(F.lit("standard eParcel article(s): "),
                                         F.array_join(F.transform("_standard", lambda a: a["articleId"]), ", "))),
                F.when(has_sscc, F.concat(F.lit("SSCC barcode(s): "),
                                          F.array_join(F.transform("_valid", lambda s: s["articleId"]), ", "))),
                F.when(has_dm, F.concat(F.lit("GS1 DataMatrix parse(s): "), F.size("_dm").cast("string"))),
            )),
            F.array_join(F.filter(F.transform(items, lambda s: s["raw"]), lambda v: v != ""), "\n"),
        ).alias("evidence"),
    ]
    product = lambda *codes: F.exists("_standard_in", lambda a: a["productCode"].isin(*codes))
    df = df.withColumn("_standard_in", F.filter("articles", lambda a: a["type"] == "eparcel-standard"))
    kind = F.coalesce(facts["labelType"], F.lit(""))
    variant = (
        F.when(F.col("selected.format") == "sscc", "sscc")
        .when(product("00065", "00068"), "returns")
        .when(product("00096", "00087"), "express-post")
        .when(F.size("_standard_in") > 0, "parcel-post")
        .when(kind.rlike("(?i)express"), "express-post")
        .when(kind.rlike("(?i)parcel"), "parcel-post")
        .otherwise("base")
    )
    part = lambda name, cols: S.struct_of(df, cols, fields_read(name, reads)).alias(name)
    return df.select(
        *HEAD, *keep, F.lit("eparcel").alias("carrier"), "facts", text.alias("text"), part("barcodes", barcodes), "articles",
        part("derived", derived), part("detected", mode), variant.alias("variant"), "invalid_candidates",
        F.size(F.filter(items, lambda s: s["raw"] != "")).alias("scan_count"),
    )


def startrack_evidence(labels: DataFrame, scans: DataFrame, reads: tuple[str, ...] | None = None) -> DataFrame:
    return read_parts(startrack_columns(*joined(labels, scans, "startrack", reads), reads), reads)


def startrack_columns(df: DataFrame, keep: list[str], reads: tuple[str, ...] | None = None) -> DataFrame:
    items = F.col("items")
    df = df.withColumns({f"_{n}": pick(items, n) for n in ("qr", "freight", "routing", "atl", "sscc")})
    df = df.withColumns(
        {
            "_valid": F.filter("_sscc", lambda s: s["valid"]),
            "_invalid": F.filter("_sscc", lambda s: ~s["valid"]),
            "visible_facts": F.col("facts"),
        }
    )
    enriched = X.enrich_facts(F.col("facts"), F.col("_qr"), F.col("_freight"), F.col("_routing"), F.col("_valid"))
    df = df.withColumn("facts", S.struct_of(df, enriched, needs("startrack", reads)[1]))
    df = df.withColumn(
        "_atls",
        S.unique_non_empty(F.concat(F.col("facts.visibleAtlNumbers"), F.transform("_qr", lambda q: q["fields"]["atlNumber"]))),
    )
    facts, qr, freight, routing, valid = (F.col(c) for c in ("facts", "_qr", "_freight", "_routing", "_valid"))
    lines = facts["lines"]
    text = F.struct(
        *[facts[n].alias(n) for n in df.schema["facts"].dataType.names],
        F.exists(lines, lambda v: S.test(v, r"STAR\s*TRACK|STARTRACK", "i")).alias("hasStarTrackHeader"),
        S.trim(F.regexp_extract(F.array_join(lines, "\n"), S.rx(r"\*\s*(RETURN|TRANSFER)\s*\*", "i"), 0))
        .alias("returnTransferIndicator"),
    )
    some = lambda c: F.size(c) > 0
    barcodes = [
        some(qr).alias("qrPresent"), some(freight).alias("freightPresent"), some(routing).alias("routingPresent"),
        F.coalesce("linear_visible", F.lit(False)).alias("linearVisible"),
        F.coalesce("datamatrix_visible", F.lit(False)).alias("dataMatrixVisible"),
        qr.alias("qr"), freight.alias("freight"), routing.alias("routing"), F.col("_atl").alias("atl"),
        F.struct(valid.alias("valid"), F.col("_invalid").alias("invalid")).alias("sscc"),
    ]
    derived = [
        S.unique_non_empty(F.transform(qr, lambda q: q["fields"]["receiverPostcode"])).alias("qrPostcodes"),
        S.unique_non_empty(F.transform(freight, lambda f: f["connoteNumber"])).alias("freightConnotes"),
        S.unique_non_empty(F.transform(freight, lambda f: f["freightItemId"])).alias("freightIds"),
        F.coalesce(F.get(freight, F.lit(0))["productCode"], F.get(qr, F.lit(0))["productCode"], F.lit(""))
        .alias("primaryProductCode"),
        F.col("_atls").alias("expectedAtlNumbers"),
        (facts["authorityToLeavePresent"] | some(F.col("_atls"))).alias("atlExpected"),
        F.array_join(F.transform("_invalid", lambda s: s["reason"]), "\n").alias("invalidSsccReasons"),
        F.concat(facts["toBlock"], facts["postcodeLines"]).alias("receiverEvidence"),
    ]
    mode = [
        F.when(some(qr) | some(freight) | some(routing) | some(F.col("_atl")) | some(valid) | F.col("text_names_carrier"),
               "startrack").otherwise("unknown").alias("carrier"),
        F.when(some(freight), "standard").when(some(valid), "sscc").otherwise("unknown").alias("format"),
        F.coalesce(
            S.blank_to_null(F.concat_ws(
                "\n",
                F.when(some(qr), F.concat(F.lit("StarTrack QR payload(s): "), F.size(qr).cast("string"))),
                F.when(some(freight), F.concat(F.lit("freight item barcode(s): "),
                                               F.array_join(F.transform(freight, lambda f: f["freightItemId"]), ", "))),
                F.when(some(valid), F.concat(F.lit("SSCC barcode(s): "),
                                             F.array_join(F.transform(valid, lambda s: s["articleId"]), ", "))),
                F.when(some(routing), F.concat(F.lit("routing barcode(s): "),
                                               F.array_join(F.transform(routing, lambda r: r["raw"]), ", "))),
            )),
            F.array_join(F.filter(F.transform(items, lambda s: s["raw"]), lambda v: v != ""), "\n"),
        ).alias("evidence"),
    ]
    codes = F.filter(
        F.concat(F.transform(freight, lambda f: f["productCode"]), F.transform(qr, lambda q: q["productCode"]),
                 F.array(facts["labelCode"])),
        lambda c: F.coalesce(c, F.lit("")) != "",
    )
    has = lambda *cs: F.arrays_overlap("_codes", F.array(*[F.lit(c) for c in cs]))
    variant = (
        F.when(F.col("selected.format") == "sscc", "sscc")
        .when(has("FPP", "FPA"), "fpp").when(has("PRM", "APT", "ARL"), "premium")
        .when(has("EXP", "TSE", "RET", "RE2"), "express").otherwise("base")
    )
    df = df.withColumn("_codes", codes)
    part = lambda name, cols: S.struct_of(df, cols, fields_read(name, reads)).alias(name)
    return df.select(
        *HEAD, *keep, F.lit("startrack").alias("carrier"), "facts", "visible_facts", text.alias("text"),
        part("barcodes", barcodes), part("derived", derived), part("detected", mode), variant.alias("variant"),
        ((F.col("selected.format") == "sscc") | (some(valid) & ~some(freight))).alias("sscc_only"),
        F.size(F.filter(items, lambda s: s["raw"] != "")).alias("scan_count"),
    )


def evidence(labels: DataFrame, scans: DataFrame, carrier: str, reads: tuple[str, ...] | None = None) -> DataFrame:
    """Evidence rows; with ``reads`` (columns, or fields as ``column.field``) the HEAD columns, payload_id and the like, and those alone."""
    return eparcel_evidence(labels, scans, reads) if carrier == "eparcel" else startrack_evidence(labels, scans, reads)
