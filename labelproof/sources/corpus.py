"""Label, scan, text and payload tables derived from the driver's order tables.

Every formula is plain integer/string SQL that Spark and other engines read alike,
so the same text builds the inputs on both sides of a correctness check. Faults are
planted by ``k % n`` rules (``k`` = order key); all orders become labels, and a third
of all labels fall into one batch so that hot keys are always part of the data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.functions.codes import LETTER_DIGITS, LETTERS, QR_FIELDS

GTIN = "0199312650999998"


def case(expr: str, values: list[str], other: str) -> str:
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {expr} {arms} else '{other}' end"


def pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


def digit_sum(col: str, width: int) -> str:
    return " + ".join(
        f"{3 if (width - i) % 2 == 0 else 1} * (ascii(substr({col}, {i}, 1)) - 48)" for i in range(1, width + 1)
    )


def check(total: str, shift: str) -> str:
    """Check digit text, moved by one (mod 10) where the planted fault applies."""
    return f"cast(((10 - ({total}) % 10) + case when {shift} then 1 else 0 end) % 10 as string)"


NL = " || chr(10) || "

# --- eParcel labels: one per order ------------------------------------------
EPARCEL_LAYERS: list[list[str]] = [
    [
        "o_orderkey as k",
        "o_custkey as c",
        "o_orderkey as label_id",
        "case when o_orderkey % 3 = 0 then cast(0 as bigint) else o_orderkey % 97 end as batch_id",
        "case when o_orderkey % 2 = 0 then 'JDQ' else '1JDQ1' end as mlid",
        f"{pad('o_orderkey', 7)} as serial",
        f"{pad('o_orderkey % 22', 2)} as cnt",
        case("o_orderkey % 7", ["00093", "00096", "00065", "00068", "00091", "00087"], "99999") + " as product",
        case("o_orderkey % 12", ["03", "08", "09", "15", "45", "49", "50", "51", "81", "82", "83"], "99")
        + " as service",
        "case when o_orderkey % 50 = 0 then '1' else '0' end as paid",
        "cast(2000 + o_orderkey % 1000 as string) as postcode",
        "case when o_orderkey % 10 = 9 then 'sscc' else 'standard' end as label_format",
        "'25' || " + "case when o_orderkey % 23 = 0 then '13' else " + pad("o_orderkey % 12 + 1", 2) + " end || "
        + " || ".join([pad("o_orderkey % 31 + 1", 2), pad("o_orderkey % 24", 2), pad("o_orderkey % 60", 2),
                       pad("o_orderkey % 59", 2)])
        + " as stamp",
        "'39315345' || " + pad("o_orderkey", 9) + " as sscc_body",
        case("o_orderkey % 9", ["CHULLORA", "RICHMOND", "ST KILDA", "O''CONNOR".replace("''", " "), "MT-ISA"], "PERTH")
        + " as suburb",
        case("o_orderkey % 8", ["ACT", "NSW", "NT", "QLD", "SA", "TAS", "VIC"], "WA") + " as state",
    ],
    ["*", "mlid || serial || cnt || product || service || paid as body"],
    ["*", f"lpad(translate(body, '{LETTERS}', '{LETTER_DIGITS}'), 22, '0') as body_digits"],
    [
        "*",
        "body || " + check(digit_sum("body_digits", 22), "k % 13 = 0") + " as article",
        "sscc_body || " + check(digit_sum("sscc_body", 17), "k % 11 = 0") + " as sscc18",
        "case when k % 17 = 0 then 'FNC1' when k % 4 < 2 then chr(29) else '|' end as sep",
        "case when k % 19 = 0 then substr(postcode, 1, 3) else postcode end as dm_postcode",
        "case when k % 6 <> 1 then '' when k % 4 = 1 then '00000000' else " + pad("k", 8) + " end as dpid",
    ],
    [
        "*",
        f"case when k % 41 = 0 then '0109312650999998' else '{GTIN}' end as gtin",
        "case when k % 29 = 0 then substr(stamp, 1, 6) || ' ' || substr(stamp, 7, 5) else stamp end as dm_stamp",
    ],
    [
        "*",
        "case when label_format = 'sscc' and k % 20 = 19 then "
        "case when k % 3 = 0 then '(00)' || sscc18 else '00' || sscc18 end "
        "when k % 8 = 3 then '(01)' || substr(gtin, 3, 14) || '(91)' || article "
        "when k % 8 = 5 then article "
        "when k % 8 = 6 then ']C1' || gtin || '91' || article "
        "when k % 31 = 0 then gtin || '91' || substr(article, 1, 15) "
        "else gtin || '91' || article end as linear_raw",
        "']d2' || gtin || '91' || case when k % 53 = 0 then body || '9' else article end || sep || '420' || dm_postcode"
        " || case when dpid = '' then '' else sep || '92' || dpid end || sep || '8008' || dm_stamp as dm_raw",
    ],
]

EPARCEL_TEXT = (
    "case when k % 47 = 0 then '' else "
    + NL.join(
        [
            case("k % 5", ["Parcel Post", "Express Post", "eParcel", "PARCEL  POST"], "Label"),
            "case when k % 45 = 0 then 'NOTE' when k % 6 = 0 then 'DELIVER TO' else 'TO:' end",
            "'MR C RECEIVER ' || cast(c as string)",
            "case when k % 16 = 3 then 'PHONE: 0299990000' else 'Unit ' || cast(k % 40 as string) end",
            "cast(k % 300 as string) || ' Test Street' || case when k % 12 = 5 then '    The sender acknowledges' else '' end",
            "case when k % 18 = 5 then 'Chullora' when k % 18 = 11 then 'CHULLORA,' else suburb end"
            " || ' ' || state || ' ' || postcode",
            "case when k % 21 = 0 then 'Sender' else 'FROM: MR C SENDER' end",
            "case when k % 9 = 4 then '1 Jedda Road   Declaration' else '1 Jedda Road' end",
            "case when k % 28 = 0 then 'Prestons NSW 2170' else 'PRESTONS NSW 2170' end",
            "case when k % 14 = 7 then 'Cons No:' || chr(10) || mlid || serial"
            " when k % 14 = 3 then 'Cons No: JDQ9999999' when k % 14 = 5 then 'x'"
            " else 'Con No ' || mlid || serial end",
            "case when k % 3 = 1 then 'AP Article ID: ' || substr(article, 1, 4) || ' ' || substr(article, 5, 30)"
            " when k % 26 = 0 then 'Article Id: JDQ000000100000930300'"
            " when k % 3 = 2 then article else 'AP Article Id ' || article end",
            "case when k % 25 = 0 then 'Handle with care'"
            " else 'Aviation Security and Dangerous Goods Declaration' end",
            "'The sender acknowledges that this article may be carried by air'",
            "case when k % 4 = 0 then 'Weight 1.' || cast(k % 10 as string) || ' kg'"
            " when k % 15 = 1 then 'no mass' else cast(k % 20 as string) || '.5kg' end",
            "case when k % 33 = 0 then '06-09' else lpad(cast(k % 12 + 1 as string), 2, '0') || '09' end",
            "case when k % 5 = 0 then 'Postage Paid Australia' else 'Ph: 02 9999 ' || cast(1000 + k % 9000 as string) end",
        ]
    )
    + " end"
)

LABEL_COMMON = [
    "'label-' || cast(k as string) || case when k % 71 = 0 then '.txt' else '.pdf' end as filename",
    "case when k % 71 = 0 then 'text/plain' when k % 16 = 0 then 'image/png' else 'application/pdf' end as file_type",
    "case when k % 67 = 0 then cast(60000000 as bigint) else 1000 + k end as file_bytes",
    "cast(case when k % 73 = 0 then 41 else 1 + k % 3 end as int) as page_count",
    "cast(1 + k % 3 as int) as source_page",
]

EPARCEL_LABELS = [
    "label_id", "batch_id", *LABEL_COMMON,
    "case when k % 16 = 0 then cast(null as double) when k % 20 = 3 then cast(210 as double)"
    " else cast(150 + k % 3 as double) end as width_mm",
    "case when k % 16 = 0 then cast(null as double) else cast(100 + k % 4 as double) end as height_mm",
    "cast(case when k % 16 = 0 then 600 + (k % 64) * 20 end as int) as pixel_width",
    "cast(case when k % 16 = 0 then 400 + (k % 64) * 20 end as int) as pixel_height",
    "cast(case when k % 10 = 1 then 90 else 0 end as int) as rotation",
    "cast(1 as int) as segment_index",
    "cast(case when k % 12 = 1 then 2 else 1 end as int) as segment_count",
    "'eparcel' as carrier", "label_format",
    f"{EPARCEL_TEXT} as extracted_text",
    "k % 5 <> 0 as linear_visible", "k % 7 <> 0 as datamatrix_visible",
    "case when k % 10 <> 9 then '' when k % 40 = 9 then '9315345' when k % 40 = 19 then '0039315345'"
    " when k % 40 = 29 then '12' else '' end as sscc_company_prefix",
    "case when k % 10 <> 9 then '' when k % 30 = 9 then '3' when k % 30 = 19 then '004' else '' end"
    " as sscc_extension_digit",
    "k as payload_id",
]

# (scan_seq, raw value, format, kind, bar count, condition)
EPARCEL_SCANS = [
    (0, "linear_raw", "'code_128'", "'linear'", "cast(null as int)", "k % 37 <> 0"),
    (1, "dm_raw", "case when k % 9 = 0 then '' else 'data_matrix' end", "'datamatrix'", "cast(null as int)",
     "k % 39 <> 0"),
    (2, "'INV-' || cast(k as string)", "'code_128'", "'linear'", "cast(null as int)", "k % 15 = 0"),
    (3, "gtin || '91' || article", "'Code 128'", "'linear'", "cast(null as int)", "k % 18 = 0"),
    (4, "''", "'code_128'", "'linear'", "cast(null as int)", "k % 22 = 0"),
]

# --- StarTrack labels ---------------------------------------------------------
QR = {
    "receiverSuburb": "suburb",
    "receiverPostcode": "case when k % 35 = 0 then '21' else postcode end",
    "connoteNumber": "case when k % 27 = 0 then 'WXYZ00000001' else connote end",
    "freightItemNumber": "case when k % 36 = 0 then connote || 'EXP99999' else freight_id end",
    "productCode": "product",
    "payerAccount": "''",
    "senderAccount": "'12345678'",
    "consignmentQuantity": "cast(1 + k % 3 as string)",
    "consignmentWeight": "case when k % 38 = 0 then 'x5' else cast(1 + k % 30 as string) end",
    "consignmentCube": "case when k % 4 = 1 then '0.25' else cast(k % 50 as string) end",
    "despatchDate": "case when k % 42 = 0 then '20261310' else '202606' || lpad(cast(1 + k % 28 as string), 2, '0') end",
    "receiverName1": "case when k % 44 = 0 then '' else 'CAROL RECEIVER' end",
    "receiverName2": "case when k % 3 = 0 then 'UNIT B' else '' end",
    "unitType": case("k % 9", ["BAG", "CTN", "ITM", "JIF", "PAL", "SAT", "SKI", "XXX"], ""),
    "destinationDepot": "'SYD'",
    "receiverAddress1": "'8 TEST CLOSE'",
    "receiverAddress2": "''",
    "receiverPhone": "''",
    "dangerousGoodsIndicator": "case when k % 46 = 0 then 'Q' when k % 5 = 0 then 'Y' else 'N' end",
    "movementTypeIndicator": "case when k % 48 = 0 then 'Z' when k % 8 = 0 then 'C' when k % 8 = 4 then 'T' else 'N' end",
    "notBeforeDate": "case when k % 6 = 0 then '202606111200' else '' end",
    "notAfterDate": "case when k % 12 = 0 then '202606101200' when k % 6 = 0 then '202606121200' else '' end",
    "atlNumber": "case when k % 4 = 0 then atl_no when k % 52 = 1 then 'X000' else '' end",
    "raNumber": "case when k % 8 = 4 then 'RA' || cast(k % 1000 as string) else '' end",
}

STARTRACK_LAYERS: list[list[str]] = [
    [
        "o_orderkey as k",
        "o_custkey as c",
        "o_orderkey as label_id",
        "case when o_orderkey % 3 = 0 then cast(0 as bigint) else o_orderkey % 97 end as batch_id",
        case("o_orderkey % 10", ["TSE", "RET", "RE2", "APT", "PRM", "FPP", "ARL", "FPA", "EXP"], "ZZZ") + " as product",
        case("o_orderkey % 10", ["TSE", "RET", "RE2", "APT", "PRM", "PRM", "ARL", "ARL", "EXP"], "EXP") + " as route_code",
        "cast(2000 + o_orderkey % 1000 as string) as postcode",
        "case when o_orderkey % 10 = 9 then 'sscc' else 'standard' end as label_format",
        "'ABCD' || " + pad("o_orderkey", 8) + " as connote",
        "'C' || " + pad("o_orderkey", 9) + " as atl_no",
        "'39315345' || " + pad("o_orderkey", 9) + " as sscc_body",
        case("o_orderkey % 5", ["CHULLORA", "RICHMOND", "ST KILDA", "PERTH"], "MT-ISA") + " as suburb",
    ],
    [
        "*",
        "connote || product || " + pad("k % 100000", 5) + " as freight_id",
        "sscc_body || " + check(digit_sum("sscc_body", 17), "k % 11 = 0") + " as sscc18",
    ],
    ["*", " || ".join(f"rpad({QR[name]}, {n}, ' ')" for name, _, n in QR_FIELDS) + " as qr_text"],
    [
        "*",
        "case when k % 61 = 0 then substr(qr_text, 1, 280) when k % 13 = 0 then ']Q1' || qr_text else qr_text end as qr_raw",
        "case when label_format = 'sscc' and k % 30 <> 29 then '00' || sscc18"
        " when k % 43 = 0 then lower(freight_id) when k % 57 = 0 then substr(freight_id, 1, 18)"
        " else freight_id end as freight_raw",
        "case when k % 21 = 0 then 'EXP' when k % 34 = 0 then 'QQQ' else route_code end as label_code",
    ],
    [
        "*",
        "case when k % 5 = 4 then '(421)036' || postcode || '(403)' || label_code"
        " else label_code || case when k % 32 = 0 then '3000' else postcode end || case when k % 2 = 0 then 'SYD' else 'ML' end"
        " end as routing_raw",
        "case when k % 54 = 0 then 'C12345' when k % 56 = 0 then 'C000000001' else atl_no end as atl_raw",
    ],
]

STARTRACK_TEXT = (
    "case when k % 47 = 0 then '' else "
    + NL.join(
        [
            "case when k % 24 = 0 then 'FREIGHT' else 'STARTRACK' end",
            "case when k % 7 = 0 then 'LABEL' else product end",
            "case when k % 6 = 0 then 'CONNOTE:' || chr(10) || connote when k % 6 = 1 then 'no number'"
            " when k % 6 = 2 then 'Consignment' || chr(10) || 'see below' || chr(10) || 'ref ' || connote"
            " when k % 58 = 3 then 'CONNOTE: WXYZ99999999' else 'CONNOTE: ' || connote end",
            "case when k % 3 = 0 then 'TO: CAROL RECEIVER' || chr(10) || '8 TEST CLOSE' else 'LABEL TEXT' end",
            "suburb || ' NSW ' || postcode",
            "case when k % 5 = 0 then 'FROM X' || chr(10) || '1 Jedda Road' || chr(10) || 'PRESTONS NSW 2170' else 'DESK' end",
            "case when k % 9 = 1 then 'Article ID: ' || substr(freight_id, 1, 12) || ' ' || substr(freight_id, 13, 8)"
            " when k % 9 = 2 then freight_id else 'ITEM 1 OF 1' end",
            "case when k % 4 = 3 then 'mass n/a' else cast(1 + k % 30 as string) || ' kg' end",
            "case when k % 4 = 2 then 'volume n/a' else '0.0' || cast(1 + k % 9 as string) || ' m3' end",
            "case when k % 8 = 0 then '*RETURN*' when k % 16 = 4 then '* TRANSFER *' else 'BOX' end",
            "case when k % 4 = 0 then 'AUTHORITY TO LEAVE ' || atl_no when k % 11 = 0 then 'ATL' else 'SIGN' end",
            "case when k % 5 = 0 then 'DANGEROUS GOODS' when k % 17 = 0 then 'UN 1263' else 'SAFE' end",
            "case when k % 20 = 0 then 'AUCKLAND NZ' when k % 3 = 1 then 'CTN' else 'END' end",
        ]
    )
    + " end"
)

STARTRACK_LABELS = [
    "label_id", "batch_id", *LABEL_COMMON,
    "case when k % 16 = 0 then cast(null as double) when k % 20 = 3 then cast(210 as double)"
    " when k % 6 = 0 then cast(150 as double) else cast(100 + k % 3 as double) end as width_mm",
    "case when k % 16 = 0 then cast(null as double) when k % 6 = 0 then cast(100 as double)"
    " when k % 6 = 1 then cast(200 as double) else cast(150 as double) end as height_mm",
    "cast(case when k % 16 = 0 then 600 + (k % 64) * 20 end as int) as pixel_width",
    "cast(case when k % 16 = 0 then 400 + (k % 64) * 20 end as int) as pixel_height",
    "cast(0 as int) as rotation",
    "cast(1 as int) as segment_index", "cast(1 as int) as segment_count",
    "'startrack' as carrier", "label_format",
    f"{STARTRACK_TEXT} as extracted_text",
    "k % 5 <> 0 as linear_visible", "k % 7 <> 0 as datamatrix_visible",
    "case when k % 10 <> 9 then '' when k % 40 = 9 then '9315345' when k % 40 = 19 then '0039315345'"
    " when k % 40 = 29 then '12' else '' end as sscc_company_prefix",
    "case when k % 10 <> 9 then '' when k % 30 = 9 then '3' when k % 30 = 19 then '004' else '' end"
    " as sscc_extension_digit",
    "k as payload_id",
]

STARTRACK_SCANS = [
    (0, "qr_raw", "'qr_code'", "'qr'", "cast(null as int)", "k % 39 <> 0"),
    (1, "freight_raw", "'code_128'", "'linear'",
     "cast(case when k % 23 = 0 then null when k % 19 = 0 then 70 else 61 end as int)", "k % 37 <> 0"),
    (2, "routing_raw", "'code_128'", "'linear'", "cast(null as int)", "k % 41 <> 0"),
    (3, "atl_raw", "'code_128'", "'linear'", "cast(null as int)", "k % 4 = 0"),
    (4, "'INV' || cast(k as string)", "'code_128'", "'linear'", "cast(null as int)", "k % 15 = 0"),
]

# --- payloads: one JSON text per label, keys in sorted order --------------------
EPARCEL_PAYLOAD = (
    "case when k % 59 = 0 then '' when k % 63 = 0 then '{{ not json' else "
    "case when k % 19 = 0 then 'GET /shipments ' else '' end || "
    "'{\"allow_partial_delivery\":' || case when service in ('45', '15', '51', '09', '82') then"
    " case when k % 31 = 0 then 'false' else 'true' end else case when k % 31 = 0 then 'true' else 'false' end end || "
    "',\"articles\":[{\"article_id\":\"' || case when k % 29 = 0 then 'JDQ000000000000000000' else article end || "
    "'\",\"barcode_id\":null,\"product_id\":\"' || product || '\"}]' || "
    "',\"authority_to_leave\":' || case when service in ('08', '15', '09', '82') then 'true' else 'false' end || "
    "',\"consignment_id\":\"' || case when k % 29 = 0 then 'none' else mlid || serial end || "
    "'\",\"dangerous_goods\":\"' || case when k % 25 = 0 then 'no' else 'yes' end || "
    "'\",\"safe_drop_enabled\":' || case when service in ('50', '51', '83') then 'true' else 'false' end || "
    "',\"to\":{\"lines\":[\"MR C RECEIVER ' || cast(c as string) || '\",\"' || cast(k % 300 as string) || ' Test Street\"]"
    ",\"postcode\":\"' || case when k % 24 = 0 then '9999' else postcode end || '\",\"state\":\"' || state || "
    "'\",\"suburb\":\"' || suburb || '\"},\"weight\":' || cast(k % 20 as string) || '.5}' || "
    "case when k % 19 = 0 then ' -- end' else '' end end"
)
STARTRACK_PAYLOAD = (
    "case when k % 59 = 0 then '' else "
    "'{\"connote\":\"' || case when k % 29 = 0 then 'none' else connote end || "
    "'\",\"dangerous_goods\":' || case when k % 5 = 0 then 'true' else 'false' end || "
    "',\"items\":[{\"id\":\"' || case when k % 29 = 0 then 'ABCD' else freight_raw end || '\",\"product\":\"' || product || '\"}]' || "
    "',\"to\":{\"postcode\":\"' || postcode || '\",\"suburb\":\"' || suburb || '\"},\"weight\":' || "
    "cast(1 + k % 30 as string) || '}' end"
)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return df.repartition(spark.sparkContext.defaultParallelism)  # a single small file reads as one task


def _layered(df: DataFrame, layers: list[list[str]]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr(*layer)
    return df


def base(spark: SparkSession, sf_dir: str, carrier: str = "eparcel", exprs: list[str] | None = None) -> DataFrame:
    """The generated ids and raw values, one row per order: all, or those that the expressions name."""
    df = _layered(orders(spark, sf_dir), EPARCEL_LAYERS if carrier == "eparcel" else STARTRACK_LAYERS)
    if exprs is not None:
        # what settle hands on is derived for every row, whether it is read or not
        words = set(re.findall(r"\w+", " ".join(exprs)))
        df = df.select(*[c for c in df.columns if c in words])
    return settle(df)


def settle(df: DataFrame) -> DataFrame:
    """Ends a chain of derived columns: the optimizer does not push filters below a generator,
    so a filter on a derived column is not rewritten into its whole derivation."""
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def labels(spark: SparkSession, sf_dir: str, carrier: str = "eparcel") -> DataFrame:
    exprs = EPARCEL_LABELS if carrier == "eparcel" else STARTRACK_LABELS
    return base(spark, sf_dir, carrier, exprs).selectExpr(*exprs)


def scans(spark: SparkSession, sf_dir: str, carrier: str = "eparcel") -> DataFrame:
    """Decoded-barcode rows: one narrow ``inline`` over the label's scan slots."""
    slots = EPARCEL_SCANS if carrier == "eparcel" else STARTRACK_SCANS
    structs = [
        f"case when {cond} then named_struct('scan_seq', {seq}, 'raw_value', {raw}, 'format', {fmt}, 'kind', {kind}, "
        f"'bar_count', {bars}) end"
        for seq, raw, fmt, kind, bars, cond in slots
    ]
    exprs = ["label_id", f"inline(filter(array({', '.join(structs)}), x -> x is not null))"]
    return base(spark, sf_dir, carrier, exprs).selectExpr(*exprs)


def payloads(spark: SparkSession, sf_dir: str, carrier: str = "eparcel") -> DataFrame:
    expr = EPARCEL_PAYLOAD if carrier == "eparcel" else STARTRACK_PAYLOAD
    exprs = ["k as payload_id", "batch_id", f"{expr} as raw_text"]
    return base(spark, sf_dir, carrier, exprs).selectExpr(*exprs)


# --- the same inputs as SQL text, for engines other than Spark -------------------


def base_sql(carrier: str = "eparcel") -> str:
    sql = "orders"
    for layer in EPARCEL_LAYERS if carrier == "eparcel" else STARTRACK_LAYERS:
        sql = f"(select {', '.join(layer)} from {sql})"
    return f"select * from {sql}"


def labels_sql(carrier: str = "eparcel") -> str:
    cols = EPARCEL_LABELS if carrier == "eparcel" else STARTRACK_LABELS
    return f"select {', '.join(cols)} from ({base_sql(carrier)})"


def scans_sql(carrier: str = "eparcel") -> str:
    slots = EPARCEL_SCANS if carrier == "eparcel" else STARTRACK_SCANS
    return " union all ".join(
        f"select label_id, {seq} as scan_seq, {raw} as raw_value, {fmt} as format, {kind} as kind, {bars} as bar_count"
        f" from base where {cond}"
        for seq, raw, fmt, kind, bars, cond in slots
    )


def payloads_sql(carrier: str = "eparcel") -> str:
    expr = EPARCEL_PAYLOAD if carrier == "eparcel" else STARTRACK_PAYLOAD
    return f"select k as payload_id, batch_id, {expr} as raw_text from ({base_sql(carrier)})"


def with_corpus(carrier: str = "eparcel") -> str:
    """CTEs ``base``, ``labels_t``, ``scans_t`` and ``payloads_t`` for a SQL engine."""
    return (
        f"with base as materialized ({base_sql(carrier)}), labels_t as ({labels_sql(carrier)}), "
        f"scans_t as ({scans_sql(carrier)}), payloads_t as ({payloads_sql(carrier)})"
    )
