"""Reconciles label results with shipment payloads behind an identity check.

A payload is parsed and normalised once, before any join. What a label looks for in its payload (ids, codes, words)
is listed in one array of needles; `containment` answers which of them lie in the text, and the label goes on with that
list (``found``), never with the text or its leaves. Looking for the payload of a label that names none is an
equi-join of exploded ids with normalised leaf values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.functions import refdata as R
from labelproof.functions import strings as S
from labelproof.operators import containment

# Limits, stop words, field names and the id patterns that choose a comparison.
MIN_TOKENS = 3
STOP_WORDS = [
    "THE", "AND", "FOR", "WITH", "FROM", "TO", "PH", "PHONE", "AU", "AUS", "NSW", "VIC", "QLD", "SA", "WA", "TAS",
    "ACT", "NT", "KG", "M3", "POST", "PARCEL", "EXPRESS", "STARTRACK", "AUSTRALIA",
]
TRUE_WORDS = ["true", "y", "yes", "1", "enabled"]
FALSE_WORDS = ["false", "n", "no", "0", "disabled"]
FLAG_PATHS = {
    "authority_to_leave": r"authority[_\s-]*to[_\s-]*leave|atl",
    "allow_partial_delivery": r"allow[_\s-]*partial[_\s-]*delivery|partial[_\s-]*delivery",
    "safe_drop_enabled": r"safe[_\s-]*drop",
    "dangerous_goods": r"dangerous[_\s-]*goods|dg[_\s-]*indicator|contains[_\s-]*dangerous",
}
FIELD_PATTERNS = [
    (r"CONSIGNMENT|CONS_NO|CONNOTE|VISIBLE_CONS|ST_CONNOTE|EP-ART-03|EP-ART-07|ST-QR-F03|ST-X-01", "consignment_id"),
    (r"ARTICLE|FREIGHT|VISIBLE_ARTICLE|SSCC|AI91|ST_FREIGHT_BARCODE_PRESENT|DATAMATRIX_PRESENT|GS1_128_PRESENT"
     r"|EP-ART-0[124568]|EP-LIN|EP-SS-|EP-DM-01|ST-FRT|ST-SSC|ST-X-02|ST-QR-F04", "article_id"),
    (r"PRODUCT|ST_QR_PRODUCT|ST_PRODUCT_KNOWN|EP-SVC-02|EP-SVC-07|ST-PRD|ST-QR-F05", "product_code"),
    (r"SERVICE|SERVICE_PRODUCT_MATCH|EP-SVC-01|EP-SVC-03|EP-RET-01", "service_code"),
    (r"ROUTE|ROUTING|ST_ROUTE|ST-RTE-02A|ST-RTE-03", "routing_code"),
    (r"POSTCODE|DM_POSTCODE|ST_QR_POSTCODE|EP-DM-05|EP-TO-08|ST-QR-F02|ST-RTE-02B|ST-RTE-04", "delivery_postcode"),
    (r"WEIGHT|ST_WEIGHT|ST-QR-F09|ST-ITM-04", "weight"),
    (r"CUBE|CUBIC|ST-ITM-05", "cubic_volume"),
    (r"DG|DANGEROUS|EP-LAY-07|ST-QR-F19", "dangerous_goods"),
    (r"ADDR_TO|RECEIVER|EP-TO-|ST-RCV", "receiver_address"),
    (r"ADDR_FROM|SENDER|LODGE|LODGEMENT|EP-FR-|ST-SND", "lodgement_address"),
    (r"DATE|8008|EP-DM-07|EP-LAY-06|ST-QR-F11", "label_generation_datetime"),
    (r"LABEL_CODE|BRAND|LOGO|HEADER|EP-LAY-05|ST-HDR-0[12]", "label_branding"),
]
# The comparison itself is chosen in another order than the field name is.
COMPARISONS = [
    (r"ARTICLE|FREIGHT|VISIBLE_ARTICLE|SSCC|AI91|GS1_PREFIX|DATAMATRIX_PRESENT|GS1_128_PRESENT"
     r"|ST_FREIGHT_BARCODE_PRESENT|ST_SSCC|EP-ART-0[124568]|EP-LIN|EP-SS-|EP-DM-01|ST-FRT|ST-SSC|ST-X-02|ST-QR-F04",
     "article"),
    (r"CONSIGNMENT|CONS_NO|CONNOTE|VISIBLE_CONS|ST_CONNOTE|EP-ART-03|EP-ART-07|ST-QR-F03|ST-X-01", "consignment"),
    (r"PRODUCT|SERVICE_KNOWN|SERVICE_PRODUCT_MATCH|ST_QR_PRODUCT|ST_ROUTE_PRODUCT_MATCH|EP-SVC|EP-RET-01|ST-PRD"
     r"|ST-QR-F05|ST-RTE-03", "product"),
    (r"ROUTE|ROUTING|POSTCODE|DM_POSTCODE|ST_QR_POSTCODE|EP-DM-05|EP-TO-08|ST-QR-F02|ST-RTE", "postcode"),
    (r"WEIGHT|ST_WEIGHT|ST-QR-F09|ST-ITM-04", "weight"),
    (r"CUBE|CUBIC|ST-ITM-05", "cube"),
    (r"DG|DANGEROUS|EP-LAY-07|ST-QR-F19", "dangerous_goods"),
    (r"ADDR_TO|RECEIVER|EP-TO-|ST-RCV", "receiver"),
    (r"ADDR_FROM|SENDER|LODGE|LODGEMENT|EP-FR-|ST-SND", "sender"),
    (r"DATE|8008|EP-DM-07|EP-LAY-06|ST-QR-F11", "date"),
    (r"LABEL_CODE|BRAND|LOGO|HEADER|EP-LAY-05|ST-HDR-0[12]", "branding"),
]
IDENTITY_RULES = (
    r"(?i)ARTICLE|FREIGHT|VISIBLE_ARTICLE|SSCC|AI91|GS1_PREFIX|DATAMATRIX_PRESENT|GS1_128_PRESENT"
    r"|ST_FREIGHT_BARCODE_PRESENT|ST_SSCC|CONSIGNMENT|CONS_NO|CONNOTE|VISIBLE_CONS|ST_CONNOTE|EP-ART|EP-LIN|EP-SS"
    r"|EP-DM-01|ST-FRT|ST-SSC|ST-X-0[12]|ST-QR-F0[34]"
)


# -- payload side -----------------------------------------------------------------------


def parse_payloads(df: DataFrame) -> DataFrame:
    """Adds the JSON text, the parsed variant (null if a key repeats), the error flag and the normalised text.

    Text that is not JSON is tried again from its first ``{`` to its last ``}``."""
    df = df.withColumn("raw_text", S.trim(F.coalesce("raw_text", F.lit(""))))
    start = F.locate("{", F.col("raw_text"))
    end = F.length("raw_text") - F.locate("}", F.reverse("raw_text")) + 1
    sliced = F.when(
        (start > 0) & F.col("raw_text").contains("}") & (end > start),
        F.substring("raw_text", start, end - start + 1),
    )
    df = df.withColumn("_slice", sliced)
    # the variant parser rejects an object that repeats a key; such a text is still JSON, its last value counts
    df = df.withColumn(
        "json_text",
        F.when(F.try_parse_json("raw_text").isNotNull(), F.col("raw_text"))
        .when(F.try_parse_json("_slice").isNotNull() | F.get_json_object("_slice", "$").isNotNull(), F.col("_slice")),
    )
    df = df.withColumn("parsed", F.try_parse_json("json_text")).drop("_slice")
    return df.withColumns(
        {
            "provided": F.col("raw_text") != "",
            "parse_error": (F.col("raw_text") != "") & F.col("json_text").isNull(),
            "normalized_text": S.alnum_key(F.col("raw_text")),
        }
    )


def json_leaves():
    """A mapInArrow function: (payload_id, JSON text) -> the leaves of each text.

    Built-in functions lose the order of keys and reject repeated ones, so this is Python over Arrow batches. A stack
    replaces recursion: leaves come in document order, the last value of a repeated key counts, at any depth the parser
    takes. Self-contained, so that workers need not import this package."""

    def run(batches):
        import json

        import pyarrow as pa

        def shown(v) -> tuple[str, str]:
            if isinstance(v, bool):
                return ("true" if v else "false"), "boolean"
            if isinstance(v, str):
                return v, "string"
            if isinstance(v, float):
                return (str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)), "number"
            return str(v), "number"

        schema = pa.schema([
            ("payload_id", pa.int64()), ("ord", pa.list_(pa.int32())), ("path", pa.string()), ("value", pa.string()), ("value_type", pa.string()),
        ])
        for batch in batches:
            rows = {name: [] for name in schema.names}
            for payload, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    stack = [((), "", json.loads(text))]
                except (ValueError, RecursionError):
                    continue
                while stack:
                    order, path, v = stack.pop()
                    if isinstance(v, dict):
                        inner = [((*order, k), f"{path}.{key}" if path else key, x) for k, (key, x) in enumerate(v.items())]
                        stack += reversed(inner)
                    elif isinstance(v, list):
                        stack += reversed([((*order, k), f"{path}[{k}]", x) for k, x in enumerate(v)])
                    elif v is not None:
                        for name, x in zip(schema.names, (payload, list(order), path, *shown(v)), strict=True):
                            rows[name].append(x)
                if len(rows["path"]) >= 10_000:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows = {name: [] for name in schema.names}
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def flatten_payloads(parsed: DataFrame) -> DataFrame:
    """All leaves of each payload as (path, value, type) in document order; text without JSON yields none."""
    texts = parsed.filter(F.col("json_text").isNotNull()).select(F.col("payload_id").cast("bigint").alias("payload_id"), "json_text")
    leaves = texts.mapInArrow(json_leaves(), "payload_id bigint, ord array<int>, path string, value string, value_type string")
    return leaves.select(
        "payload_id", "ord", "path", "value", "value_type",
        S.alnum_key(F.col("path")).alias("normalized_path"), S.alnum_key(F.col("value")).alias("normalized_value"),
    )


def flag_value(value: Column) -> Column:
    t = F.lower(S.trim(value))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def payload_flags(leaves: DataFrame) -> DataFrame:
    """First leaf per payload whose path names a flag and whose value reads as yes or no."""
    read = flag_value(F.col("value"))
    aggs = []
    for name, pattern in FLAG_PATHS.items():
        hit = (F.col("path").rlike(f"(?i){pattern}") | F.col("normalized_path").rlike(f"(?i){pattern}")) & read.isNotNull()
        aggs.append(F.min_by(read, F.when(hit, F.col("ord"))).alias(name))
    return leaves.groupBy("payload_id").agg(*aggs)


def prepare_payloads(payloads: DataFrame, leaves: bool = False) -> DataFrame:
    """One row for each payload: its normalised text, its flags, and with `leaves` its leaves in one array, which is no
    larger than its text."""
    parsed = parse_payloads(payloads)
    rows = flatten_payloads(parsed)
    out = parsed.select("payload_id", "provided", "parse_error", "normalized_text", F.upper("raw_text").alias("upper_text"))
    out = out.join(payload_flags(rows), "payload_id", "left")
    if not leaves:
        return out
    listed = rows.groupBy("payload_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "path", "value", "normalized_value"))).alias("leaves"),
        evidence_for_paths(FLAG_PATHS["dangerous_goods"]).alias("dg_evidence"))
    return out.join(listed, "payload_id", "left")


# -- containment ----------------------------------------------------------------------


def contains_value(text: Column, value: Column) -> Column:
    """Null when there is nothing to compare: values below two normalised characters."""
    key = S.alnum_key(value)
    return F.when(F.length(key) >= 2, text.contains(key))


def keys_of(values: Column) -> Column:
    """The normalised forms that can be looked for: two characters or more."""
    return F.filter(F.transform(values, S.alnum_key), lambda k: F.length(k) >= 2)


def contains_any(found: Column, values: Column) -> Column:
    """Null without values, otherwise whether any value is among the needles found in the payload."""
    cleaned = F.filter(values, lambda v: S.trim(F.coalesce(v, F.lit(""))) != "")
    return F.when(F.size(cleaned) > 0, F.arrays_overlap(keys_of(cleaned), found))


def tokens(values: Column) -> Column:
    """Upper-case words of three or more characters, stop words and zeros dropped."""
    words = F.flatten(
        F.transform(values, lambda v: F.regexp_extract_all(F.upper(F.coalesce(v, F.lit(""))), F.lit("([A-Z0-9]{3,})"), F.lit(1)))
    )
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w) & ~w.rlike(r"^0+\z")))


def token_coverage(found: Column, values: Column) -> Column:
    """(ok, tokens, matches); null when there are no tokens."""
    toks = tokens(values)

    def judge(ts: Column) -> Column:
        matches = F.filter(ts, lambda t: F.array_contains(found, t))
        codes = F.filter(ts, lambda t: t.rlike(r"^\d{4}\z"))
        ok = (F.size(matches) >= MIN_TOKENS) & ((F.size(codes) == 0) | F.arrays_overlap(codes, matches))
        return F.when(F.size(ts) > 0, F.struct(ok.alias("ok"), ts.alias("tokens"), matches.alias("matches")))

    return S.bind(toks, judge)


def evidence_lines(lines: Column) -> Column:
    return F.array_join(S.unique_non_empty(lines), "\n")


#: What a leaf and a needle have to do with each other: `inside` where the needle lies in the leaf, else the leaf in the needle.
HIT = "array<struct<ord: array<int>, line: string, needle: string, inside: boolean>>"


def shown(path: Column, value: Column) -> Column:
    return F.concat(F.when(path == "", "(root)").otherwise(path), F.lit(": "), value)


def hits_in(leaves: Column, needles: Column) -> Column:
    """Which leaves hold, or are held by, which needles."""

    def of(leaf: Column) -> Column:
        value = leaf["normalized_value"]
        near = F.filter(needles, lambda n: value.contains(n) | (n.contains(value) & (F.length(value) >= 3)))
        return F.transform(near, lambda n: F.struct(
            leaf["ord"].alias("ord"), shown(leaf["path"], leaf["value"]).alias("line"), n.alias("needle"), value.contains(n).alias("inside")))

    return F.flatten(F.transform(leaves, of))


def evidence_for_values(found: Column, hits: Column, values: Column) -> Column:
    """The ``path: value`` lines whose value holds, or is held by, a compared value."""
    cleaned = S.unique_non_empty(values)
    lines = S.bind(keys_of(cleaned), lambda ks: evidence_lines(
        F.transform(F.filter(hits, lambda h: F.array_contains(ks, h["needle"])), lambda h: h["line"])))
    raw = F.when(
        F.coalesce(contains_any(found, cleaned), F.lit(False)),
        F.concat(F.lit("raw_payload: contains "), F.array_join(cleaned, ", ")),
    ).otherwise("")
    return F.coalesce(S.blank_to_null(lines), raw)


def evidence_for_paths(pattern: str) -> Column:
    """Over leaf rows: the lines whose path fits, in document order."""
    line = shown(F.col("path"), F.col("value"))
    hit = F.when(F.col("path").rlike(f"(?i){pattern}"), F.struct("ord", line.alias("line")))
    return evidence_lines(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h["line"]))


def evidence_for_tokens(hits: Column, matches: Column) -> Column:
    near = F.filter(hits, lambda h: h["inside"] & F.array_contains(matches, h["needle"]))
    leaves = F.array_distinct(F.transform(near, lambda h: F.struct(h["ord"].alias("ord"), h["line"].alias("line"))))

    def line(leaf: Column) -> Column:
        of = F.filter(matches, lambda t: F.exists(near, lambda h: (h["needle"] == t) & (h["ord"] == leaf["ord"])))
        return F.concat(leaf["line"], F.lit("  [matched: "), F.array_join(of, ", "), F.lit("]"))

    return F.when(F.size(matches) == 0, "").otherwise(F.coalesce(
        S.blank_to_null(evidence_lines(F.transform(leaves, line))), F.concat(F.lit("matched_tokens: "), F.array_join(matches, ", "))))


# -- label side -------------------------------------------------------------------------


def none() -> Column:
    return F.array().cast("array<string>")


#: What `label_ids` and `label_values` read of the evidence.
IDS_READS = {
    "eparcel": ("facts.articleIds", "facts.consignmentIds", "articles", "derived.linearArticleIds", "derived.dmArticleIds"),
    "startrack": ("facts.articleIds", "facts.consignmentIds", "barcodes.qr", "barcodes.freight", "barcodes.sscc"),
}
BLOCK_READS = tuple(f"facts.{n}" for n in (
    "toBlock", "fromBlock", "postcodeLines", "weightKg", "labelType", "dangerousGoodsDeclarationPresent"))
VALUES_READS = {
    "eparcel": (*IDS_READS["eparcel"], *BLOCK_READS, "barcodes.datamatrix"),
    "startrack": (*IDS_READS["startrack"], *BLOCK_READS, "facts.cube", "facts.labelCode", "barcodes.routing"),
}


def each(arr: Column, name: str) -> Column:
    return F.transform(arr, lambda x: x[name])


def ids_of(carrier: str) -> list[Column]:
    """identities, and whether any parsed article makes the label identifiable."""
    f, b = F.col("facts"), F.col("barcodes")
    if carrier == "eparcel":
        arts = F.col("articles")
        # any parsed article makes the label identifiable, even one the selected format excludes
        parsed_any = (F.size(F.col("derived.linearArticleIds")) + F.size(F.col("derived.dmArticleIds"))) > 0
        identities = F.concat(f["articleIds"], f["consignmentIds"], each(arts, "articleId"), each(arts, "sscc"),
                              each(arts, "consignmentId"))
    else:
        parsed_any = F.lit(False)
        qr, fr, ss = b["qr"], b["freight"], b["sscc"]["valid"]
        qf = lambda name: F.transform(qr, lambda q: q["fields"][name])
        identities = F.concat(f["articleIds"], f["consignmentIds"], each(fr, "freightItemId"), each(fr, "connoteNumber"),
                              qf("freightItemNumber"), qf("connoteNumber"), each(ss, "articleId"), each(ss, "sscc"))
    return [F.filter(S.unique_non_empty(identities), lambda v: F.length(S.alnum_key(v)) >= 6).alias("identities"),
            F.coalesce(parsed_any, F.lit(False)).alias("identifiable")]


def label_ids(evidence: DataFrame, carrier: str) -> DataFrame:
    """(label_id, payload_id, identities, identifiable): `label_values` for those who look for nothing else."""
    return evidence.select("label_id", "payload_id", *ids_of(carrier))


def label_values(evidence: DataFrame, carrier: str) -> DataFrame:
    """(label_id, payload_id, arrays of what each comparison looks for)."""
    f, b = F.col("facts"), F.col("barcodes")
    if carrier == "eparcel":
        arts = F.col("articles")
        std = F.filter(arts, lambda a: a["type"] != "sscc")
        dm = b["datamatrix"]
        cols = {
            "article": F.concat(each(arts, "articleId"), each(F.filter(arts, lambda a: a["type"] == "sscc"), "sscc"),
                                f["articleIds"]),
            "consignment": F.concat(f["consignmentIds"], each(std, "consignmentId")),
            "product": F.concat(each(std, "productCode"), each(std, "serviceCode")),
            "postcode": F.concat(F.regexp_extract_all(F.array_join(f["postcodeLines"], " "), F.lit(S.rx(r"\b(\d{4})\b")), F.lit(1)),
                                 each(dm, "postcode")),
            "weight": F.array(f["weightKg"]),
            "cube": none(),
            "date": each(dm, "dateTime"),
            "branding": F.array(f["labelType"], F.lit("Australia Post")),
        }
        service, dg = F.get(std, F.lit(0))["serviceCode"], f["dangerousGoodsDeclarationPresent"]
    else:
        qr, fr, rt, ss = b["qr"], b["freight"], b["routing"], b["sscc"]["valid"]
        qf = lambda name: F.transform(qr, lambda q: q["fields"][name])
        full = each(ss, "articleId")
        cols = {
            "article": F.concat(each(fr, "freightItemId"), full, each(ss, "sscc"), f["articleIds"]),
            "consignment": F.concat(f["consignmentIds"], each(fr, "connoteNumber"), qf("connoteNumber")),
            "product": F.concat(each(fr, "productCode"), each(qr, "productCode"), each(rt, "labelCode"),
                                each(fr, "expectedLabelCode"), F.array(f["labelCode"])),
            "postcode": F.concat(F.regexp_extract_all(F.array_join(f["postcodeLines"], " "), F.lit(S.rx(r"\b(\d{4})\b")), F.lit(1)),
                                 each(rt, "postcode"), qf("receiverPostcode")),
            "weight": F.concat(F.array(f["weightKg"]), qf("consignmentWeight")),
            "cube": F.concat(F.array(f["cube"]), qf("consignmentCube")),
            "date": none(),
            "branding": F.array(f["labelType"], f["labelCode"], F.lit("StarTrack")),
        }
        service = F.lit(None).cast("string")
        dg = f["dangerousGoodsDeclarationPresent"] | F.exists(qr, lambda q: q["fields"]["dangerousGoodsIndicator"] == "Y")
    filled = lambda arr: F.filter(arr, lambda v: F.coalesce(v, F.lit("")) != "")
    # freight and SSCC articles have no eParcel service, so no delivery flags to compare
    return evidence.select(
        "label_id", "payload_id", *ids_of(carrier),
        *[(F.array_distinct(filled(c)) if n == "postcode" else filled(c)).alias(f"{n}_values") for n, c in cols.items()],
        F.concat(f["toBlock"], f["postcodeLines"]).alias("receiver_values"), f["fromBlock"].alias("sender_values"),
        service.alias("service_code"), dg.alias("label_dg"),
    )


def label_identities(evidence: DataFrame, carrier: str) -> DataFrame:
    out = label_ids(evidence, carrier).select("label_id", "payload_id", F.explode_outer("identities").alias("identity"))
    return out.filter(F.col("identity").isNotNull())


def label_needles(values: DataFrame) -> Column:
    """All that a label of `label_values` (or `label_ids`) looks for in its payload, normalised."""
    if "article_values" not in values.columns:
        return keys_of(F.col("identities"))
    compared = [F.col(f"{n}_values") for n in ("article", "consignment", "product", "postcode", "cube", "date", "branding")]
    words = F.concat(tokens(F.col("receiver_values")), tokens(F.col("sender_values")))
    return F.array_distinct(F.concat(keys_of(F.concat("identities", *compared, weight_spellings(F.col("weight_values")))), words))


#: What a comparison needs to know of a payload besides its text.
FLAGS = ("authority_to_leave", "allow_partial_delivery", "safe_drop_enabled", "dangerous_goods")


def identity_gate(values: DataFrame, payloads: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Does the payload a label names belong to it? Null verdict when the label has no ids.

    values: of `label_values` or `label_ids`; payloads: of `prepare_payloads`, or payload_id, provided and normalized_text; own: label_id
    and own_values (array), more that labels look for. Adds the payload's other columns, gate_applied, identity_matches and
    found, the needles of the label that its payload holds, and where payloads have leaves, hits, the leaves they are in."""
    needles = label_needles(values)
    if own is not None:
        values = values.join(own, "label_id", "left")
        needles = F.array_distinct(F.concat(needles, keys_of(F.coalesce("own_values", none()))))
    rows = values.withColumn("needles", needles).withColumnRenamed("payload_id", "text_id")
    about = [c for c in payloads.columns if c not in ("payload_id", "normalized_text", "upper_text", "leaves")]
    texts = payloads.select(F.col("payload_id").alias("text_id"), F.col("normalized_text").alias("text"), *about)
    rows = containment.with_found(rows, texts, "label_id").withColumnRenamed("text_id", "payload_id")
    if "leaves" in payloads.columns:
        rows = with_hits(rows, payloads)
    return rows.drop("needles", "own_values").withColumns(
        {
            "gate_applied": (F.size("identities") > 0) | F.col("identifiable"),
            "identity_matches": contains_any(F.col("found"), F.col("identities")),
        }
    )


def with_hits(rows: DataFrame, payloads: DataFrame, short: int = containment.SHORT) -> DataFrame:
    """Adds hits. Payloads of short text meet their labels; of long ones each leaf is a part of its payload's index, and the
    substrings of a needle meet the leaves that are equal to them."""
    size = F.length("normalized_text")
    empty = F.array().cast(HIT)
    brief = payloads.where(size <= short).select("payload_id", "leaves")
    met = rows.join(brief, "payload_id").withColumn("hits", F.coalesce(hits_in(F.col("leaves"), F.col("needles")), empty)).drop("leaves")
    long = payloads.where(size > short).select("payload_id", F.explode("leaves").alias("leaf"))
    if long.isEmpty():
        return met
    leaves = long.select(F.col("payload_id").alias("text_id"), F.col("leaf.ord").alias("part_no"), F.col("leaf.normalized_value").alias("part"),
                         shown(F.col("leaf.path"), F.col("leaf.value")).alias("line"))
    far = rows.join(leaves.select(F.col("text_id").alias("payload_id")).distinct(), "payload_id", "left_semi")
    asked = far.select("label_id", F.col("payload_id").alias("text_id"), F.explode("needles").alias("needle"))
    pairs = asked.select("text_id", "needle").distinct()
    inside = containment.places(pairs, leaves.select("text_id", "part_no", "part")).withColumn("inside", F.lit(True))
    sizes = F.sequence(F.lit(3), F.greatest(F.length("needle") - 1, F.lit(3)))  # shorter than the needle: equal ones are inside
    pieces = F.flatten(F.transform(sizes, lambda k: containment.substrings(F.col("needle"), k)))
    around = pairs.where(F.length("needle") > 3).select("text_id", "needle", F.explode(F.array_distinct(pieces)).alias("part")).join(
        leaves.select("text_id", "part_no", "part"), ["text_id", "part"]).select("text_id", "needle", "part_no", F.lit(False).alias("inside"))
    near = inside.unionByName(around).join(leaves.select("text_id", "part_no", "line"), ["text_id", "part_no"])
    listed = near.groupBy("text_id", "needle").agg(
        F.collect_list(F.struct(F.col("part_no").alias("ord"), "line", "needle", "inside")).alias("near"))
    found = containment.spread(asked, listed, ["text_id", "needle"]).groupBy("label_id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("hits"))
    return met.unionByName(far.join(found, "label_id", "left").withColumn("hits", F.coalesce("hits", empty)))


def find_payloads(values: DataFrame, leaves: DataFrame) -> DataFrame:
    """(label_id, payload_id) pairs found by id: an equi-join on normalised id = leaf value.

    Distinct keys are taken on both sides first, so one value repeated in a third of the
    leaves is one row per payload, not one per occurrence."""
    ids = values.select("label_id", F.explode(F.transform("identities", S.alnum_key)).alias("key")).distinct()
    keys = leaves.filter(F.length("normalized_value") >= 6).select(
        F.col("payload_id").alias("found_payload_id"), F.col("normalized_value").alias("key")).distinct()
    return ids.join(keys, "key").select("label_id", "found_payload_id").distinct()


# -- comparison ---------------------------------------------------------------------------


def first_pattern(id_col: Column, table: list[tuple[str, str]], default: str) -> Column:
    expr = None
    for pattern, name in table:
        hit = id_col.rlike(f"(?i){pattern}")
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(default)


def comparable_field(id_col: Column) -> Column:
    return first_pattern(F.upper(id_col), FIELD_PATTERNS, "")


def comparison_kind(id_col: Column) -> Column:
    return first_pattern(id_col, COMPARISONS, "none")


def service_flags_match(df_service: Column) -> Column:
    """All delivery flags the payload states agree with the service; null when it states none."""
    checks = []
    for flag in ("authority_to_leave", "allow_partial_delivery", "safe_drop_enabled"):
        checks.append(F.col(flag) == R.service_flag(df_service, flag))
    known = None
    for c in checks:
        agreed = F.coalesce(c, F.lit(True))
        known = agreed if known is None else known & agreed
    stated = F.coalesce(*checks).isNotNull()
    return F.when(R.service_name(df_service).isNotNull() & stated, known)


def weight_spellings(values: Column) -> Column:
    def spell(w: Column) -> Column:
        t = S.trim(w)
        z = F.regexp_replace(t, r"\.0+\z", "")
        return F.array(t, z, F.concat(z, F.lit("KG")), F.concat(t, F.lit("KG")))

    return F.flatten(F.transform(values, spell))


def label_outcomes(gated: DataFrame, detail: bool = True) -> DataFrame:
    """Every comparison that depends on the label alone, once per label: rows of
    (label_id, comparison, match, detail, evidence)."""
    gated, gate, outcomes = outcomes_of(gated, detail)
    rows = F.array(*[F.struct(F.lit(kind).alias("comparison"), *cols) for kind, cols in outcomes])
    return gated.select("label_id", gate, F.inline_outer(rows))


def outcomes_of(gated: DataFrame, detail: bool) -> tuple[DataFrame, Column, list[tuple[str, list[Column]]]]:
    """Gated rows with what the comparisons share, whether the gate is closed, and each comparison's columns: match and,
    with detail, detail and payload_evidence."""
    found = F.col("found")
    hits = F.col("hits") if detail else F.array().cast(HIT)
    listed = lambda c: F.array_join(c, ", ")
    said = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"Compared {name} values: "), listed(c))).otherwise("")
    gated = gated.withColumns(
        {
            "_flags": service_flags_match(F.col("service_code")),
            "_receiver": token_coverage(found, F.col("receiver_values")),
            "_sender": token_coverage(found, F.col("sender_values")),
            "_weights": weight_spellings(F.col("weight_values")),
            "_any_product": contains_any(found, F.col("product_values")),
        }
    )

    def out(kind: str, match: Column, says: Column, proof) -> tuple[str, list[Column]]:
        cols = [match.alias("match")]
        if detail:
            cols += [says.alias("detail"), proof().alias("payload_evidence")]
        return kind, cols

    def by_values(kind: str, name: str, compare: Column | None = None) -> tuple[str, list[Column]]:
        vals = F.col(f"{kind}_values")
        compare = vals if compare is None else compare
        return out(kind, contains_any(found, compare), said(name, vals), lambda: evidence_for_values(found, hits, compare))

    def by_tokens(kind: str, col: str, name: str) -> tuple[str, list[Column]]:
        c = F.col(col)
        says = F.concat(
            F.lit(f"{name} token match "), F.size(c["matches"]).cast("string"), F.lit("/"),
            F.size(c["tokens"]).cast("string"), F.lit(": "), listed(c["matches"]))
        return out(kind, c["ok"], F.coalesce(says, F.lit("")),
                   lambda: F.coalesce(evidence_for_tokens(hits, c["matches"]), F.lit("")))

    any_product, flags = F.col("_any_product"), F.col("_flags")
    product = F.when(flags.isNull(), any_product).otherwise(F.coalesce(any_product, F.lit(False)) & flags)
    products = F.col("product_values")
    dg_match = F.col("dangerous_goods") == F.col("label_dg")
    rows = [
        by_values("article", "article_id"),
        by_values("consignment", "consignment_id"),
        out("product", product,
            F.concat(F.lit("Compared product_code/service_code/label_code values: "),
                     F.coalesce(S.blank_to_null(listed(products)), F.lit("none")), F.lit(".")),
            lambda: evidence_for_values(found, hits, products)),
        by_values("postcode", "delivery_postcode"),
        by_values("weight", "weight", F.col("_weights")),
        by_values("cube", "cubic_volume"),
        out("dangerous_goods", dg_match,
            F.coalesce(F.concat(F.lit("API dangerous_goods="), F.col("dangerous_goods").cast("string"),
                                F.lit("; label dangerous_goods="), F.col("label_dg").cast("string"), F.lit(".")), F.lit("")),
            lambda: F.when(dg_match.isNotNull(), F.coalesce("dg_evidence", F.lit(""))).otherwise("")),
        by_tokens("receiver", "_receiver", "receiver_address"),
        by_tokens("sender", "_sender", "lodgement_address"),
        by_values("branding", "label_branding"),
        out("none", F.lit(None).cast("boolean"), F.lit(""), lambda: F.lit("")),
    ]
    gate = (F.col("gate_applied") & ~F.coalesce("identity_matches", F.lit(True))).alias("gate_closed")
    return gated, gate, rows


def match_status(match: Column) -> Column:
    return F.when(match, "match").when(~match, "mismatch").otherwise("na")


def own_values(results: DataFrame) -> DataFrame:
    """(label_id, own_values): what result rows that compare their own value look for, for `identity_gate`."""
    dated = results.filter((comparison_kind(F.col("id")) == "date") & (F.coalesce("actual", F.lit("")) != ""))
    return dated.groupBy("label_id").agg(F.collect_set("actual").alias("own_values"))


def compare_results(results: DataFrame, values: DataFrame, payloads: DataFrame, detail: bool = True) -> DataFrame:
    """Adds payload_status, payload_field, payload_detail and payload_evidence to result rows.

    values: of `label_values`; payloads: of `prepare_payloads` (with leaves for detail). Comparisons that depend on the label
    alone are made once for each label; rows that compare their own value (dates) look it up in the label's found needles."""
    gated = identity_gate(values, payloads, own_values(results)).filter("provided")
    r = results.withColumns(
        {"comparison": comparison_kind(F.col("id")), "payload_field": comparable_field(F.col("id"))})
    # the comparisons stay in their label's row: labels meet their payloads once
    gated, gate, outcomes = outcomes_of(gated, detail)
    by_kind = F.create_map(*[x for kind, cols in outcomes for x in (F.lit(kind), F.struct(*cols))])
    label = gated.select("label_id", "found", "date_values", *(["hits"] if detail else []), gate, by_kind.alias("by_kind"))
    # a label that comes twice, or names a payload that does, is an error and not twice as many rows
    label = label.filter(F.col("label_id").isNotNull()).groupBy("label_id").agg(
        F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in label.columns if c != "label_id"])
    repeats = F.raise_error(F.concat(F.lit("label and payload repeat: "), F.col("label_id").cast("string")))
    label = label.withColumn("by_kind", F.when(F.col("_n") == 1, F.col("by_kind")).otherwise(repeats)).drop("_n")
    both = r.join(label, "label_id", "left").withColumn("_out", F.try_element_at("by_kind", F.col("comparison")))
    own = F.filter(F.concat(F.array(F.col("actual")), F.coalesce("date_values", none())), lambda v: F.coalesce(v, F.lit("")) != "")
    both = both.withColumn("_vals", own)
    vals, found, dated = F.col("_vals"), F.col("found"), F.col("comparison") == "date"
    cols = {"match": F.when(dated, contains_any(found, vals)).otherwise(F.col("_out.match"))}
    if detail:
        says = F.when(F.size(vals) > 0, F.concat(F.lit("Compared label_generation_datetime values: "), F.array_join(vals, ", "))).otherwise("")
        cols |= {
            "detail": F.when(dated, says).otherwise(F.col("_out.detail")),
            "payload_evidence": F.when(dated, evidence_for_values(found, F.col("hits"), vals)).otherwise(F.col("_out.payload_evidence")),
        }
    both = both.withColumns(cols)
    closed = F.coalesce("gate_closed", F.lit(False)) & ~F.col("id").rlike(IDENTITY_RULES)
    # a label without a payload is not compared at all
    compared = F.col("gate_closed").isNotNull()
    out = both.withColumn(
        "payload_status", F.when(compared, F.when(closed, "na").otherwise(match_status(F.col("match")))))
    extra = ["payload_status", "payload_field"]
    if detail:
        # a comparison without a verdict reports no detail
        out = out.withColumns(
            {
                "payload_detail": F.when(closed | F.col("match").isNull(), "").otherwise(F.col("detail")),
                "payload_evidence": F.when(closed, "").otherwise(F.col("payload_evidence")),
            }
        )
        extra += ["payload_detail", "payload_evidence"]
    return out.select(*results.columns, *extra)


def matrix_needles(cells: DataFrame, columns: list[str], gated: DataFrame, payloads: DataFrame) -> DataFrame:
    """Cells of labels with a payload, with closed (the gate) and found: which codes of the label's cells, flag words and truth
    values its payload's raw text holds in upper case."""
    label = gated.filter("provided").select(
        "label_id", "payload_id", (F.col("gate_applied") & ~F.coalesce("identity_matches", F.lit(True))).alias("closed"))
    words = F.array(*[F.lit(w) for w in (*(f.upper() for f in FLAGS[:3]), "TRUE", "FALSE")])
    asked = cells.groupBy("label_id").agg(F.array_distinct(F.flatten(F.collect_set(F.array(*columns)))).alias("codes"))
    rows = asked.join(label, "label_id").select(
        "label_id", F.col("payload_id").alias("text_id"), "closed", F.concat(words, "codes").alias("needles"))
    found = containment.with_found(rows, payloads.select(F.col("payload_id").alias("text_id"), F.col("upper_text").alias("text")), "label_id")
    return cells.join(found.select("label_id", "closed", "found"), "label_id")


def matrix_payload(cells: DataFrame, gated: DataFrame, payloads: DataFrame) -> DataFrame:
    """Selected service-matrix cells against the raw payload text: Match / Does not match / N/A."""
    has = lambda c: F.array_contains("found", c)
    checks = has(F.col("service_code")) & has(F.col("product_code"))
    for flag in FLAGS[:3]:
        want = F.upper(R.service_flag(F.col("service_code"), flag).cast("string"))
        checks = checks & F.when(has(F.lit(flag.upper())), has(want)).otherwise(True)
    rows = matrix_needles(cells, ["service_code", "product_code"], gated, payloads)
    return rows.select(
        *cells.columns,
        F.when(F.col("closed") | ~F.col("selected_cell"), "N/A").when(checks, "Match").otherwise("Does not match").alias("payload_match"),
    )


def product_payload(cells: DataFrame, gated: DataFrame, payloads: DataFrame) -> DataFrame:
    """Selected StarTrack product rows against the raw payload text."""
    rows = matrix_needles(cells, ["product_code", "label_code"], gated, payloads)
    hit = F.array_contains("found", F.col("product_code")) | F.array_contains("found", F.col("label_code"))
    return rows.select(*cells.columns, F.when(F.col("closed"), "N/A").when(hit, "Match").otherwise("Does not match").alias("payload_match"))
