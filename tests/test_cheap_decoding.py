"""Decoding does each search once, with the results of the patterns it is specified by."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.functions import codes as C
from labelproof.functions import strings as S
from labelproof.operators import label_text as X
from labelproof.operators import scans as N
from labelproof.session import tune

ODD = [
    None, "", " ", "]C1]d2(01)1(91)2", "]d2]C1x", "]C1", "x]C1", "((00))(01)", "(0(00))(91", "(9(01))", "(420)|(92)(8008)",
    "a\r\nb\n\rc\r\r\nd", "\t 1 \x1c2\x1d3\x1e4|5", " ﻿ ab　c d\x85᠎", "(ab) c(", "İabß|",
    "421036200040 3ABC", "SYD2000ml", "]Q1" + "x " * 150, "]C1(00)393153450000000011\x0b", " a  ",
]


def rows(spark):
    data = [(k, k, v, "qr", "qr", None) for k, v in enumerate(ODD)]
    return spark.createDataFrame(data, "label_id long, scan_seq long, raw_value string, format string, kind string, bar_count int")


def test_forms_equal_their_patterns(spark):
    raw = F.col("raw_value")
    full = F.coalesce(raw, F.lit(""))
    trim = lambda c: F.btrim(c, F.lit(S.WS_CHARS))
    bare = lambda c: F.regexp_replace(c, r"^(\]C1)?(\]d2)?", "")
    c = F.translate(bare(trim(full)), C.GS_CHARS, "|||")
    c = F.regexp_replace(F.regexp_replace(c, r"\((00|01|91)\)", "$1"), r"\((420|92|8008)\)", "|$1")
    c = F.regexp_replace(F.translate(c, "\t ", ""), r"\r?\n", "|")
    stripped = F.upper(F.translate(F.translate(bare(full), C.GS_CHARS + "|", ""), S.WS_CHARS, ""))
    pairs = [(C.normalize(raw), c), (C.strip(raw), stripped), (S.trim(raw), trim(raw)), (C.bare(raw), F.translate(raw, "()", "")),
             (C.role_value(raw), F.upper(F.translate(full, "()" + S.WS_CHARS, "")))]
    for new, old in pairs:
        assert [r for r in rows(spark).select(raw, new.alias("n"), old.alias("o")).collect() if r.n != r.o] == []


def test_a_route_is_searched_once(spark):
    df = N.decode_routing_scans(rows(spark)).select("label_id", "routing", "routing_reason")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("421(036)") <= 4  # label and reason share one search; postcode has its own


def test_line_patterns_open_with_their_anchor():
    assert X.FROM_STOP.startswith("^(?:") and X.DG_STOP.startswith("^(?:")


def test_long_generated_methods_are_split(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        assert tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
