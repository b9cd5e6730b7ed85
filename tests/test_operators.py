"""Literal values, rule table merging, payload robustness and the streaming path."""

import json
import tempfile

from pyspark.sql import functions as F

from labelproof.operators import label_text as X
from labelproof.operators import payload as P
from labelproof.operators import scans as N
from labelproof.sources import rules as RS
from labelproof.streaming import stream_audit as SA


def scans(spark, *values):
    return spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "label_id bigint, scan_seq int, raw_value string")


def test_literal_decodes(spark):
    s = N.decode_sscc_scans(scans(spark, "(00) 3 93 15345 000000070 0", "00393153450000000701")).orderBy("label_id").collect()
    assert s[0]["sscc"]["articleId"] == "00393153450000000700" and s[0]["sscc"]["valid"]
    assert s[0]["sscc"]["companyPrefixAndSerial"] == "9315345000000070"
    assert "check digit mismatch" in s[1]["sscc_reason"]
    f = N.decode_freight_scans(scans(spark, "ABCD12345678EXP00001")).first()["freight"]
    assert (f["connoteNumber"], f["productCode"], f["itemNumber"]) == ("ABCD12345678", "EXP", "00001")
    r = N.decode_routing_scans(scans(spark, "EXP3000SYD", "4210363000403EXP", "QQQ3000SYD")).orderBy("label_id").collect()
    assert r[0]["routing"]["postcode"] == "3000" and r[1]["routing"]["type"] == "gs1-421-routing"
    assert r[2]["routing_reason"] == "Unknown StarTrack routing label code QQQ."
    assert N.decode_atl_scans(scans(spark, "C123456789")).first()["atl"]["counterNumber"] == 123456789
    n = N.normalize_scans(scans(spark, "]C10199312650999998\x1d910123")).first()
    assert n["normalized"] == "0199312650999998|910123"
    bad = N.decode_article_scans(scans(spark, "ABC1234567")).first()
    assert bad["article"] is None and bad["reject_reason"]


def test_check_digit_of_any_length(spark):
    df = spark.createDataFrame([("article", "ABC123456789012345675"), ("article", "A?1"), ("sscc", "00393153450000000700")], "kind string, value string")
    got = [(r["expected"], r["valid"]) for r in N.verify_check_digits(df).collect()]
    assert got == [("5", True), (None, False), ("0", True)]


def test_content_alone_decides_datamatrix(spark):
    # a linear scan whose serial holds 420 is parsed as DataMatrix
    assert N.decode_datamatrix_scans(scans(spark, "019931265099999891JDQ0042000010009303")).first()["looks_datamatrix"]


def test_lines_keep_the_first_item_as_anchor(spark):
    items = [(1, i, s, x, y, 8.0) for i, (s, x, y) in enumerate(
        [("a", 0.0, 100.0), ("b", 10.0, 97.0), ("c", 60.0, 97.0), ("d", 0.0, 94.0), ("e", 5.0, 90.0), (" ", 1.0, 90.0)])]
    df = spark.createDataFrame(items, "label_id bigint, item_seq int, str string, x double, y double, height double")
    got = [r["line"] for r in X.lines_from_items(df).orderBy("line_no").collect()]
    # 94 is within 3.5 of 97 but not of the anchor 100
    assert got == ["a b   c", "d", "e"]


def test_rule_table_merges_like_the_catalogue(spark):
    table = RS.load_rules(spark)
    for carrier in ("eparcel", "startrack"):
        a, b = RS.rule_sets(table, carrier), RS.built_in(spark, carrier)
        assert {v: [r["id"] for r in s["rules"]] for v, s in a.items()} == {v: [r["id"] for r in s["rules"]] for v, s in b.items()}
        assert a["sscc"]["constants"] == b["sscc"]["constants"]


def test_rule_directory(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    base = {"id": "b", "constants": {"c": ["P", "Q"]}, "rules": [
        {"id": "R1", "title": "one", "severity": "ERROR", "assert": {"op": "matches", "value": "^({{c}}|{{gone}})$"}}, {"id": "R2"}]}
    variant = {"id": "v", "constants": {"c": ["Z"]}, "rules": [{"id": "R1", "severity": "INFO"}, {"id": "R2", "disabled": True}, {"id": "R3"}]}
    (d / "base.json").write_text(json.dumps(base))
    (d / "v.json").write_text(json.dumps(variant))
    sets = RS.rule_sets(RS.load_rules(spark, str(tmp_path)), "x")
    assert [r["id"] for r in sets["v"]["rules"]] == ["R1", "R3"]
    assert sets["v"]["rules"][0] == {"id": "R1", "title": "one", "severity": "INFO", "assert": {"op": "matches", "value": "^(Z|{{gone}})$"}}


def test_payload_robustness(spark):
    wide = json.dumps({"items": list(range(30000))})
    rows = [(1, "{{{{{ not json at all"), (2, "[" * 50000 + "1" + "]" * 50000), (3, wide), (4, 'GET {"a":{"b":[null,true,"x"]}} end'), (5, " "),
            (6, '{"z":1,"a":{"k":1.50,"k":2.5},"z":"last"}'), (7, '{"d":' * 40 + '"deep"' + "}" * 40)]
    parsed = P.parse_payloads(spark.createDataFrame(rows, "payload_id bigint, raw_text string"))
    flags = {r["payload_id"]: (r["provided"], r["parse_error"]) for r in parsed.collect()}
    assert flags[1] == (True, True) and flags[4] == (True, False) and flags[5] == (False, False)
    leaves = P.flatten_payloads(parsed)
    counts = {r["payload_id"]: r["count"] for r in leaves.groupBy("payload_id").count().collect()}
    assert counts[3] == 30000 and 1 not in counts and flags[6] == (True, False)
    four = {r["path"]: r["value"] for r in leaves.filter("payload_id = 4").collect()}
    assert four == {"a.b[1]": "true", "a.b[2]": "x"}
    six = sorted((r["ord"], r["path"], r["value"]) for r in leaves.filter("payload_id = 6").collect())
    assert six == [([0], "z", "last"), ([1, 0], "a.k", "2.5")]
    assert [(r["path"], r["value"]) for r in leaves.filter("payload_id = 7").collect()] == [(".".join("d" * 40), "deep")]


def test_stream_equals_batch(spark):
    src, out, chk = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    df = spark.range(200).select(
        F.col("id").alias("label_id"), F.lit(0).alias("scan_seq"),
        F.when(F.col("id") % 2 == 0, "019931265099999891JDQ019457101000930308").otherwise("ABC1234567").alias("raw_value"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") / 4).cast("int"))).alias("ts"))
    df.unionByName(df).repartition(2).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    SA.run(stream, lambda b, _: b.write.mode("append").parquet(out), chk).awaitTermination()
    batch = {(r["window_start"], r["verdict"]): r["scans"] for r in SA.stream_audit(df).collect()}
    got = {(r["window_start"], r["verdict"]): r["scans"] for r in spark.read.parquet(out).collect()}
    # the last window stays open behind the watermark
    assert got and all(batch[k] == v for k, v in got.items())
