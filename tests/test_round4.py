"""Full audits over large tables: what is derived once, and patterns and trims that cost less and say the same."""

import pytest
from pyspark.sql import functions as F
from test_round3 import few, same_as_sql  # noqa: F401

import __spark_entry__
from labelproof.functions import strings as S
from labelproof.operators import label_text as X
from labelproof.operators import payload as P
from labelproof.plans import audit as A
from labelproof.plans import queries as Q

KEYS = (9, 19, 29, 39, 40, 47, 55, 13, 32, 31746)


def test_coded_checks_and_rules_share_the_evidence(spark, few):  # noqa: F811
    folder = few(*KEYS)
    plan = __spark_entry__.queries()["audit_flagship"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert sum("collect_list(item" in line for line in plan.splitlines()) == 1
    ok, message, n = same_as_sql(spark, "audit_flagship", folder)
    assert ok and n == len(KEYS), message


@pytest.mark.parametrize("carrier", ["eparcel", "startrack"])
def test_statuses_without_texts_are_those_with_texts(spark, few, carrier):  # noqa: F811
    ev = Q.evidence(spark, few(*KEYS), carrier)
    names = ("label_id", "result_seq", "id", "rule_id", "severity", "category", "status")
    brief, full = ({tuple(r) for r in A.results_of(ev, carrier, detail=d).select(*names).collect()} for d in (False, True))
    assert brief == full and any(r[3] is None and r[1] < 0 for r in brief) and any(r[3] for r in brief)


@pytest.mark.parametrize("name", ["product_matrix_payload", "compare_results"])
def test_payload_queries_end_in_saved_rows(spark, few, name):  # noqa: F811
    """Orders are not decoded again by each plan that goes through labels, cells, result rows or payloads."""
    files = __spark_entry__.queries()[name](spark, few(*KEYS)).inputFiles()
    assert files and not [f for f in files if "orders.parquet" in f]


def test_repeated_labels_are_not_compared_twice(spark):
    """Labels that come twice are an error, as they were; a label without a payload is not compared."""
    none = "array<string>"
    kinds = ("article", "consignment", "product", "postcode", "weight", "cube", "date", "branding", "receiver", "sender")
    schema = f"label_id bigint, payload_id bigint, identities {none}, identifiable boolean, " + "".join(f"{k}_values {none}, " for k in kinds) + (
        "service_code string, label_dg boolean")
    row = lambda k: (k, k, ["ABCDEF1"], True, *[["ABCDEF1"] if n == "article" else [] for n in kinds], None, None)
    results = spark.createDataFrame([(k, "EP-ART-01", "") for k in (1, 2)], "label_id bigint, id string, actual string")
    payloads = P.prepare_payloads(spark.createDataFrame([(1, '{"id": "ABCDEF1"}')], "payload_id bigint, raw_text string"))
    compared = lambda *keys: P.compare_results(results, spark.createDataFrame([row(k) for k in keys], schema), payloads, False)
    assert {(r["label_id"], r["payload_status"]) for r in compared(1, 2).collect()} == {(1, "match"), (2, None)}
    with pytest.raises(Exception, match="repeat"):
        compared(1, 1).collect()


TEXTS = ["NZ", "ANZ NZ", "xNZ", "éNZ", "_NZ", "-NZ-", "NZx", "5kg", "a5kg", "x 12.50 KG.", "1 5.5kgs", "2170", "a2170", "2170b 3000", "éß2000 ", "exp EXP1", "TSE", "İkg"]


@pytest.mark.parametrize("pattern", [r"\bNZ\b", r"\b([0-9]+(?:\.[0-9]+)?)\s*kg\b", r"\b(\d{4})\b", r"\b(TSE|RET|EXP)\b", r"\b(?:a\d|[0-9])x?", r"\bA?NZ"])
def test_known_first_letter_stands_in_for_the_boundary(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    plain = "(?i)" + pattern.replace(r"\b", S.WORD_EDGE).replace(r"\s", f"[{S.WS_CLASS}]")
    found = lambda p: F.regexp_extract_all(F.col("v"), F.lit(p), F.lit(0))
    assert all(r[0] == r[1] for r in df.select(found(S.rx(pattern, "i")), found(plain)).collect())
    assert S.rx(r"\bNZ\b").startswith("(?=[N])") and S.rx(r"\bA?NZ").startswith(S.WORD_EDGE)


def test_trims_of_odd_ends(spark):
    ends = ["", " ", " ", "﻿", " ", "\t", "é", "\x00", "\x7f", "a", "~", "!", "日"]
    df = spark.createDataFrame([(a + m + b,) for a in ends for m in ("", "x y", " ") for b in ends] + [(None,)], "v string")
    for r in df.select("v", S.trim(F.col("v")).alias("t"), S.trim_value(F.col("v")).alias("c"), S.is_blank(F.col("v")).alias("b")).collect():
        assert r["c"] == r["t"] and r["b"] == (r["t"] in (None, "")), r


def test_lines_without_a_word_are_not_tried(spark):
    """The first line that holds the word and matches counts, in any case; the Kelvin sign is no k to the pattern."""
    rows = [(["7 Kg", "8 Kg x", "9kg"], "8"), (["kg", "no"], None), ([], None)]
    df = spark.createDataFrame(rows, "ls array<string>, want string")
    for r in df.select("want", X.first_value(F.col("ls"), r"\b([0-9]+)\s*kg\b", word="kg").alias("got")).collect():
        assert r["got"] == r["want"]


def test_prefixes_and_noise_of_merged_lines(spark):
    rows = [("AUSTRALIA POSTAL CORPORATION  X", "X"), ("Level 5 A   Y", "Y"), ("PRESTONS NSW 2170  Z", "Z"), (" plain", "plain"), ("Declaration", "Declaration")]
    for r in spark.createDataFrame(rows, "v string, want string").select("want", X.strip_sender(F.col("v")).alias("got")).collect():
        assert r["got"] == r["want"]
    rows = [("1 Road   Declaration", "1 Road"), ("1 Road Declaration", "1 Road"), ("A St the sender acknowledges b", "A St"), ("Athe sender acknowledges", "Athe sender acknowledges")]
    for r in spark.createDataFrame(rows, "v string, want string").select("want", X.clean_address(F.col("v")).alias("got")).collect():
        assert r["got"] == r["want"]
