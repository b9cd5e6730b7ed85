"""An audit that reads a part of the evidence pays for that part alone, and gets the values of the whole."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__
from labelproof.operators import evidence as E
from labelproof.operators import fixed_checks as K
from labelproof.operators import payload as P
from labelproof.operators import reports as Q
from labelproof.plans import audit as A
from labelproof.sources import corpus

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def evidence(spark, carrier, reads=None):
    few = lambda df: df.filter("label_id % 7 < 2")
    return E.evidence(few(corpus.labels(spark, SF, carrier)), few(corpus.scans(spark, SF, carrier)), carrier, reads)


def test_audit_mode_does_not_read_addresses(spark):
    """neither blocks, postcode lines nor the parts of a DataMatrix are derived to detect the mode."""
    text = plan(spark, "detect_mode_and_variant")
    for gone in ("prohibited goods", "criminal offence", "Dead", "invalidLiteralSeparators", "article(s): "):
        assert gone not in text, gone


def test_inputs_derive_the_columns_they_hand_on(spark):
    """Labels derive no QR payload, and scans no text."""
    text = corpus.labels(spark, SF, "startrack")._jdf.queryExecution().optimizedPlan().toString()
    assert "rpad" not in text and "CAROL RECEIVER" in text
    assert "ST KILDA" not in corpus.scans(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("carrier", ["eparcel", "startrack"])
def test_parts_equal_the_whole(spark, carrier):
    sets = {
        "header": Q.HEADER_READS[carrier], "ids": P.IDS_READS[carrier], "values": P.VALUES_READS[carrier],
        "mode": ("detected.carrier", "detected.format", "variant"), **{f: K.reads(carrier, (f,)) for f in K.FAMILIES},
    }
    whole = {r.label_id: r for r in evidence(spark, carrier).collect()}
    for name, reads in sets.items():
        rows = evidence(spark, carrier, reads).select("label_id", *[F.col(r).alias(r.replace(".", "_")) for r in reads]).collect()
        assert len(rows) == len(whole) > 300, name
        for row in rows:
            for r in reads:
                value = whole[row.label_id]
                for step in r.split("."):
                    value = value[step]
                assert row[r.replace(".", "_")] == value, (name, row.label_id, r)


def test_reading_more_than_declared_is_an_error(spark):
    with pytest.raises(AnalysisException):
        evidence(spark, "eparcel", ("facts.articleIds",)).select("facts.toBlock")
    with pytest.raises(AnalysisException):
        evidence(spark, "eparcel", ("facts.articleIds",)).select("detected")


def test_reaudit_joins_the_options_once_and_builds_no_texts(spark, tmp_path):
    """one join, the expectations of labels without options kept, and the rows of a re-audit with texts."""
    evidence(spark, "eparcel").write.parquet(str(tmp_path / "ev"))
    ev = spark.read.parquet(str(tmp_path / "ev"))
    options = ev.filter("label_id % 3 = 0").select(
        "label_id", F.lit("9315345").alias("sscc_company_prefix"), F.lit("3").alias("sscc_extension_digit"))
    new = A.with_options(ev, options)
    assert new.columns == ev.columns
    assert new._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    fresh = {r.label_id: r.expected_sscc for r in new.select("label_id", "expected_sscc").collect()}
    old = {r.label_id: r.expected_sscc for r in ev.select("label_id", "expected_sscc").collect()}
    assert fresh.keys() == old.keys()
    assert all(v.companyPrefix == "9315345" and v.extensionDigit == "3" if k % 3 == 0 else v == old[k] for k, v in fresh.items())
    brief = A.reaudit(ev, "eparcel", options=options, detail=False)
    cols = ["label_id", "id", "severity", "status"]
    assert "message" not in brief.columns
    full = A.reaudit(ev, "eparcel", options=options)
    assert sorted(brief.select(*cols).collect()) == sorted(full.select(*cols).collect())
