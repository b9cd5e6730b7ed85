"""Kept totals of a stream (replay, restart, repeats), uploads made ready for the audit, checks of a user's own."""

import datetime as dt

from pyspark.sql import functions as F
from test_end_to_end import LINEAR, label_row

from labelproof.operators import evidence as E
from labelproof.operators import rules as RU
from labelproof.plans import audit as A
from labelproof.sources import rules as RS
from labelproof.sources import tables as T
from labelproof.sources import versions as VS
from labelproof.streaming import stream_audit as SA

SCANS = "label_id bigint, scan_seq int, raw_value string, format string, ts timestamp"
DAY = dt.datetime(2026, 1, 1, 12)


def scan(label, hours, value=LINEAR):
    return (label, 0, value, "code_128", DAY + dt.timedelta(hours=hours))


def totals(df):
    return {(r["window_start"], r["verdict"]): r["scans"] for r in df.collect()}


def test_kept_totals_survive_replay_restart_and_repeats(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    first = [scan(1, 0), scan(1, 0), scan(2, 1, LINEAR[:-1] + "9"), scan(3, 30)]
    later = [scan(1, 0), scan(4, 2), scan(5, 30, "nothing")]  # one delivered again by a later file
    every = spark.createDataFrame(first + later, SCANS)

    def run(rows):
        spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(every.schema).parquet(src)
        SA.keep_totals(stream, out, chk, delay="2 days").awaitTermination()

    run(first)
    half = totals(SA.read_totals(spark, out))
    assert half == totals(SA.live_totals(spark.createDataFrame(first, SCANS)))
    # a batch that runs again after a loss overwrites its own folder
    SA.batch_writer(out)(SA.live_totals(spark.createDataFrame(first, SCANS)), 0)
    assert totals(SA.read_totals(spark, out)) == half
    run(later)
    whole = totals(SA.read_totals(spark, out))
    assert whole == totals(SA.live_totals(every)) and sum(whole.values()) == 5


def test_state_store_setting_is_put_back(spark, tmp_path):
    before = spark.conf.get(SA.STATE_STORE)
    src = str(tmp_path / "in")
    spark.createDataFrame([scan(1, 0)], SCANS).write.parquet(src)
    stream = spark.readStream.schema(SCANS).parquet(src)
    SA.keep_totals(stream, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    assert spark.conf.get(SA.STATE_STORE) == before


def test_prepared_uploads(spark):
    rows = [label_row(1, "eparcel"), label_row(2, "eparcel"), label_row(3, "eparcel")]
    rows[1] = (*rows[1][:2], "b.exe", "application/octet-stream", *rows[1][4:])
    labels = spark.createDataFrame(rows, T.LABELS)
    seen = "label_id bigint, scan_seq int, raw_value string, format string, kind string"
    scans = spark.createDataFrame(
        [(1, 0, LINEAR, "code_128", "linear"), (1, 1, f" {LINEAR} ", "code_128", "linear"), (1, 2, "  ", "code_128", "linear"),
         (1, 3, None, "code_128", "linear"), (2, 0, LINEAR, "code_128", "linear")], seen)
    lab, sc = A.prepared(labels, scans)
    assert sorted(r["label_id"] for r in lab.collect()) == [1, 3]
    got = {r["label_id"]: r["scan_count"] for r in A.summaries(lab, sc, "eparcel").collect()}
    assert got == {1: 1, 3: 0}
    none = A.prepared(labels.limit(0), scans.limit(0))
    assert none[0].count() == none[1].count() == 0


def test_user_check_equals_its_column_twin(spark):
    RU.register_check("evenLength")(lambda value, scope, args: F.length(value.col) % 2 == 0)
    df = spark.createDataFrame([("ab",), ("abc",), (None,)], "v string")
    out = RU.evaluate({"op": "fn", "name": "evenLength"}, RU.Value(F.col("v"), df.schema["v"].dataType), RU.Scope(df.schema))
    rows = df.select("v", out.ok.alias("ok"), F.coalesce(F.length("v") % 2 == 0, F.lit(False)).alias("twin")).collect()
    assert [r["ok"] for r in rows] == [r["twin"] for r in rows] == [True, False, False]
    unknown = RU.evaluate({"op": "fn", "name": "noSuchCheck"}, RU.Value(F.col("v"), df.schema["v"].dataType), RU.Scope(df.schema))
    assert df.select(unknown.message).first()[0] == "Rule function noSuchCheck is not registered."


def test_versions_are_published_once_and_whole(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert VS.published(spark, folder) == {} and VS.manifest(spark, folder).count() == 0
    assert VS.publish(spark, folder, "a", {"t": spark.range(5)}) == 1
    assert VS.publish(spark, folder, "a", {"t": spark.range(9)}) == 1  # the same key again
    assert VS.read(spark, folder, "t").count() == 5
    spark.range(3).write.parquet(f"{folder}/cut-off/t")  # a write without a manifest row is not seen
    assert VS.publish(spark, folder, "b", {"t": spark.range(7), "u": spark.range(0)}) == 2
    assert VS.published(spark, folder)["t"][1] == 7 and VS.published(spark, folder)["u"][1] == 0
    assert VS.read(spark, folder, "t", 1).count() == 5


def test_refresh_audits_only_what_changed(spark, tmp_path):
    path, folder = str(tmp_path / "ev"), str(tmp_path / "v")
    labels = spark.createDataFrame([label_row(i, "eparcel") for i in (1, 2, 3)], T.LABELS)
    scans = spark.createDataFrame([(i, 0, LINEAR, "code_128", "linear") for i in (1, 2, 3)],
                                  "label_id bigint, scan_seq int, raw_value string, format string, kind string")
    T.save_evidence(E.evidence(labels, scans, "eparcel"), path)
    ev = T.read_evidence(spark, path)
    versions = lambda: {(r["label_id"], r["audited_in"]) for r in VS.read(spark, folder, "results").collect()}
    assert A.refresh(ev, "eparcel", folder, "1") == 1 and versions() == {(1, 1), (2, 1), (3, 1)}
    options = spark.createDataFrame([(2, "9315345", "3")], "label_id bigint, sscc_company_prefix string, sscc_extension_digit string")
    changed = A.with_options(ev.filter("label_id < 3"), options)
    assert A.refresh(changed, "eparcel", folder, "2") == 2 and versions() == {(1, 1), (2, 2)}
    assert A.refresh(ev, "eparcel", folder, "2") == 2 and versions() == {(1, 1), (2, 2)}  # the same key
    sets = RS.built_in(spark, "eparcel")
    sets = {v: {**rs, "rules": rs["rules"][1:]} for v, rs in sets.items()}
    assert A.refresh(changed, "eparcel", folder, "3", sets) == 3 and versions() == {(1, 3), (2, 3)}
    want = {tuple(r) for r in A.results_of(changed, "eparcel", sets).collect()}
    assert {tuple(r) for r in VS.read(spark, folder, "results").drop("audited_in").collect()} == want
