"""Rule sets as a table: base and variant documents merged with joins.

A rule directory holds ``<carrier>/<variant>.json`` documents, ``base`` being the set the
others extend. A variant overrides its base field by field by rule id, appends new rules
and can disable rules; constants overlay and ``{{name}}`` tokens are filled in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.plans.rule_catalog import DOCUMENTS

TEXT_FIELDS = {
    "title": "title", "description": "description", "obligation": "obligation", "severity": "severity",
    "category": "category", "for_each": "forEach", "input": "input", "on_missing": "onMissing",
    "on_empty": "onEmpty", "fail_status": "failStatus",
}
JSON_FIELDS = {
    "when_json": "when", "item_when_json": "itemWhen", "assert_json": "assert", "source_json": "source",
}


def rule_documents(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(carrier, variant, doc) rows, from a directory or from the built-in catalogue."""
    if path is None:
        rows = [(c, v, json.dumps(d)) for c, docs in DOCUMENTS.items() for v, d in docs.items()]
        return spark.createDataFrame(rows, "carrier string, variant string, doc string")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name = F.input_file_name()
    return files.select(
        F.regexp_extract(name, r"([^/]+)/[^/]+\.json$", 1).alias("carrier"),
        F.regexp_extract(name, r"([^/]+)\.json$", 1).alias("variant"),
        F.regexp_replace("value", "^\\x{feff}", "").alias("doc"),
    )


def load_rules(spark: SparkSession, path: str | None = None, documents: DataFrame | None = None) -> DataFrame:
    """The flat, merged rule table: one row per (carrier, variant, rule), in evaluation order.

    Documents come from a directory, from a table (carrier, variant, doc) or, without either, from the catalogue."""
    docs = rule_documents(spark, path) if documents is None else documents
    docs = docs.select("carrier", "variant", F.parse_json("doc").alias("v"))
    sets = docs.selectExpr(
        "carrier", "variant", "try_variant_get(v, '$.id', 'string') as rule_set",
        "try_variant_get(v, '$.name', 'string') as rule_set_name",
        "to_json(try_variant_get(v, '$.spec', 'variant')) as spec_json",
        "coalesce(try_variant_get(v, '$.constants', 'map<string,variant>'), cast(map() as map<string,variant>)) as constants",
        "v",
    )
    fields = [f"try_variant_get(r.value, '$.{j}', 'string') as {c}" for c, j in TEXT_FIELDS.items()]
    fields += [f"to_json(try_variant_get(r.value, '$.{j}', 'variant')) as {c}" for c, j in JSON_FIELDS.items()]
    rules = sets.selectExpr(
        "carrier", "variant", "posexplode(try_variant_get(v, '$.rules', 'array<variant>')) as (pos, value)"
    ).selectExpr("carrier", "variant", "pos", "named_struct('value', value) as r").selectExpr(
        "carrier", "variant", "pos", "try_variant_get(r.value, '$.id', 'string') as rule_id", *fields,
        "try_variant_get(r.value, '$.evidence', 'array<string>') as evidence",
        "try_variant_get(r.value, '$.messages', 'map<string,string>') as messages",
        "try_variant_get(r.value, '$.reportWhenSkipped', 'boolean') as report_when_skipped",
        "try_variant_get(r.value, '$.disabled', 'boolean') as disabled",
    )
    names = [c for c in rules.columns if c not in ("carrier", "variant", "pos", "rule_id")]
    heads = sets.select("carrier", "variant", "rule_set", "rule_set_name", "spec_json", "constants")
    base_head = heads.filter("variant = 'base'").select(
        "carrier", F.col("spec_json").alias("base_spec"), F.col("constants").alias("base_constants"))
    heads = heads.join(base_head, "carrier", "left").select(
        "carrier", "variant", "rule_set", "rule_set_name",
        F.coalesce("spec_json", "base_spec").alias("spec_json"),
        F.expr("map_zip_with(coalesce(base_constants, constants), constants, (k, a, b) -> coalesce(b, a))").alias("constants"),
    )
    # every variant starts from its base's rules ...
    base = rules.filter("variant = 'base'").drop("variant")
    inherited = heads.select("carrier", "variant").join(base, "carrier").select(
        "carrier", "variant", "rule_id", F.col("pos").alias("base_pos"), *[F.col(n).alias(f"b_{n}") for n in names])
    # ... and overrides them field by field
    own = rules.filter("variant <> 'base'").withColumnRenamed("pos", "own_pos")
    merged = inherited.join(own, ["carrier", "variant", "rule_id"], "full_outer").select(
        "carrier", "variant", "rule_id",
        F.coalesce(F.col("base_pos"), F.col("own_pos") + 100000).alias("pos"),
        *[F.coalesce(F.col(n), F.col(f"b_{n}")).alias(n) for n in names],
    )
    merged = merged.filter(~F.coalesce(F.col("disabled"), F.lit(False))).drop("disabled")
    out = merged.join(heads, ["carrier", "variant"])
    # {{name}} -> a|b|c inside the JSON texts; unknown tokens stay
    plain = "case when schema_of_variant(e.value) like 'ARRAY%' then array_join(cast(e.value as array<string>), '|') else cast(e.value as string) end"
    tokens = f"transform(map_entries(constants), e -> named_struct('k', '{{{{' || e.key || '}}}}', 't', {plain}))"
    out = out.withColumn("_tokens", F.expr(tokens))
    for c in ("assert_json", "when_json", "item_when_json"):
        # the constant goes into JSON text, so it is written the way JSON escapes it
        out = out.withColumn(c, F.expr(
            f"aggregate(_tokens, {c}, (acc, t) -> replace(acc, t.k, substring(to_json(array(t.t)), 3, length(to_json(array(t.t))) - 4)))"))
    return out.select(
        "carrier", "variant", "rule_set", "rule_set_name", "rule_id", "pos", *[n for n in names if n != "disabled"],
        F.to_json("constants").alias("constants_json"), "spec_json",
    )


def rule_sets(table: DataFrame, carrier: str) -> dict[str, dict]:
    """Variant -> rule set for plan building. Collects rule rows only: a few hundred at most,
    their number set by the rule files and never by the data audited."""
    out: dict[str, dict] = {}
    for r in table.filter(F.col("carrier") == carrier).orderBy("variant", "pos").collect():
        doc = out.setdefault(
            r["variant"],
            {"id": r["rule_set"], "name": r["rule_set_name"], "constants": json.loads(r["constants_json"] or "{}"), "rules": []},
        )
        rule = {"id": r["rule_id"]}
        rule |= {j: r[c] for c, j in TEXT_FIELDS.items() if r[c] is not None}
        rule |= {j: json.loads(r[c]) for c, j in JSON_FIELDS.items() if r[c] is not None}
        rule |= {"evidence": list(r["evidence"])} if r["evidence"] else {}
        rule |= {"messages": dict(r["messages"])} if r["messages"] else {}
        rule |= {"reportWhenSkipped": True} if r["report_when_skipped"] else {}
        doc["rules"].append(rule)
    return dict(sorted(out.items(), key=lambda kv: (kv[0] != "base", kv[0])))


def merge(base: dict, variant: dict) -> dict:
    """One variant over its base, for documents already in memory."""
    if variant is base:
        return base
    by_id = {r["id"]: r for r in base["rules"]}
    for r in variant["rules"]:
        by_id[r["id"]] = {**by_id.get(r["id"], {}), **r}
    constants = {**base.get("constants", {}), **variant.get("constants", {})}
    kept = [r for r in by_id.values() if not r.get("disabled")]
    return {**base, **variant, "constants": constants, "rules": kept}


def built_in(spark: SparkSession, carrier: str) -> dict[str, dict]:
    """The catalogue's merged rule sets; no Spark job, the documents are part of the package."""
    docs = DOCUMENTS[carrier]
    return {v: merge(docs["base"], d) for v, d in docs.items()}
