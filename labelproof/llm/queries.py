"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.llm import (
    decontaminate, fingerprints, html_main, importance_resampling, periodic_runs, pii, prefix_counts, secrets, sentencepiece_viterbi, simhash,
    token_files, toxicity, url_filter,
)
from labelproof.llm.common import arrow_map, shared_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
win as (
  select distinct item_id, array_to_string(w[k : k + 9], ' ') as win, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from bw where len(w) > 0)),
sizes as (select distinct n from win),
pos as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from dw, sizes where len(w) >= n),
occ as (
  select doc_id, k, p.n, item_id from (select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as win from pos) p
  join win using (win) where win.n = p.n),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(k, k + n)) as j from occ) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s
  from (select distinct doc_id, item_id from occ) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (doc_id) left join ids using (doc_id)
"""

def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), out)
    read = token_files.read_tokens(spark, out)
    return arrow_map(read, token_files.digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages", "page_id", "url"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.codec_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return importance_resampling.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of a word by its definition: each byte is xored in, then eight shifts; -1 in the list stands for a shift.
OP12_SQL = r"""
with texts as (select 0 as side, doc_id, coalesce(text, '') as text from documents union all select 1, null, coalesce(text, '') from benchmark),
w as (
  select side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
spelled as (select w, hex(encode(w)) as x from (select distinct w from w)),
hashed as (
  select w, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(0, len(x) // 2),
    lambda i: [cast('0x' || substr(x, 2 * i + 1, 2) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, v: case when v >= 0 then xor(c, v) else xor(c >> 1, 3988292384 * (c & 1)) end)) % 10000 as bucket from spelled),
counts as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from w join hashed using (w) group by bucket),
gain as (
  select bucket, floor(1000 * ln(((t + 1.0::double) * ((select sum(s) from counts)::double + 10000)) / ((s + 1.0::double) * ((select sum(t) from counts)::double + 10000)))) as gain
  from counts),
doc as (select doc_id, count(*) as n, sum(gain) as weight from w join hashed using (w) join gain using (bucket) where side = 0 group by doc_id),
scored as (
  select d.doc_id, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from documents d left join doc using (doc_id)),
placed as (select *, row_number() over (order by n_features < 20, score desc, doc_id) as place, count(*) filter (n_features >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end as rank from placed
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_report(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_token_files": op4_token_files,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_pii": op8_pii,
    "op9_html_extraction": op9_html_extraction,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {"op3_benchmark_decontamination": OP3_SQL, "op12_importance_resampling": OP12_SQL}
