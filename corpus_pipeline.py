"""A pipeline over `documents`: toxic documents go, of near copies one stays, benchmark passages are cut out, personal data
is masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the folder that all executors
share and hands what it reads back to the next. A stage works on all that its predecessor kept. All but the last return
the columns of documents; n_chars follows a changed text. Models are learned from the stage's own input (and labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.llm import decontaminate, pii, sentencepiece_viterbi, simhash, toxicity
from labelproof.llm.common import ship, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; a null text has none to score and stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    others = [c for c in docs.columns if c != "text"]
    scored = toxicity.score(docs.select(*others, "text"), model, spans=False)
    return scored.where((F.col(scored.columns[-1]) < toxicity.THRESHOLD) | F.col("text").isNull()).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that hold a benchmark window are cut out of the texts."""
    others = [c for c in docs.columns if c != "text"]
    found = decontaminate.find_leaks(docs.select(*others, "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), others)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(decontaminate.cut(F.col("text"), F.col(found.columns[-1])["spans"]))
    return counted(found.withColumn("text", text), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the name of their kind."""
    return counted(pii.masked_docs(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_ids, ids, and the text decoded from them, of each document that is left."""
    rows = sentencepiece_viterbi.encoded(docs.select("doc_id", "lang", "source", "n_chars", "text"), back=True)
    return rows.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("decoded").alias("text"))


def counted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the length of the new text."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("pii", mask_personal_data),
    ("sentencepiece", encode),
]

#: The learned and iterative stages can't be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
