"""Importance resampling towards a target distribution: documents are drawn by the likelihood ratio of hashed word n-grams.

Features are runs of 1 to `n` consecutive words (A-Z lower-cased; maximal pieces of ASCII letters, digits and characters
beyond ASCII), each in the bucket crc32 % `buckets`. A bucket's gain is floor(1000 ln) of its smoothed share in the target
over its share in the corpus; a document's weight is the sum of its features' gains. The draw adds Gumbel noise, made from a
hash of the document's id, to the weights and takes the highest sums, which draws without replacement in proportion to the
exponentials of the weights.

Method. The texts of a block are joined with a separator that is no word character; one pass of one pattern finds all words
with their places; a search of the places among the documents' first bytes gives each word its document, and features
whose first and last word lie in different documents are left out before the buckets are counted. Counts leave a task as one
row for each bucket, so that shuffles are bounded by tasks times buckets. The gains, one number for each bucket, go to the
tasks with the function. The rank comes from rows sorted by ranges, with each range's size counted; no task sees all rows.

Memory is bounded by a block of about BLOCK characters or the longest text. Nulls and empty texts have no features, weight 0,
and are never drawn where a least number of words is asked for; repeated rows count and are drawn each for itself; a null id
hashes as the empty text and is ordered last in ties; empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelproof.llm.common import Memo, blocks, stored, texts

#: Words of UTF-8 bytes after lower-casing; a newline is none of them.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\n"
BLOCK = 1 << 20
#: Words whose buckets a worker keeps.
KEPT_WORDS = 500_000


class Hasher:
    """Buckets of the features of many texts, and the number of the text each belongs to."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets = n, buckets
        self.memo = Memo(lambda features: list(map(self.bucket, features)), KEPT_WORDS)

    def bucket(self, feature: bytes) -> int:
        return zlib.crc32(feature) % self.buckets

    def features(self, values: list[str]):
        """(words of each text, [(text numbers, buckets) for each n-gram length])."""
        raw = [v.encode().lower() for v in values]  # bytes.lower() changes A-Z only
        first = np.concatenate(([0], np.cumsum([len(r) + len(SEPARATOR) for r in raw])))[:-1]
        found = [(m.start(), m[0]) for m in WORD.finditer(SEPARATOR.join(raw))]
        words = [w for _, w in found]
        owner = np.searchsorted(first, np.fromiter((at for at, _ in found), np.int64, len(found)), "right") - 1
        out = [(owner, np.fromiter(map(self.memo.getter(set(words)), words), np.int64, len(words)))]
        for k in range(2, self.n + 1):
            inside = owner[k - 1 :] == owner[: max(len(words) - k + 1, 0)]
            grams = zip(*(words[j:] for j in range(k)), strict=False)
            hashed = np.fromiter((self.bucket(b" ".join(g)) for g, one in zip(grams, inside.tolist(), strict=True) if one), np.int64)
            out.append((owner[: inside.size][inside], hashed))
        return np.bincount(owner, minlength=len(values)), out


def feature_counts(rows: DataFrame, n: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, n) over all texts; buckets without features are left out."""

    def run(batches):
        hasher, totals = Hasher(n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            values = texts(batch.column(0))
            for a, b in blocks(values, BLOCK):
                for _, hashed in hasher.features(values[a:b])[1]:
                    totals += np.bincount(hashed, minlength=buckets)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["bucket", "n"])

    return rows.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket from the counts of both."""
    rows = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # one row for each bucket at most
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    ratio = (t + 1.0) * (s.sum() + float(buckets)) / ((s + 1.0) * (t.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weighted(docs: DataFrame, gain: list[int], n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of doc_id, text."""
    buckets = len(gain)

    def run(batches):
        hasher, worth = Hasher(n, buckets), np.array(gain, np.float64)  # sums of whole numbers, exact in doubles
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in blocks(values, BLOCK):
                words, lengths = hasher.features(values[a:b])
                features, weight = np.zeros(b - a, np.int64), np.zeros(b - a)
                for owner, hashed in lengths:
                    features += np.bincount(owner, minlength=b - a)
                    weight += np.bincount(owner, worth[hashed], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words), pa.array(features), pa.array(weight.astype(np.int64))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = 2024) -> DataFrame:
    """The rows with score: the weight and Gumbel noise, in thousandths, from a hash of the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(rows: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """The rows with rank 1, 2, ... for the floor(percent N / 100) highest scores of the N rows with least_words or more
    (ties: smaller doc_id), null for all others."""
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    order = [F.when(able, 0).otherwise(1).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed, "places")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(able).alias("able"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each range, no more
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(F.sum("able").over(every) * percent / 100).alias("drawn"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    joined = placed.join(F.broadcast(sizes), part == F.col("part"))
    return joined.select(*(c for c in rows.columns if c != "tie"), F.when(rank <= F.col("drawn"), rank).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document of doc_id, text; target has text."""
    gain = gains(feature_counts(docs, n, buckets), feature_counts(target, n, buckets), buckets)
    return ranked(scored(weighted(docs, gain, n), seed), percent, least_words)
