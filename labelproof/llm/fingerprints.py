"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of the hash range is kept.

Shingles are five consecutive words of the lower-case text (fewer words: one shingle of all). Because the threshold is the
same for all documents, fingerprints of parts can be merged by union, and the kept hashes of two documents of very
unequal size estimate containment and likeness (Jaccard similarity) without bias. All expressions are Spark's own.

Null is the empty text; without words nothing is kept. Two fingerprints without hashes are alike (1.0) if the texts are
equal, else not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes whose top bits are all zero are kept: a fraction of 1 / 2 ** KEPT_BITS.
KEPT_BITS = 2
SHINGLE = 5
#: doc_ids that share these upper bits are sorted together.
BUCKET_BITS = 8


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a lambda a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")

    def shingles(hashed: Column) -> Column:
        last = F.size(hashed) - SHINGLE
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(SHINGLE)]))
        few = F.transform(F.slice(hashed, 1, 1), lambda _: F.xxhash64(hashed))
        return F.when(last >= 0, many).otherwise(few)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def sketch(text: Column) -> Column:
    """The kept hashes in ascending order."""
    return F.array_sort(F.array_distinct(F.filter(shingle_hashes(text), lambda h: F.shiftrightunsigned(h, 64 - KEPT_BITS) == 0)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of two documents' shingles."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The estimated part of a's shingles that b has; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """The estimated Jaccard similarity; equal: whether the texts are equal, for sketches without hashes."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(equal.cast("double"))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_lower(keys: DataFrame, lowest: int, highest: int) -> DataFrame:
    """(k, next): the next lower of the different keys, the highest for the lowest. Groups of 2 ** BUCKET_BITS keys at
    each level of a radix tree, so that no task orders all keys."""
    group = F.shiftright("k", BUCKET_BITS)
    within = keys.select("k", F.lead("k").over(Window.partitionBy(group).orderBy(F.desc("k"))).alias("n"), group.alias("g"))
    tops = keys.groupBy(group.alias("k")).agg(F.max("k").alias("top"))
    if lowest >> BUCKET_BITS == highest >> BUCKET_BITS:
        after = tops.select(F.col("k").alias("g"), "top")
    else:
        above = next_lower(tops.select("k"), lowest >> BUCKET_BITS, highest >> BUCKET_BITS)
        after = above.withColumnsRenamed({"k": "g", "next": "k"}).join(tops, "k").select("g", "top")
    return within.join(after, "g").select("k", F.coalesce("n", "top").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, kept (its sketch), next_text, next_kept: of the next document by descending doc_id, the first after
    the last.

    Texts cross the network once, by the upper bits of doc_id; the first document of each bucket is also sent to the
    bucket above it. Rows that share a doc_id follow each other by their text's hash. Rows without a doc_id have no next
    document (empty text, null sketch).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"bucket": F.shiftright("doc_id", BUCKET_BITS), "h": F.xxhash64("text")})
    alone = rows.where("doc_id is null").withColumn("kept", sketch(F.col("text")))
    alone = alone.select("doc_id", "text", "kept", F.lit("").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_kept"))
    known = rows.where("doc_id is not null")
    tops = known.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top"))
    lowest, highest = known.agg(F.min("bucket"), F.max("bucket")).first()
    if lowest is None:
        return alone
    chain = next_lower(tops.select(F.col("bucket").alias("k")), lowest, highest)
    sent = tops.join(chain, tops.bucket == chain.next).select(F.col("top.doc_id").alias("doc_id"), F.col("top.h").alias("h"), F.col("k").alias("to"))
    guests = known.join(sent, ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "to"])
    guests = guests.select("doc_id", "text", F.col("to").alias("bucket"), "h", F.lit(True).alias("guest"))
    dealt = known.select("doc_id", "text", "bucket", "h", F.lit(False).alias("guest")).unionAll(guests).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.desc("h"))
    follow = dealt.withColumn("kept", sketch(F.col("text"))).withColumns(
        {"next_text": F.lead("text").over(order), "next_kept": F.lead("kept").over(order)}
    )
    return follow.where("not guest").select("doc_id", "text", "kept", "next_text", "next_kept").unionAll(alone)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its text with the second half taken from the next document's start."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_kept", sketch(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("kept")).alias("fingerprint"),
        printed(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("kept"), F.coalesce("next_kept", F.array().cast("array<bigint>")), F.col("text") == F.col("next_text")).alias("near_next"),
    )
