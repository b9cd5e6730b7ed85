"""Benchmark decontamination: an FM-index for each block of documents, searched for the windows of all test items.

Words: A-Z in lower case, then runs of digits, letters a-z and characters beyond ASCII. A window is `size` consecutive
words of an item; a shorter item that has words is one window. Every block of documents (an Arrow batch, whose size
Spark bounds) is indexed over its runs of words that occur in the benchmark; a run shorter than the shortest window
can't hold one and is left out. Nothing is shuffled; the benchmark is taken in slices of bounded size, one pass each.

Null and empty texts have no words. Items without words, or whose id is null, are ignored. Items that share an id count
once. Repeated documents give repeated rows. Empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.common import fresh
from labelproof.llm.fm_index import FMIndex

WINDOW = 10
#: Characters of benchmark text that are sent to the tasks at once.
SLICE_CHARS = 16_000_000
#: Every byte that is no word character becomes a space, A-Z become a-z.
FOLD = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Phrases:
    """The different windows of some items, as ids of their words, and the items of each."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            words = words_of(text or "")
            for k in range(max(1, len(words) - size + 1) if words else 0):
                owners.setdefault(tuple(words[k : k + size]), set()).add(item)
        self.ids: dict[bytes, int] = {}
        for window in owners:
            for word in window:
                self.ids.setdefault(word, len(self.ids) + 1)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.lengths.min()) if owners else 0
        self.patterns = np.zeros((len(owners), size), np.int64)
        for row, window in enumerate(owners):
            self.patterns[row, : len(window)] = [self.ids[w] for w in window]
        self.owners = [sorted(x) for x in owners.values()]

    def find(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; (text, first word, window) of every occurrence."""
        counts, parts, starts, base = [], [], [], []
        get = self.ids.get
        for doc, text in enumerate(texts):
            words = words_of(text)
            counts.append(len(words))
            if len(words) < self.shortest or not self.shortest:
                continue
            ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
            for first, last in zip(edges[::2], edges[1::2], strict=True):
                if last - first >= self.shortest:
                    parts += (ids[first:last], [0])
                    starts.append(first)
                    base.append((doc, last - first + 1))
        if not parts:
            empty = np.zeros(0, np.int64)
            return counts, empty, empty, empty
        index = FMIndex(np.concatenate(parts), len(self.ids) + 1)
        low, high = index.search(self.patterns, self.lengths)
        found = np.repeat(np.arange(len(low)), high - low)
        rows = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[found]
        at = index.locate(rows)
        doc_of, sizes = np.array(base, np.int64).T
        offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        run = np.searchsorted(offsets, at, "right") - 1
        return counts, doc_of[run], np.array(starts, np.int64)[run] + at - offsets[run], found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans, end exclusive, of ranges of words."""
    if not hits:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b in hits]


def searcher(phrases, schema: pa.Schema, n_keep: int):
    """A batch function: kept columns, text and the result so far -> kept columns, text, result with this slice's hits."""

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(n_keep).to_pylist()]
            counts, docs, firsts, windows = phrases.value.find(texts)
            before = batch.column(n_keep + 1).to_pylist()
            ranges = [[(h["from"], h["to"]) for h in b["hits"]] if b else [] for b in before]
            items = [set(b["items"]) if b else set() for b in before]
            lengths, owners = phrases.value.lengths, phrases.value.owners
            for doc, first, window in zip(docs.tolist(), firsts.tolist(), windows.tolist(), strict=True):
                ranges[doc].append((first, first + int(lengths[window])))
                items[doc].update(owners[window])
            out = []
            for text, n, found, ids in zip(texts, counts, ranges, items, strict=True):
                hits = merged(found)
                out.append({
                    "n_words": n, "hits": [{"from": a, "to": b} for a, b in hits], "items": sorted(ids),
                    "spans": [{"start": a, "end": b} for a, b in char_spans(text, hits)],
                })
            result = pa.array(out, schema.field(len(schema) - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_keep + 1], result], schema=schema)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", size: int = WINDOW) -> DataFrame:
    """keep columns, the text, and leak: n_words, hits (ranges of words), spans (ranges of code points), items. Where
    keep has a column leak, the new one has underscores at its end."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = max(1, math.ceil(total / SLICE_CHARS))
    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"), F.lit(None).cast(RESULT).alias("leak"))
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).collect()
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in rows], size))
        out = out.mapInArrow(searcher(phrases, to_arrow_schema(out.schema), len(keep)), out.schema)
    return out.toDF(*keep, text, fresh("leak", [*keep, text]))


def cut(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("out"),
        s["end"].alias("at"),
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs, benchmark, ["doc_id"])
    zero = F.lit(0).cast("long")
    names = F.array_sort(F.transform("leak.items", lambda i: i.cast("string")))
    n_hit = F.aggregate("leak.hits", zero, lambda acc, h: acc + h["to"] - h["from"])
    return found.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("leak.hits") > 0).alias("contaminated"),
    )


def sha(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
