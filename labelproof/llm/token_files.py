"""Token ids in ORC files: documents in id order, integer run lengths, row indexes and Bloom filters on document ids.

Writing: documents are dealt by ranges of doc_id and sorted inside each range; the task that writes a range encodes its
texts, so that the network carries texts and never ids. A file's rows hold doc_id, part (the range's number), local_start
(ids before the document in its range), n_tokens and ids. ORC stores the integers by run-length encoding in stripes with
row indexes; doc_id has a Bloom filter, so that readers skip stripes by their metadata.

Reading: `read_tokens` reads stripes in parallel; a document's place among all ids is its range's base, from one small
table with a row for each range, plus local_start. `lookup` pushes doc_id = x down to the row indexes and Bloom filters.

Texts are encoded by words: white space ends a token in this vocabulary, so Arrow splits a block of texts at ASCII white
space and numbers its different pieces; each of those is encoded by the tokenizers library once, its ids are kept in a
table of bounded size, and the ids of the texts are gathered by piece number. Python touches a block's different pieces only.

A null text is empty and holds the end id alone. Null doc_ids come first; rows that repeat a doc_id are all kept, next to
each other. An empty table gives files without rows.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelproof.llm.common import Memo

#: The id that ends each document.
END_ID = 1
#: Pieces of text whose ids a worker keeps.
KEPT_PIECES = 500_000
#: Pieces that are encoded in one call.
CALL_PIECES = 2_000
#: Rare characters, the first of which with an id of its own stands between pieces.
SEPARATORS = "\U0001f389\U0001f381\u2600\u2764"
#: Bytes of text that are encoded together. A block's words, numbers and ids take about ten times as much at their peak.
BLOCK_BYTES = 8 << 20
#: Pieces of letters, digits and punctuation that the vocabulary's pattern splits as WORDS does: no apostrophes, no special
#: strings, nothing that normalisation could join.
SIMPLE = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch
WORDS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+").findall
STRIPE_BYTES = 16 << 20
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, as the library gives them without special tokens, from ids of the pieces between spaces.

    New pieces are encoded many at a time: simple ones with a space between them, cut apart after as many word ends as they
    have words, others with a character between them that has an id of its own; pieces with that character alone. Pieces that come back are kept, KEPT_PIECES at most.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = self.separator()
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.memo = Memo(self.learned, KEPT_PIECES)

    def separator(self) -> tuple[str, int]:
        """A character with an id of its own (an id of whole bytes that no other character has), and the id."""
        for c in SEPARATORS:
            ids = self.tokenizer.encode(c, add_special_tokens=False).ids
            if len(ids) == 1:
                return c, ids[0]
        raise ValueError("the vocabulary has none of the separators as an id of its own")

    def learned(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        simple = [k for k, p in enumerate(pieces) if SIMPLE(p)]
        other = [k for k, p in enumerate(pieces) if not SIMPLE(p) and self.mark not in p]
        odd = [k for k, p in enumerate(pieces) if self.mark in p]
        for k, found in zip(odd, self.tokenizer.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(found.ids, "<i4").tobytes()
        for part, ids in self.called(simple, pieces, " "):
            ends = np.flatnonzero(self.closes[ids]) + 1  # of words, of which a piece has as many as the pattern counts
            cuts = ends[np.cumsum(np.fromiter((len(WORDS(pieces[k])) for k in part), np.int64, len(part))) - 1] * 4
            raw = ids.tobytes()
            for k, first, end in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                out[k] = raw[first:end]
        for part, ids in self.called(other, pieces, f" {self.mark} "):
            marks = np.flatnonzero(ids == self.mark_id) * 4
            raw = ids.tobytes()
            for k, first, end in zip(part, [0, *(marks + 4).tolist()], [*marks.tolist(), len(raw)], strict=True):
                out[k] = raw[first:end]
        return out

    def called(self, chosen: list[int], pieces: list[str], between: str):
        """(numbers of some pieces, the ids of these joined)."""
        for a in range(0, len(chosen), CALL_PIECES):
            part = chosen[a : a + CALL_PIECES]
            joined = between.join([pieces[k] for k in part])
            yield part, np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<i4")

    def table(self, pieces: list[str]) -> pa.ListArray:
        """The ids of each piece."""
        raw = self.memo.values(pieces)
        offsets = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, raw), np.int32, len(raw)) // 4, out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4").astype(np.int32, copy=False)))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, and the end id."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # the vocabulary has no upper case
        numbered = lists.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_pylist()
        table = pa.concat_arrays([self.table(pieces), pa.array([[END_ID]], pa.list_(pa.int32()))])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        words = np.insert(numbered.indices.to_numpy(), ends, len(pieces))  # the end id is one more piece
        found = table.take(pa.array(words))
        text_ends = ends + np.arange(1, ends.size + 1)
        return pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[np.concatenate(([0], text_ends))]), found.values)


#: One encoder for each file, for the life of the worker process.
ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def text_blocks(texts: pa.Array):
    """Ranges of texts of about BLOCK_BYTES."""
    sizes = pc.binary_length(texts).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_BYTES)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True) if len(texts) else ()


def writer(path: str):
    def run(batches):
        from pyspark import TaskContext

        part, start, encoder = TaskContext.get().partitionId(), 0, encoder_of(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in text_blocks(texts):
                ids = encoder.encode(texts.slice(a, b - a))
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                before = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(before), pa.array(sizes), ids], schema=ARROW)
                del ids
                pa.default_memory_pool().release_unused()  # the JVM writes beside the worker: what a block took goes back

    return run


def write_tokens(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Writes the ids of doc_id, text to ORC files in a folder all executors share."""
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(writer(path or vocabulary()), SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option(
        "orc.bloom.filter.fpp", "0.01"
    ).option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", "10000").option("orc.compress", "ZLIB").orc(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).orc(path)
    ranges = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, no more
    base = ranges.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document; row indexes and Bloom filters prune the stripes."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "n_tokens", "ids")


def digests(batch: pa.RecordBatch):
    """ids_crc32 in place of ids, the last column."""
    lists = batch.column(batch.num_columns - 1)
    raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    at = lists.offsets.to_numpy() * 4
    crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], crc], names=[*batch.schema.names[:-1], "ids_crc32"])
