"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation of a text is found while reading it: the scores and backpointers of the positions since the last
boundary are held, a new position looks back no further than the longest piece, and as soon as the paths from all positions
that can still be extended meet in one boundary, the ids before it are given out and forgotten.

Scores: the public model file is a merge model, whose "scores" are ranks. As log-probabilities they would favour many short
pieces; here a piece of rank r counts log(1 / (r + 1)) (Zipf's law), up to a constant. Of the pieces that the file rules out
(score under RULED_OUT), single characters and runs of spaces count as the lowest rank and others are not used. A character without a piece costs the lowest score less UNKNOWN and becomes the ids
of its bytes. The text gets a space in front and spaces become U+2581, as the file's normalizer says; nothing else changes.

Where paths meet is known of a vocabulary beforehand: no usable piece of this one goes on with U+2581 after another
character, so the paths of all positions meet before each run of spaces. The stretch between two such boundaries (spaces and
a word) is searched once while it recurs and its ids are kept in a table of bounded size; long stretches, and whole texts
under a vocabulary without such boundaries, go through the window as they come.

Null and empty texts have no ids. Decoding gives the text back, with U+2581 as a space.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import Memo, blocks

SPACE = "▁"
RULED_OUT = -1e8
UNKNOWN = 10.0
#: Longer words go through the streaming search.
WORD_CHARS = 64
#: Stretches whose ids a worker keeps.
KEPT_STRETCHES = 400_000
#: Stretches between boundaries: spaces and what follows them up to the next.
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file with their ids and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: list[int] = [0] * 256
        self.raw: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            self.raw.append(b"")
            if model.is_byte(k):
                self.bytes[int(piece[3:-1], 16)] = k
                self.raw[k] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.raw[k] = piece.replace(SPACE, " ").encode()
                if model.get_score(k) > RULED_OUT:
                    self.scores[piece] = -math.log(1.0 - model.get_score(k))
                elif len(piece) > 1 and piece.strip(SPACE):
                    continue
                self.ids[piece] = k
        lowest = min(self.scores.values(), default=0.0)
        self.scores = {piece: self.scores.get(piece, lowest) for piece in self.ids}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        self.longest: dict[str, int] = {}
        for piece in self.ids:
            self.longest[piece[0]] = max(self.longest.get(piece[0], 1), len(piece))
        self.width = max(self.longest.values(), default=1)
        self.tree: dict = {}  # characters to branches; "" holds a piece's score and id
        for piece, k in self.ids.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (self.scores[piece], k)
        self.by_word = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)

    def given(self, piece: str) -> list[int]:
        k = self.ids.get(piece)
        return [k] if k is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """feed(text) gives the ids that are settled so far, finish() the rest."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.text, self.best, self.back = "", [0.0], [0]

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        width = self.pieces.width
        for a in range(0, len(text), width):
            self.advance(text[a : a + width])
            out += self.settled()
        return out

    def advance(self, text: str) -> None:
        """Scores the new positions, in the order of the pieces' starts."""
        p, old = self.pieces, len(self.text)
        self.text += text
        self.best += [-math.inf] * len(text)
        self.back += [-1] * len(text)
        best, back, whole = self.best, self.back, self.text
        scores, longest, n = p.scores, p.longest, len(self.text)
        for i in range(max(0, old - p.width + 1), n):
            here, c = best[i], whole[i]
            for j in range(i + 1, min(n, i + longest.get(c, 1)) + 1):
                score = scores.get(whole[i:j])
                if score is not None and j > old and here + score > best[j]:
                    best[j], back[j] = here + score, i
            if i >= old and c not in scores and here + p.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + p.unknown, i

    def settled(self) -> list[int]:
        """The ids up to the boundary where the paths of all positions that can be extended meet."""
        n = len(self.text)
        live = set(range(max(0, n - self.pieces.width + 1), n + 1))
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last])
        (at,) = live
        return self.commit(at) if at > 0 else []

    def commit(self, at: int) -> list[int]:
        cuts, end = [], at
        while end > 0:
            cuts.append((self.back[end], end))
            end = self.back[end]
        out = [k for a, b in reversed(cuts) for k in self.pieces.given(self.text[a:b])]
        base = self.best[at]
        self.text = self.text[at:]
        self.best = [x - base for x in self.best[at:]]
        self.back = [0, *(x - at for x in self.back[at + 1 :])]
        return out

    def finish(self) -> list[int]:
        out = self.commit(len(self.text)) if self.text else []
        self.reset()
        return out


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.search = StreamingViterbi(self.pieces)
        self.memo = Memo(lambda words: list(map(self.word, words)), KEPT_STRETCHES)

    def run(self, text: str) -> bytes:
        return np.array(self.search.feed(text) + self.search.finish(), "<i4").tobytes()

    def word(self, word: str) -> bytes:
        """The ids of spaces and a word, at whose ends all paths meet: the same search over a text that short."""
        text = word
        n = len(text)
        if n > WORD_CHARS:
            return self.run(text)
        tree, unknown = self.pieces.tree, self.pieces.unknown
        best, back, ids = [0.0] + [-math.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, node, j = best[i], tree, i
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                if "" in node:
                    score, k = node[""]
                    if here + score > best[j]:
                        best[j], back[j], ids[j] = here + score, i, k
            if here + unknown > best[i + 1] and text[i] not in self.pieces.ids:
                best[i + 1], back[i + 1], ids[i + 1] = here + unknown, i, -1
        out, j = [], n
        while j > 0:
            if ids[j] >= 0:
                out.append(ids[j])
            else:
                out += reversed(self.pieces.given(text[back[j] : j]))
            j = back[j]
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.pieces.by_word:
            return [self.run(SPACE + t.replace(" ", SPACE)) if t else b"" for t in texts]
        split = [STRETCH(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        get = self.memo.getter(set(chain.from_iterable(split)))
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.pieces.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return raw.decode("utf-8", "replace")[1:]


#: One encoder for each file, for the life of the worker process.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def encoded(docs: DataFrame, path: str | None = None, back: bool = False) -> DataFrame:
    """docs, whose last column is the text, with ids (array of int), and with `back` decoded, the text decoded from them."""
    path = path or vocabulary()

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in blocks(texts):
                ids = encoder.encode(texts[a:b])
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                part, lists = batch.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                more = [pa.array(list(map(encoder.decode, ids)), pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], names=[*part.schema.names, "ids", *(["decoded"] if back else [])])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kept}, ids array<int>" + (", decoded string" if back else ""))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows, whose last column is ids, with decoded, their text."""
    path = path or vocabulary()

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            raw, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes(), lists.offsets.to_numpy() * 4
            text = pa.array([encoder.decode(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kept}, decoded string")


def codec_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text decoded from them of doc_id, text, with n_ids, ids_crc32 (little-endian 32-bit ids) and round_trip
    (whether decoding gives the text)."""
    path = path or vocabulary()

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids = encoder.encode(texts[a:b])
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                back = [encoder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))),
                     pa.array(back, pa.string()), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array([x == y for x, y in zip(back, texts[a:b], strict=True)])],
                    names=["doc_id", "ids", "decoded", "ids_crc32", "round_trip"],
                )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string, ids_crc32 long, round_trip boolean")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "round_trip", "ids", "decoded")
