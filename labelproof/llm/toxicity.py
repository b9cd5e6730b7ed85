"""Toxicity: a linear-chain conditional random field over words; its marginals give scores and offending offsets.

Learning, from labelled documents whose held-out remainder is not 2: a bounded sample (POSITIVES and NEGATIVES rows, those
with the smallest hash of doc_id) goes to the driver. Labels are of documents; tokens get theirs by set cover: words and
word beginnings that occur in toxic documents almost only, taken by how many toxic documents they explain that no earlier
one does. The field has two tags; a word's features are itself and its beginnings, and neighbours act through the
transitions. It is fitted by gradient ascent on the likelihood of the tagged sentences. A logistic curve over the largest
marginal and the expected number of toxic words turns the marginals of a document into its score.

Scoring is a map over whole texts: no shuffle. A word's features are weighed once in each worker; forward-backward runs
over the sentences of a batch together.

Null and empty texts have score `prior` of a document without words. Without labelled rows of both kinds all scores are the
share of toxic rows (0 if there are none). Labels that repeat a doc_id count as toxic if any does; null labels or ids are
ignored. Rows that repeat are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import Memo, blocks, fresh

POSITIVES, NEGATIVES = 2000, 4000
HELD_OUT = 2
THRESHOLD = 0.3
#: A cue occurs in so many toxic documents at least, and in clean ones at most this share of that.
CUE_DOCS, CUE_NOISE = 3, 0.05
#: A clean document weighs as much against a cue as so many toxic ones for it.
CUE_PENALTY = 10.0
CLEAN_SENTENCES = 20_000
#: Words whose scores a worker keeps.
KEPT_WORDS = 300_000
EPOCHS, RATE, DECAY = 40, 0.3, 1e-5
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
ENDS = (".", "!", "?", '."', '!"', '?"')


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def plain(word: str) -> str:
    """The word from its first to its last letter or digit, in lower case."""
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last].lower()


def traits(word: str) -> list[str]:
    """The features of a plain word."""
    if not word:
        return []
    return [f"={word}", *[f"<{word[:k]}" for k in range(4, min(len(word), 8) + 1)]]


def cue_traits(word: str) -> set[str]:
    return {f"={word}", *[f"<{word[:k]}" for k in range(4, min(len(word), 8) + 1)]} if word else set()


def cues(toxic: list[str], clean: list[str]) -> set[str]:
    """Traits that explain the toxic documents, by greedy cover over different texts. Traits are counted one document at
    a time; only those that can be cues are held for each document."""
    memo: dict[str, set[str]] = {}

    def of(text: str) -> set[str]:
        out: set[str] = set()
        for word in set(text.split()):
            if word not in memo:
                if len(memo) > 20_000:
                    memo.clear()
                memo[word] = cue_traits(plain(word))
            out |= memo[word]
        return out

    toxic, clean = list(dict.fromkeys(toxic)), list(dict.fromkeys(clean))
    whole = Counter()
    for text in toxic:
        whole.update(of(text))
    whole = {t: n for t, n in whole.items() if n >= CUE_DOCS}
    noise = Counter()
    for text in clean:
        noise.update(of(text) & whole.keys())
    ratio = len(toxic) / max(1, len(clean))
    good = {t for t, n in whole.items() if noise[t] * ratio <= CUE_NOISE * n}
    left = {k: of(text) & good for k, text in enumerate(toxic)}
    gain, holders = Counter(), {}
    for k, x in left.items():
        for t in x:
            gain[t] += 1
            holders.setdefault(t, []).append(k)
    out: set[str] = set()
    while gain:
        best = max(gain, key=lambda t: (gain[t] - CUE_PENALTY * noise[t] * ratio, -len(t), t))
        if gain[best] < CUE_DOCS:
            break
        out.add(best)
        for k in holders[best]:
            if k in left:
                gain.subtract(left.pop(k))
        gain = +gain
    return out


def sentences(text: str):
    held: list[str] = []
    for word in text.split():
        held.append(word)
        if word.endswith(ENDS):
            yield held
            held = []
    if held:
        yield held


def odds(emission: np.ndarray, starts: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Marginal odds of the toxic tag at each token. emission: exp of a token's score; starts, sizes: of the sequences;
    t: exp of the transition scores [from, to]. All sequences move on together, the longest first."""
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    ahead, back = np.empty_like(emission), np.ones_like(emission)
    live = len(sizes)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes[:live], -step, "left"))
        at = starts[:live] + step
        if step:
            before = ahead[at - 1]
            ahead[at] = emission[at] * (t[0, 1] + before * t[1, 1]) / (t[0, 0] + before * t[1, 0])
        else:
            ahead[at] = emission[at]
    live = len(sizes)
    for step in range(1, int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes[:live], -step, "left"))
        at = starts[:live] + sizes[:live] - 1 - step
        after = emission[at + 1] * back[at + 1]
        back[at] = (t[1, 0] + t[1, 1] * after) / (t[0, 0] + t[0, 1] * after)
    return np.clip(ahead * back, 1e-12, 1e12)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    transitions: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float | None = None

    def emission(self, token: bytes) -> tuple[float, bool]:
        text = token.decode("utf-8", "replace")
        score = self.bias + sum(self.weights.get(x, 0.0) for x in traits(plain(text)))
        return float(np.exp(min(max(score, -25.0), 25.0))), text.endswith(ENDS)

    def marginals(self, tokens: list[list[bytes]], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Odds of all tokens in a row, and the number of tokens of each text."""
        get = memo.getter(set(chain.from_iterable(tokens)))
        sizes = np.array([len(x) for x in tokens], np.int64)
        flat = [get(x) for x in chain.from_iterable(tokens)]
        if not flat:
            return np.zeros(0), sizes
        emission, ends = (np.array(x) for x in zip(*flat, strict=True))
        ends = ends.astype(bool)
        ends[np.cumsum(sizes)[sizes > 0] - 1] = True
        last = np.flatnonzero(ends)
        starts = np.concatenate(([0], last[:-1] + 1))
        return odds(emission.astype(float), starts, last - starts + 1, self.transitions), sizes

    def features(self, marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-odds of the most toxic word and log of the expected number, for each text."""
        out = np.zeros((len(sizes), 2))
        out[:, 0] = -25
        some = np.flatnonzero(sizes > 0)
        if len(some):
            at = (np.cumsum(sizes) - sizes)[some]
            out[some, 0] = np.log(np.maximum.reduceat(marginal, at))
            out[some, 1] = np.log1p(np.add.reduceat(marginal / (1 + marginal), at))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(features), self.prior)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * features[:, 0] + c * features[:, 1], -40, 40)))


def train(rows: list[tuple[str, int]]) -> Model:
    """rows: text and label."""
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not clean:
        return Model(prior=float(bool(toxic)))
    marks = cues(toxic, clean)
    kinds: dict[str, int] = {}  # the different plain words of the training sentences
    lengths, types, tags = [], [], []

    def add(sentence: list[str], tagged: list[bool]) -> None:
        lengths.append(len(sentence))
        tags.extend(tagged)
        types.extend(kinds.setdefault(plain(w), len(kinds)) for w in sentence)

    cued: dict[str, bool] = {}
    for text in dict.fromkeys(toxic):
        for s in sentences(text):
            for w in s:
                if w not in cued:
                    cued[w] = not marks.isdisjoint(cue_traits(plain(w)))
            if any(cued[w] for w in s):
                add(s, [cued[w] for w in s])
    others = list(dict.fromkeys(clean))
    every = max(1, sum(1 for text in others for _ in sentences(text)) // CLEAN_SENTENCES)
    for text in others:
        for s in sentences(text):
            if zlib.crc32(" ".join(s).encode("utf-8", "surrogatepass")) % every == 0:
                add(s, [False] * len(s))
    y = np.array(tags, float)
    kind = np.array(types, np.int64)
    seen = Counter(x for word in kinds for x in traits(word))
    names = {x: k for k, x in enumerate(x for x, n in seen.items() if n > 1 or x[0] == "=")}
    lists = [[names[x] for x in traits(word) if x in names] for word in kinds]
    token = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.array(list(chain.from_iterable(lists)), np.int64)
    sizes = np.array(lengths, np.int64)
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(y), bool)
    inner[starts] = False
    pairs = np.flatnonzero(inner)
    weights, bias, moves = np.zeros(len(names)), -3.0, np.zeros(3)  # moves: O to T, T to O, T to T
    squares, bias_square, move_square = np.full(len(names), 1e-3), 1e-3, np.full(3, 1e-3)
    y01 = np.array([((1 - y[pairs - 1]) * y[pairs]).sum(), (y[pairs - 1] * (1 - y[pairs])).sum(), (y[pairs - 1] * y[pairs]).sum()])
    for _ in range(EPOCHS):
        score = (bias + np.bincount(token, weights[feature], len(kinds)))[kind]
        emission = np.exp(np.clip(score, -25, 25))
        t = np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]]))
        p = odds(emission, starts, sizes, t)
        p = p / (1 + p)
        # expected transitions, from the marginals of both ends and the odds ratio that the transitions set
        a, b = p[pairs - 1], p[pairs]
        ratio = t[0, 0] * t[1, 1] / (t[0, 1] * t[1, 0])
        if abs(ratio - 1) < 1e-9:
            both = a * b
        else:
            s = 1 + (ratio - 1) * (a + b)
            both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * a * b, 0))) / (2 * (ratio - 1))
        step = np.bincount(feature, np.bincount(kind, y - p, len(kinds))[token], len(names)) - DECAY * len(y) * weights / max(1, len(names))
        squares += step**2
        weights += RATE * step / np.sqrt(squares)
        g = float((y - p).sum())
        bias_square += g * g
        bias += RATE * g / bias_square**0.5
        gm = y01 - np.array([(b - both).sum(), (a - both).sum(), both.sum()])
        move_square += gm**2
        moves += RATE * gm / np.sqrt(move_square)
    kept = {x: float(weights[k]) for x, k in names.items() if abs(weights[k]) > 1e-4}
    model = Model(kept, bias, np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]])))
    memo, parts = Memo(lambda tokens: list(map(model.emission, tokens)), KEPT_WORDS), []
    texts = toxic + clean
    for i, j in blocks(texts):
        parts.append(model.features(*model.marginals([x.encode("utf-8", "surrogatepass").split() for x in texts[i:j]], memo)))
    model.curve = logistic(np.concatenate(parts), np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A logistic curve by Newton steps with a small penalty."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - 0.1 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a bounded sample of the labelled rows outside the held-out part."""
    known = labels.where("doc_id is not null and toxic is not null").where(split_of(F.col("doc_id")) != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("y = 1").orderBy(*order).limit(POSITIVES).unionAll(known.where("y = 0").orderBy(*order).limit(NEGATIVES))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # a row for each sampled id
    return train(sorted((r["text"], r["y"]) for r in rows))


RESULT = "score double, spans array<struct<start:bigint,end:bigint>>"


def scorer(model, with_spans: bool):
    """A batch function: text, the last column, stays last but for score and spans."""

    def run(batches):
        net: Model = model.value
        memo = Memo(lambda tokens: list(map(net.emission, tokens)), KEPT_WORDS)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            scores, spans = [], []
            for a, b in blocks(texts):
                tokens = [x.encode("utf-8", "surrogatepass").split() for x in texts[a:b]]
                marginal, sizes = net.marginals(tokens, memo)
                scores.append(net.scores(net.features(marginal, sizes)))
                found = [[] for _ in tokens]
                if with_spans:
                    at = np.flatnonzero(marginal > 1)
                    doc = np.searchsorted(np.cumsum(sizes), at, "right")
                    first = np.cumsum(sizes) - sizes
                    for d in np.unique(doc).tolist():
                        words = [m.span() for m in WORD.finditer(texts[a + d])]
                        found[d] = [{"start": words[k][0], "end": words[k][1]} for k in (at[doc == d] - first[d]).tolist()]
                spans += found
            columns = [pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            names = [*batch.schema.names, "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return run


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """docs, whose last column is the text, with score and, if asked for, spans of offending words (code points).
    If docs has such columns, the new ones have underscores at their end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
    added = [fresh("score", docs.columns), *([fresh("spans", docs.columns)] if spans else [])]
    plain_names = docs.toDF(*[f"k{i}" for i in range(len(docs.columns))])
    found = plain_names.mapInArrow(scorer(shared, spans), f"{', '.join(kinds)}, score double" + ", spans array<struct<start:bigint,end:bigint>>" * spans)
    return found.toDF(*docs.columns, *added)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted, n_spans, spans."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(split_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), shown.alias("toxic_spans"))
