"""Periodic runs: stretches of words that repeat with a period at least four times over.

A run is a stretch of consecutive words with smallest period q and length at least max(6, 4q) that no neighbouring word
extends keeping the period. Words are maximal pieces without ASCII white space.

Method. The texts of a block become one array of word numbers, each text ended by a number of its own, so that nothing
crosses texts. Periods up to SHORT are found by comparing the array with itself at each such lag. Longer periods are taken
in scales (a, b] with b about 1.5 a: each position gets a hash of its b words, and the least hash of every window of b
positions is a minimizer. Inside a run of period q in (a, b] the q different rotations have different hashes, so a
window's minimum comes back exactly q later, and a run of 4q words has room for two of them (4q - 2b + 2 > q). Each pair of
equal minimizers that follow each other at a distance in (a, b] is a seed, extended both ways word by word; hashes only
propose. A scale takes only texts long enough to hold a run of it.

Memory is bounded by a block of about BLOCK characters or the longest text. Nulls and empty texts have no words and no
runs; repeated rows are each answered; very long texts take time n log n; an empty table gives an empty result; a null id
is kept. Other columns are kept whatever their names.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import blocks, fresh, texts

#: Periods found by direct comparison.
SHORT = 8
BLOCK = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_SQL = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Odd 64-bit multipliers that mix hashes.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def least_length(q: int) -> int:
    """Words a run of period q has at least."""
    return max(6, 4 * q)


def mixed(left: np.ndarray, right) -> np.ndarray:
    """A hash of two hashes, in their order."""
    x = left * MIX_A + right
    x ^= x >> np.uint64(29)
    x *= MIX_B
    x ^= x >> np.uint64(32)
    return x


def followed(hashes: np.ndarray, by: int) -> np.ndarray:
    """Hashes of two pieces, the second `by` positions after the first; at the end the last text's end mark is in both."""
    out = np.empty_like(hashes)
    out[:-by] = mixed(hashes[:-by], hashes[by:])
    out[-by:] = mixed(hashes[-by:], np.uint64(by))
    return out


def swept(values: np.ndarray, width: int, pick, back: bool = False) -> np.ndarray:
    """The least or greatest of `width` values from each position on (or up to it)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if back:
            out[step:] = pick(out[step:], out[:-step])
        else:
            out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def stretches(x: np.ndarray, q: int):
    """(first, end) of all maximal stretches of period q long enough to be runs."""
    same = np.flatnonzero(x[:-q] == x[q:])
    if not same.size:
        return
    cut = np.flatnonzero(np.diff(same) > 1)
    first, last = same[np.concatenate(([0], cut + 1))], same[np.concatenate((cut, [same.size - 1]))]
    for k in np.flatnonzero(last - first + 1 >= least_length(q) - q).tolist():
        yield int(first[k]), int(last[k]) + 1 + q


def agreeing(x: np.ndarray, i: int, j: int, way: int) -> int:
    """Words that agree from i and j on, forwards (1) or backwards (-1)."""
    total, step = 0, 64
    while True:
        room = min(step, x.size - max(i, j) if way > 0 else min(i, j) + 1)
        if room <= 0:
            return total
        a, b = (x[i : i + room], x[j : j + room]) if way > 0 else (x[i - room + 1 : i + 1][::-1], x[j - room + 1 : j + 1][::-1])
        differ = np.flatnonzero(a != b)
        if differ.size:
            return total + int(differ[0])
        total, i, j, step = total + room, i + way * room, j + way * room, step * 2


def seeds(h: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """(period, position) of minimizers that come back at a distance in (low, high], by period, then position."""
    least = swept(h, high, np.minimum)
    chosen = np.flatnonzero(swept(least, high, np.maximum, back=True) == h)
    chosen = chosen[np.argsort(h[chosen], kind="stable")]
    apart = np.diff(chosen)
    pair = np.flatnonzero((h[chosen[1:]] == h[chosen[:-1]]) & (apart > low) & (apart <= high))
    return sorted(zip(apart[pair].tolist(), chosen[pair].tolist(), strict=True))


def grown(x: np.ndarray, found: list[tuple[int, int]]):
    """(first, end, period) of the maximal stretches that seeds lie in, each once, if they are long enough."""
    held, reach = 0, 0
    for q, at in found:
        if q == held and at + q < reach:
            continue  # inside the stretch before
        ahead, behind = agreeing(x, at, at + q, 1), agreeing(x, at - 1, at + q - 1, -1) if at else 0
        if not ahead:
            continue  # only the hashes were equal
        held, reach = q, at + q + ahead
        if ahead + behind + q >= least_length(q):
            yield at - behind, reach, q


def smallest(x: np.ndarray, first: int, end: int, q: int) -> bool:
    """No divisor of q is a period (no other number below q can be one of a stretch of 2q words or more)."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p:
            p += 1
            continue
        step = q // p
        if np.array_equal(x[first : end - step], x[first + step : end]):
            return False
        while rest % p == 0:
            rest //= p
        p += 1
    return True


def find_runs(x: np.ndarray, sizes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by text, in order. x holds the texts' word numbers, each text of `sizes` words
    followed by a number that occurs nowhere else."""
    owners = np.arange(sizes.size)
    found: dict[int, list[tuple[int, int, int]]] = {}

    def keep(first, end, q):
        k = int(np.searchsorted(starts, first, "right")) - 1
        if smallest(x, first, end, q):
            found.setdefault(int(owners[k]), []).append((first - int(starts[k]), end - first, q))

    starts = np.cumsum(sizes + 1) - (sizes + 1)
    for q in range(1, SHORT + 1):
        if x.size > q:
            for first, end in stretches(x, q):
                keep(first, end, q)
    power, low = 1, SHORT
    hashes = mixed(x.astype(np.uint64), MIX_B)
    while True:
        high = (3 * low + 4) // 2
        enough = sizes >= least_length(low + 1)
        if not enough.any():
            break
        if not enough.all():
            mask = np.repeat(enough, sizes + 1)
            x, hashes, owners, sizes = x[mask], hashes[mask], owners[enough], sizes[enough]
            starts = np.cumsum(sizes + 1) - (sizes + 1)
        while 2 * power <= high:
            hashes = followed(hashes, power)
            power *= 2
        for first, end, q in grown(x, seeds(followed(hashes, high - power) if high > power else hashes, low, high)):
            keep(first, end, q)
        low = high
    return {k: sorted(runs, key=lambda r: (r[0], r[2])) for k, runs in found.items()}


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each word that stays when every run is reduced to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def block_runs(values: list[str]):
    """(runs, text with every run reduced to its first period and words joined by one space) of each text."""
    words = [v.encode().split() for v in values]  # bytes.split() splits at exactly the ASCII white space
    numbers = count()
    numbered: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    parts = []
    for w in words:
        for one in set(w).difference(numbered):
            numbered[one] = next(numbers)
        parts.append(np.fromiter(map(numbered.__getitem__, w), np.int64, len(w)))
        parts.append(np.array([next(numbers)]))
    runs = find_runs(np.concatenate(parts), sizes) if parts else {}
    for k, w in enumerate(words):
        mine = runs.get(k, [])
        if mine:
            w = [one for one, stays in zip(w, kept_words(len(w), mine).tolist(), strict=True) if stays]
        yield mine, b" ".join(w).decode()


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs but the text, then its runs (array of start, length, period in words, by start and period) and
    the collapsed text."""
    others = [c for c in docs.columns if c != text]
    runs, collapsed = fresh("runs", others), fresh("collapsed", others)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema), f"{runs} {RUNS_SQL}, {collapsed} string"])

    def run(batches):
        for batch in batches:
            values = texts(batch.column(batch.num_columns - 1))
            for a, b in blocks(values, BLOCK):
                answers = list(block_runs(values[a:b]))
                flat = [r for mine, _ in answers for r in mine]
                struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(RUNS.value_type))
                offsets = np.concatenate(([0], np.cumsum([len(mine) for mine, _ in answers]))).astype(np.int32)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), struct, type=RUNS), pa.array([c for _, c in answers], pa.string())],
                    names=[*batch.schema.names[:-1], runs, collapsed],
                )

    return docs.select(*others, text).mapInArrow(run, schema)


WORD = r"([^\x20\x09-\x0D]+)"


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which about a tenth of the documents, chosen by the crc32 of their id, repeat a stretch of their words
    to the end: with h = crc32, g = h // 10 and n words, those with h % 10 = 0 do so from word a = g % n with period
    1 + (n - a) // (3 + g % 8). A null id changes nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period; null
    without one), runs_sha256 and collapsed_sha256 of doc_id, text with the planted repeats."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
