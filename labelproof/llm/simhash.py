"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints: a bit is 1 if it is set in over half of the hashes of a document's features (word shingles, repeats
included or not). Two fingerprints link at `distance` or fewer differing bits.

Search (Qin et al., "GPH", 2018, re-aimed at a self-join): bit statistics over all fingerprints; strongly correlated bits
go to the same partition; a dynamic program gives each partition a threshold of its own, at the lowest estimated number
of probes and candidates, such that the thresholds plus one add up to distance + 1. Then any pair within the distance is
within the threshold in at least one partition. A fingerprint is listed under its value in each partition and probes the
smaller values within the threshold; the lists are verified against the whole fingerprint.

Equal fingerprints are one node, so copies cost one row. A list longer than LIST is dealt by blocks of its members, each
pair of blocks in a group of its own: none is dropped and no task gets more than two blocks. A task emits a spanning
forest of the links it finds, never all pairs. Components are found by rounds over written tables.

Near copies by Jaccard similarity (one_of_each) are the pairs the search finds within NEAR bits, if their shingles bear it
out. At 0.8, fingerprints of shingles differ in 10 of 64 bits on average, so pairs further apart are added by a prefix
filter (Chaudhuri et al., 2006): with shingles in one order, rare ones first, two documents of similarity t share one of the
first n - ceil(t n) + 1 of each. Shingles that no other document lists are left out before anything else is known of a
document; pairs that share one and whose short SimHashes are not far too apart are candidates as well. All pairs within a
group of candidates are decided by their shingles. The order only moves work: shingles are ranked by how many fall into
their bucket.

Texts are not shuffled to be looked up: a Bloom filter of the rows in question lets the others pass where they are, and only
the rows it holds go into the exact join.

Null and empty texts have no words: fingerprint zero. A null doc_id is not counted as the smallest; a component of null
ids only has id null. Rows that repeat are all kept in the results.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import components, fresh, stored

SEED = 42
#: Members of a list, or of a block of a longer list.
LIST = 4096
#: So many long lists at most are told to all tasks (12 bytes each); more are joined by a shuffle.
FEW = 100_000
#: What a candidate and a probe cost, in candidates.
PROBE_COST = 60.0
#: Bits within which the pigeonhole search finds near copies by similarity; the prefix filter adds those further apart.
NEAR = 7
#: Documents of a group of candidates, or of a block of a larger group.
GROUP = 1024
#: Ranks of shingles come from counts of so many buckets of hashes.
BUCKETS = 1 << 18
#: Words of the SimHash that passes candidates, and by how many standard errors it may miss the similarity.
SKETCH_WORDS = 2
MARGIN = 4.5
#: Bits of a Bloom filter, at most; with more rows it holds more false ones, and the exact join gets them all.
BLOOM = 1 << 28
#: Documents with fewer shingles pass without it.
FEW_SHINGLES = 16
#: Odd 64-bit multipliers, one for each word of a sketch.
MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(SKETCH_WORDS)], np.uint64)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def hashes(words: list[bytes], size: int, distinct: bool) -> np.ndarray:
    """XXH64 of the shingles of a document; fewer words than `size` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if size == 1:
        found = [digest(w, SEED) for w in (set(words) if distinct else words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-size].tolist()] if len(words) > size else [0]
        last = (ends[min(size, len(words)) - 1 :] - 1).tolist()
        found = [digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=True)]
    out = np.array(found, np.uint64)
    return np.unique(out) if distinct and size > 1 else out


def majority(h: np.ndarray) -> np.ndarray:
    """The bytes of the bits that are set in over half of the rows of 64-bit words."""
    if not len(h):
        return np.zeros(8 * h.shape[1], np.uint8)
    total = np.zeros(64 * h.shape[1], np.int64)
    for k in range(0, len(h), 8192):
        part = np.ascontiguousarray(h[k : k + 8192])
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * total > len(h), bitorder="little")


def sketch(h: np.ndarray) -> bytes:
    x = h[:, None] * MIX[None, :]
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return majority(x ^ (x >> np.uint64(32))).tobytes()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def printer(words: int, distinct: bool):
    """A batch function: text is the last column and gives way to fp."""

    def run(batches):
        for batch in batches:
            prints = [majority(hashes(split(text), words, distinct)[:, None]) for text in batch.column(batch.num_columns - 1).to_pylist()]
            fp = pa.array(np.concatenate(prints).view("<i8") if prints else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*batch.schema.names[:-1], "fp"])

    return run


def kept_columns(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])


def fingerprints(docs: DataFrame, words: int, distinct: bool = False) -> DataFrame:
    """The columns before the last, text, and fp."""
    return docs.mapInArrow(printer(words, distinct), f"{kept_columns(docs)}, fp long")


@dataclass
class Plan:
    parts: list[list[int]]
    limits: list[int]


def bit_table(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints have both bits set, for each pair of bits, over all of them."""

    def run(batches):
        total = np.zeros((64, 64), np.int64)
        n = 0
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(4097, np.int64)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size: each takes the bit most correlated with those it holds."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free, parts = set(range(64)), []
    for k in range(m):
        size = (64 - 64 * k // m) - (64 - 64 * (k + 1) // m)
        first = max(free, key=lambda b: (strength[b, list(free)].sum(), -b))
        part = [first]
        free.discard(first)
        while len(part) < size:
            bit = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(bit)
            free.discard(bit)
        parts.append(sorted(part))
    return parts


def allotted(n: int, both: np.ndarray, distance: int) -> Plan:
    """The partitions and thresholds with the lowest estimated cost."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, Plan] | None = None
    for m in range(2, distance + 2):
        parts = grouped_bits(n, both, m)
        costs = []
        for part in parts:
            chance = np.zeros(len(part) + 1)
            chance[0] = 1
            for bit in part:  # how many bits of the partition two fingerprints differ in
                chance[1:] = chance[1:] * (1 - differ[bit]) + chance[:-1] * differ[bit]
                chance[0] *= 1 - differ[bit]
            row, probes = [0.0], 0.0
            for limit in range(min(distance, len(part)) + 1):
                probes += math.comb(len(part), limit) / (2 if limit else 1)
                row.append(n * probes * PROBE_COST + n * n / 2 * chance[: limit + 1].sum())
            costs.append(row)
        need = distance + 1
        table = [[math.inf] * (need + 1) for _ in range(m + 1)]
        choice = [[0] * (need + 1) for _ in range(m + 1)]
        table[0][0] = 0.0
        for i, row in enumerate(costs, 1):
            for total in range(need + 1):
                for take in range(min(total, len(row) - 1) + 1):
                    if table[i - 1][total - take] + row[take] < table[i][total]:
                        table[i][total], choice[i][total] = table[i - 1][total - take] + row[take], take
        limits, total = [], need
        for i in range(m, 0, -1):
            limits.append(choice[i][total] - 1)
            total -= choice[i][total]
        if best is None or table[m][need] < best[0]:
            best = table[m][need], Plan(parts, limits[::-1])
    return best[1]


def flips(width: int, limit: int) -> np.ndarray:
    """Masks of 1 to limit bits."""
    out, layer = [], [(0, -1)]
    for _ in range(limit):
        layer = [(mask | 1 << b, b) for mask, last in layer for b in range(last + 1, width)]
        out += [mask for mask, _ in layer]
    return np.array(out, np.int64)


def lister(plan: Plan):
    """Batches of nodes (fp first) -> key, probe (0: listed, 1: probing) and the node's columns."""
    masks = [flips(len(part), limit) if limit > 0 else np.zeros(0, np.int64) for part, limit in zip(plan.parts, plan.limits, strict=True)]

    def run(batches):
        for batch in batches:
            names = ["key", "probe", *batch.schema.names]
            for k in range(0, batch.num_rows, 2048):
                block = batch.slice(k, 2048)
                fp = block.column(0).to_numpy().view(np.uint64)
                keys, rows, probe = [], [], []
                for i, (part, limit) in enumerate(zip(plan.parts, plan.limits, strict=True)):
                    if limit < 0:
                        continue
                    value = np.zeros(len(fp), np.int64)
                    for at, bit in enumerate(part):
                        value |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
                    near = value[:, None] ^ masks[i][None, :]
                    row, col = np.nonzero(near < value[:, None])
                    keys += [value | i << 34, near[row, col] | i << 34]
                    rows += [np.arange(len(fp)), row]
                    probe += [np.zeros(len(fp), np.int8), np.ones(len(row), np.int8)]
                if keys:
                    taken = block.take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(probe)), *taken.columns], names=names)

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars around the smallest node of each group."""
    ends, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ends))
    return ends[moved], ends[root[moved]]


def differing(words: np.ndarray, x, y) -> np.ndarray:
    """In how many bits the words at x and y differ (as unsigned words: the count is of the absolute value)."""
    return np.bitwise_count((words[x] ^ words[y]).view(np.uint64))


def verifier(columns: list[str], near):
    """Sorted lists -> links (a, b) of the pairs that near(table, x, y) holds for. Columns: key, salt, probe, id and those named."""

    def linked(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        same = np.concatenate((np.cumsum(np.concatenate(([0], (np.diff(t["key"]) != 0) | (np.diff(t["salt"]) != 0)))), [-1]))
        live, found, lag = np.flatnonzero(t["probe"] == 0), [], 0
        while len(live):
            lag += 1
            live = live[live + lag < len(same) - 1]
            live = live[same[live + lag] == same[live]]
            other = live + lag
            good = near(t, live, other)
            if good.any():
                found.append((t["id"][live[good]], t["id"][other[good]]))
                if len(found) > 256:
                    found = [forest(*(np.concatenate(side) for side in zip(*found, strict=True)))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return forest(*(np.concatenate(side) for side in zip(*found, strict=True)))

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {c: batch.column(c).to_numpy() for c in ("key", "salt", "probe", "id", *columns)}
            held = {c: np.concatenate((held[c], x)) for c, x in new.items()} if held else new
            n = len(held["key"])
            if not n:
                continue
            cut = np.flatnonzero((held["key"] != held["key"][-1]) | (held["salt"] != held["salt"][-1]))
            whole = int(cut[-1]) + 1 if len(cut) else 0
            if whole:
                a, b = linked({c: x[:whole] for c, x in held.items()})
                held = {c: x[whole:] for c, x in held.items()}
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held:
            a, b = linked(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def dealt(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """rows, of which key and id are columns, with a salt: a list longer than `size` is dealt by pairs of blocks of its members.

    keys holds the key of each row, to count by.
    """
    long = keys.groupBy("key").count().where(F.col("count") > size).select("key", F.ceil(F.col("count") / size).cast("int").alias("blocks"))
    long = stored(long, "long")
    count = long.count()
    if count == 0:
        return rows.withColumn("salt", F.lit(0))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pair = lambda x: F.least(own, x) * F.col("blocks") + F.greatest(own, x)
    salts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
    )
    # without the hint a join would deal all lists by key once more
    few = F.broadcast(long) if count <= FEW else long
    return rows.join(few, "key", "left").select(*rows.columns, F.explode(salts).alias("salt"))


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): a spanning forest's links of the nodes (fp, id); ids are unique."""
    plan = allotted(*bit_table(nodes), distance)
    listed = lambda *names: nodes.select(*names).mapInArrow(
        lister(plan), "key long, probe byte, " + ", ".join(f"{c} long" for c in names)
    )
    rows = dealt(listed("fp", "id"), listed("fp"), LIST)
    ordered = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "probe")
    near = lambda t, x, y: differing(t["fp"], x, y) <= distance
    return ordered.mapInArrow(verifier(["fp"], near), "a long, b long")


def near_groups(prints: DataFrame, distance: int) -> DataFrame:
    """doc_id, fp -> doc_id, fp, component_id (the smallest doc_id reachable)."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("id")), distance))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs.select("doc_id", "text"), words), "prints")
    return near_groups(prints, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def ranks(docs: DataFrame, words: int) -> np.ndarray:
    """A rank for each bucket of hashes: eight times the logarithm of the number of shingles of all texts in it."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 1000):
                h = np.concatenate([hashes(split(x), words, True) for x in texts[k : k + 1000]])
                total += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)


def rare(h: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the order of ranks, of which documents of the similarity share one."""
    if not len(h):
        return h
    order = np.lexsort((h, rank[(h % np.uint64(BUCKETS)).astype(np.int64)]))
    return h[order[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]]


def candidates(similarity: float, distance: int = -1):
    """A test of pairs: sizes that allow the similarity, SimHashes that don't rule it out and are over the distance apart."""
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * SKETCH_WORDS
    limit = bits * chance + MARGIN * math.sqrt(bits * chance * (1 - chance))

    def near(t, x, y):
        low, high = np.minimum(t["n"][x], t["n"][y]), np.maximum(t["n"][x], t["n"][y])
        bits = [differing(t[f"s{k}"], x, y).astype(np.int64) for k in range(SKETCH_WORDS)]
        return (low >= similarity * high - 1e-9) & ((sum(bits) <= limit) | (high < FEW_SHINGLES)) & (bits[0] > distance)

    return near


def rare_lister(rank: np.ndarray):
    """A batch function: id and the rare shingles -> key, salt, id. Shingles of buckets that hold very many are dealt by salts,
    from 1 up."""
    often = rank >= 8 * math.log2(LIST + 8 * float(np.mean(np.exp2(rank / 8))))

    def run(batches):
        for batch in batches:
            lists = batch.column("rare")
            keys = lists.flatten().to_numpy()
            ids = np.repeat(batch.column("id").to_numpy(), lists.value_lengths().to_numpy())
            many = often[(keys.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)]
            salts = np.where(many, 1 + ids % 64, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salts), pa.array(ids)], names=["key", "salt", "id"])

    return run


def not_alone(batches):
    """Rows sorted by key and salt -> key and id of those whose key another row has too; with a salt, of all."""
    last = None  # the last row so far, not told of yet unless its key recurred
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, id = (batch.column(c).to_numpy() for c in ("key", "salt", "id"))
        if last is not None:
            key, salt, id = (np.concatenate(([x], y)) for x, y in zip(last[:3], (key, salt, id), strict=True))
        same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) | (salt > 0)
        told = last is not None and last[3]
        last = key[-1], salt[-1], id[-1], bool(shared[-1])
        if told:
            shared[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(id[shared])], names=["key", "id"])


def shingler(words: int, rank: np.ndarray | None, similarity: float):
    """A batch function: text is the last column and gives way to s0, s1 and n, and with ranks to id (of the set of shingles)
    and the rare shingles, without ranks to all of them as bytes."""

    def run(batches):
        for batch in batches:
            found = [hashes(split(x), words, True) for x in batch.column(batch.num_columns - 1).to_pylist()]
            marks = np.array([np.frombuffer(sketch(h), np.int64) for h in found], np.int64).reshape(-1, SKETCH_WORDS)
            columns = {f"s{k}": pa.array(np.ascontiguousarray(marks[:, k])) for k in range(SKETCH_WORDS)} | {"n": pa.array([len(h) for h in found], pa.int32())}
            if rank is None:
                columns["shingles"] = pa.array([h.tobytes() for h in found], pa.binary())
            else:
                ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)
                columns |= {"id": pa.array(ids), "rare": pa.array([rare(h, rank, similarity).view(np.int64) for h in found], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns.values()], names=[*batch.schema.names[:-1], *columns])

    return run


def exact_links(ids: np.ndarray, t: dict[str, np.ndarray], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the pairs of at least the similarity; pairs that are linked already are not looked at again."""
    near, root, found = candidates(similarity), np.arange(len(ids)), []
    for k, own in enumerate(sets[:-1]):
        others = np.arange(k + 1, len(ids))
        others = others[root[others] != root[k]]
        others = others[near(t, np.full(len(others), k), others)]
        for first in range(0, len(others), 64):
            part = others[first : first + 64]
            part = part[root[part] != root[k]]
            if not len(part):
                continue
            sizes = t["n"][part].astype(np.int64)
            joined = np.concatenate([sets[j] for j in part])
            hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
            shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for j in part[shared >= similarity * (len(own) + sizes - shared) - 1e-9]:
                if root[j] != root[k]:
                    found.append((ids[k], ids[j]))
                    root[root == root[j]] = root[k]
    return found


def decider(similarity: float):
    """Rows sorted by key and salt -> links (a, b) by the shingles of all pairs of a group."""

    def linked(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"n": np.int32} | {f"s{k}": np.int64 for k in range(SKETCH_WORDS)}
        t = {c: np.array([r[c] for r in rows], kind) for c, kind in kinds.items()}
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        found = np.array(exact_links(np.array([r["id"] for r in rows], np.int64), t, sets, similarity), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    def run(batches):
        for _, rows in itertools.groupby((r for batch in batches for r in batch.to_pylist()), lambda r: (r["key"], r["salt"])):
            yield linked(list(rows))

    return run


def bloom_places(rows: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each row key in a filter of so many bits (a power of two)."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return np.concatenate([(rows.view(np.uint64) * MIX2 * np.uint64(m)) >> shift for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])


def bloom(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the row keys (the column row): 16 bits or more for each, up to BLOOM."""
    bits = min(BLOOM, 1 << max(10, (16 * rows.count()).bit_length()))

    def run(batches):
        table = np.zeros(bits, bool)
        for batch in batches:
            table[bloom_places(batch.column(0).to_numpy(), bits)] = True
        words = np.packbits(table, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    found = rows.select("row").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    return words.view(np.uint8)


def sifted(df: DataFrame, key: str, table: np.ndarray, held: bool) -> DataFrame:
    """The rows whose key the Bloom filter holds (and a few more), or all others."""

    def run(batches):
        for batch in batches:
            at = bloom_places(batch.column(key).to_numpy(), 8 * len(table))
            hit = ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).reshape(3, -1).all(0)
            yield batch.filter(pa.array(hit == held))

    return df.mapInArrow(run, df.schema)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies of one that stays (the smallest doc_id; of equal rows one).

    Links are pairs whose distinct shingles of `words` words have a Jaccard similarity of at least `similarity`, whatever
    the edit; it is computed from the shingles, not estimated.
    """
    row = F.xxhash64("doc_id", "text")
    own = docs.select(row.alias("row"), "doc_id", "text")
    marks = "".join(f"s{k} long, " for k in range(SKETCH_WORDS)) + "n int"
    rank = ranks(docs, words)
    prints = own.mapInArrow(shingler(words, rank, similarity), f"{kept_columns(own)}, {marks}, id long, rare array<long>")
    prints = stored(prints, "prints")
    fields = [*(f"s{k}" for k in range(SKETCH_WORDS)), "n"]
    # equal sets of shingles are one node; any of its rows has the text to take them from
    nodes = stored(prints.groupBy("id").agg(*[F.any_value(c).alias(c) for c in fields], F.min("row").alias("row")), "nodes")
    close = links(nodes.select(F.col("s0").alias("fp"), "id"), NEAR)
    # keys and ids alone are shuffled: nine rows in ten go, before the others get what is compared
    listed = prints.groupBy("id").agg(F.any_value("rare").alias("rare")).mapInArrow(rare_lister(rank), "key long, salt int, id long")
    listed = listed.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(not_alone, "key long, id long")
    listed = stored(listed, "listed")
    rows = dealt(listed.hint("merge").join(nodes.select("id", *fields), "id").withColumn("probe", F.lit(0).cast("byte")), listed.select("key"), LIST)
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    further = rows.mapInArrow(verifier(fields, candidates(similarity, NEAR)), "a long, b long")
    near = components(close.unionAll(further))
    near = stored(near.join(nodes.select("id", "row"), near.node == F.col("id")).select("row", "id", F.col("root").alias("key")), "near")
    taken = sifted(own.select("row", "text"), "row", bloom(near), True).join(near, "row").groupBy("row", "id", "key").agg(F.any_value("text").alias("text")).select("key", "id", "text")
    sets = dealt(taken.mapInArrow(shingler(words, None, similarity), f"key long, id long, {marks}, shingles binary"), near.select("key"), GROUP)
    sets = sets.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = components(sets.mapInArrow(decider(similarity), "a long, b long"))
    rooted = prints.join(found, prints.id == found.node, "left").select("row", "doc_id", F.coalesce("root", "id").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    stay = stored(rooted.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("_row")), "stay")
    # rows that go, or are repeated
    asked = rooted.groupBy("row").count().join(stay, F.col("row") == F.col("_row"), "left").where("_row is null or count > 1")
    asked = stored(asked.select("row", "count"), "asked")
    name, table = fresh("row", docs.columns), bloom(asked)
    keyed = docs.withColumn(name, row)
    kept = sifted(keyed, name, table, True).join(stay.withColumnRenamed("_row", name), name, "left_semi")
    kept = kept.dropDuplicates([name]) if asked.where("count > 1").limit(1).count() else kept
    return sifted(keyed, name, table, False).unionByName(kept).select(*docs.columns)
