"""Periodic runs, importance resampling and prefix token counts against brute-force versions, and the cases that must not
break them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from harness import compare, duck
from test_llm_operators import SF, docs, real, texts_of  # noqa: F401

from labelproof.llm import importance_resampling, periodic_runs, prefix_counts, queries
from labelproof.llm.common import ship

LETTERS = "abcdefgh"


def brute_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            length = j - i + q
            primitive = not any(q % p == 0 and all(words[t] == words[t + p] for t in range(i, i + length - p)) for p in range(1, q))
            if j > i and length >= max(6, 4 * q) and primitive:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    periods = [1, 2, 3, 5, 8, 9, 13, 14, 15, 20, 22, 23, 34, 35, 50, 52, 53, 79, 80]
    total = 0
    for trial in range(120):
        letters, many = ("ab" if trial % 3 == 0 else LETTERS), []
        for _ in range(rng.randint(1, 5)):
            x = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
            for _ in range(rng.randint(0, 3)):
                q = rng.choice(periods)
                base = [rng.choice(letters) for _ in range(q)]
                x += [base[i % q] for i in range(rng.randint(3 * q, 6 * q))] + [rng.choice(letters) for _ in range(rng.randint(0, 9))]
            many.append(x)
        for x, (runs, _) in zip(many, periodic_runs.block_runs([" ".join(x) for x in many]), strict=True):
            assert runs == brute_runs(x)
            total += len(runs)
    assert total > 400


@pytest.mark.parametrize("q", range(1, 121))
def test_every_period_is_found(q):
    """Exactly 4q words (6 at least) of each period between other words."""
    words = [f"x{k}" for k in range(5)] + [f"w{k % q}" for k in range(max(6, 4 * q))] + [f"y{k}" for k in range(5)]
    (runs, collapsed), = periodic_runs.block_runs([" ".join(words)])
    assert runs == [(5, max(6, 4 * q), q)] and len(collapsed.split()) == 10 + q


def test_run_report_equals_brute_force(spark, docs, real):  # noqa: F811
    for df in (real, docs):
        known, got = texts_of(df), periodic_runs.run_report(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r["doc_id"] is None:
                continue
            words = planted_words(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", known[r["doc_id"]]))
            runs = brute_runs(words) if len(words) < 400 else None
            if runs is None:
                continue
            best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
            assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
            assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
            assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
            left = [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]
            assert r["collapsed_sha256"] == hashlib.sha256(" ".join(left).encode()).hexdigest()


def test_periodic_runs_keep_other_columns(docs):  # noqa: F811
    found = periodic_runs.periodic_runs(docs.withColumn("runs", docs["lang"]))
    assert found.count() == docs.count() and found.columns[-2:] == ["runs_", "collapsed"]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0 and periodic_runs.run_report(docs.limit(0)).count() == 0


def test_resampling_equals_sql(spark):
    ok, message, n = compare(queries.QUERIES["op12_importance_resampling"](ship(spark), SF), duck(SF), queries.ORACLES["op12_importance_resampling"])
    assert ok and n, message


def test_features_stay_inside_texts():
    """n-grams across two texts of a block are left out, also around empty texts."""
    values = ["A b c", "", "d é", "-", "b c"]
    hasher = importance_resampling.Hasher(3, 1 << 30)
    words, lengths = hasher.features(values)
    assert words.tolist() == [3, 0, 2, 0, 2]
    for n, (owner, hashed) in enumerate(lengths, 1):
        want = []
        for k, v in enumerate(values):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", v.lower())
            want += [(k, zlib.crc32(" ".join(w[i : i + n]).encode()) % (1 << 30)) for i in range(len(w) - n + 1)]
        assert list(zip(owner.tolist(), hashed.tolist(), strict=True)) == want


def test_bigram_weights_equal_brute_force(spark, real):  # noqa: F811
    """General n-grams and buckets: counts, gains and weights of a small table."""
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    got = {r["doc_id"]: r for r in importance_resampling.resampled(real, target, n=2, buckets=97, percent=50, least_words=5).collect()}

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 97 for n in (1, 2) for i in range(len(w) - n + 1)]

    known = texts_of(real)
    s, t = Counter(b for x in known.values() for b in features(x)[1]), Counter(features("the quick brown fox")[1])
    gain = [int(np.floor(1000 * np.log((t[b] + 1.0) * (s.total() + 97.0) / ((s[b] + 1.0) * (t.total() + 97.0))))) for b in range(97)]
    able = 0
    for d, x in known.items():
        w, f = features(x)
        able += len(w) >= 5
        assert (got[d]["n_words"], got[d]["n_features"], got[d]["weight"]) == (len(w), len(f), sum(gain[b] for b in f))
    drawn = sorted((r for r in got.values() if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, able // 2 + 1))
    assert [(-r["score"], r["doc_id"]) for r in drawn] == sorted((-r["score"], r["doc_id"]) for r in got.values() if r["n_words"] >= 5)[: able // 2]


def test_resampling_odd_rows(docs):  # noqa: F811
    target = docs.select("text")
    rows = importance_resampling.resampled(docs, target, percent=50, least_words=3).collect()
    assert len(rows) == docs.count() and {r["weight"] for r in rows if not r["n_words"]} == {0}
    able = sum(r["n_words"] >= 3 for r in rows)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, able // 2 + 1))
    assert importance_resampling.resampled(docs.limit(0), target).count() == 0
    assert importance_resampling.resampled(docs, target.limit(0)).count() == docs.count()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(prefix_counts.vocabulary())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_prefix_counts_equal_the_library(library):
    rng = random.Random(4)
    counter = prefix_counts.counter_of(prefix_counts.vocabulary())
    parts = [*"abcdefghij ETAOINS  \n\t'''.,!?-0123456789éß日本語՘࢏ \xa0\x1c\x85\U0001f600", "'re", "'ve", "'ll", "'s", "<|endoftext|>", "<|endof", " the", " and", "ing", "   "]
    for _ in range(1_500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        counts = [library(text[:k]) for k in range(len(text) + 1)]
        assert counter.prefixes(text) == counts and counter.totals([text]) == counts[-1:]
        for limit in (0, 1, 3, 7, 20):
            assert counter.fitting(text, limit) == max(k for k, c in enumerate(counts) if c <= limit)


def test_token_neighbours_equal_the_library(library):
    """follows(u, v) for random tokens and for tokens that merge: the joined text encodes as two tokens."""
    rng = random.Random(6)
    counter = prefix_counts.counter_of(prefix_counts.vocabulary())
    words = [b for b in counter.number if b.isascii() and b.isalpha()]
    for _ in range(3_000):
        u, v = rng.choice(words), rng.choice(words)
        k = rng.randint(1, len(u))
        u, v = (u, v) if rng.random() < 0.5 or u[k:] not in counter.number else (u[:k], u[k:])
        joined = counter.byte_counts(u + v)
        assert joined[-1] == library((u + v).decode())
        if u in counter.number and counter.follows(counter.number[u], counter.number[v]):
            assert joined[-1] == 2


def test_count_report_equals_the_library(spark, docs, real, library):  # noqa: F811
    for df in (docs, real):
        known, got = texts_of(df), prefix_counts.count_report(df, 40).collect()
        assert len(got) == df.count()
        for r in got:
            if r["doc_id"] is not None:
                text = known[r["doc_id"]]
                assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), library(text), library(text) > 40)
                assert library(text[: r["fitting_chars"]]) <= 40 and (r["fitting_chars"] == len(text)) >= (r["n_tokens"] <= 40)
    assert prefix_counts.count_report(docs.limit(0)).count() == 0


def test_prefix_column_answers_budgets(spark, library):
    from pyspark.sql import functions as F

    text = "It's the unbelievable   story of\n\n a fox<|endoftext|> we've read"
    df = ship(spark).createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, prefix_tokens string")
    found = prefix_counts.token_prefixes(df)
    column = F.col(found.columns[-1])
    assert found.columns[-1] == "prefix_tokens_"
    row = found.where("doc_id = 1").select(*(prefix_counts.tokens_of_first(column, F.lit(k)) for k in range(len(text) + 1))).first()
    assert list(row) == [library(text[:k]) for k in range(len(text) + 1)]
    for limit in (0, 2, 5, 100):
        cut = found.select("doc_id", prefix_counts.chars_within(column, limit).alias("n")).collect()
        assert {r["doc_id"]: r["n"] for r in cut} == {1: max(k for k in range(len(text) + 1) if library(text[:k]) <= limit), 2: 0, 3: 0}


@pytest.mark.parametrize("text", ["a" * 40_000, " " * 40_000, "-" * 20_000, "日" * 20_000, "ab" * 20_000])
def test_one_very_long_piece(text, library):
    assert prefix_counts.counter_of(prefix_counts.vocabulary()).totals([text]) == [library(text)]
