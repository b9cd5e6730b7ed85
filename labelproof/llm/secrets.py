"""Secrets in texts: fixed patterns, and a battery of randomness tests for other strings. Spark expressions only.

Patterns (leftmost, non-overlapping for each kind): assignments of a value of 8 or more characters to a name such as
password or token, access keys, runs of 32 or more hex digits.

Battery: every maximal run of 20 or more characters of [A-Za-z0-9+/_=-] outside those spans is a candidate. Its encoding
is inferred from its characters (decimal, hex, base 32, letters of one case, letters and digits, base 64). Three tests take
the candidate for random characters of that alphabet: chi-squared of the alphabet's uniformity, runs above and below the
middle of the alphabet, and serial correlation of neighbours. A fourth value takes it for ordinary text: the chance that
letters with the index of coincidence of English come as close to uniformity. That chance falls with length, so short strings
can't pass. A discovery is a candidate that no randomness test rejects (at TEST_LEVEL) and whose chances of being ordinary
pass a Benjamini-Hochberg step-up at FALSE_DISCOVERIES over all candidates of the same encoding. The ranks come from counts
on a fixed grid of log-chances, a table of at most GRID rows for each of six encodings.

Null is the empty text. Rows are answered each on their own; repeated rows count as repeated candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that the contract of this operator gives.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: name, what all its characters match, alphabet in order, size (base 64 has two spellings of two characters).
ENCODINGS = [
    ("decimal", "^[0-9]+$", "0123456789", 10),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789ABCDEF", 16),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    ("letters", "^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26),
    ("alnum", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 62),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 64),
]
TEST_LEVEL = 0.001
FALSE_DISCOVERIES = 0.01
#: Steps of the grid of log-chances (a twentieth of a power of ten) and their number.
STEPS, GRID = 20, 800
#: Fixed value: the index of coincidence of English text (Friedman), the chance that two of its letters are equal.
COINCIDENCE = 0.0667


def located(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """(start, kind, end) of the matches, where the group has at least so many characters. Positions are code points:
    they add up the lengths of what lies between the matches and of the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("all"), inner.alias("in"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["all"]), F.lit(0))
        span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(F.length(x["in"]) >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), F.aggregate(both, start, step)["spans"]).otherwise(none)


def base_spans(text: Column) -> Column:
    parts = [located(text, ASSIGN, 0, 8, 2), located(text, ACCESS, 1, 16), located(text, HEX, 2, 32)]
    return F.array_sort(F.concat(*parts))


def candidates(text: Column, base: Column) -> Column:
    """(start, kind, end) of the candidates that touch no base span."""
    clear = lambda c: ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    return F.filter(located(text, CANDIDATE, 3, 20), clear)


def upper_tail(x: Column) -> Column:
    """The standard normal's upper tail (Abramowitz and Stegun 26.2.17)."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, tail).otherwise(1 - tail)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def battery(token: Column) -> Column:
    """(encoding, random: whether no test rejects randomness, ordinary: log10 of the chance as ordinary text)."""

    def chosen(values: list, e: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), e + 1)

    def coded(e: Column) -> Column:
        shown = F.when(e.isin(1, 3), F.upper(token)).otherwise(F.regexp_replace(token, "=+$", ""))
        alphabet = chosen([x[2] for x in ENCODINGS], e)
        return F.transform(F.split(shown, ""), lambda c: F.position(c, alphabet).cast("double"))

    def total(values: Column, of) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))

    def moments(e: Column, c: Column) -> Column:
        n, k = F.size(c).cast("double"), chosen([float(x[3]) for x in ENCODINGS], e)
        return F.struct(n.alias("n"), k.alias("k"), (total(c, lambda x: x) / n).alias("mean"), F.size(F.filter(c, lambda x: x > (k + 1) / 2)).cast("double").alias("n1"))

    def sums(c: Column, m: Column) -> Column:
        middle, mean, pairs = (m["k"] + 1) / 2, m["mean"], F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1)))
        own = lambda i: F.get(c, i.cast("int"))
        count = lambda x: F.size(F.filter(c, lambda y: y == x)).cast("double")
        return F.struct(
            (total(F.array_distinct(c), lambda x: count(x) * count(x)) * m["k"] / m["n"] - m["n"]).alias("chi"),
            (1.0 + F.size(F.filter(pairs, lambda i: (own(i) > middle) != (own(i - 1) > middle)))).alias("runs"),
            total(c, lambda x: (x - mean) * (x - mean)).alias("spread"),
            total(pairs, lambda i: (own(i) - mean) * (own(i - 1) - mean)).alias("serial"),
        )

    def judged(e: Column, m: Column, t: Column) -> Column:
        n, k, n1 = m["n"], m["k"], m["n1"]
        df, n0 = k - 1, n - n1
        p_chi = upper_tail((F.pow(t["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        expected = 1 + 2 * n1 * n0 / n
        variance = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-6))
        p_runs = 2 * upper_tail(F.abs(t["runs"] - expected) / F.sqrt(variance))
        p_serial = 2 * upper_tail(F.abs(t["serial"] / F.greatest(t["spread"], F.lit(1e-6)) + 1 / n) * F.sqrt(n))
        drift = n * (k * F.greatest(F.lit(COINCIDENCE), 1.5 / k) - 1)  # how far ordinary text lies from uniformity
        z = (df + drift - t["chi"]) / F.sqrt(2 * (df + 2 * drift))
        level = F.lit(TEST_LEVEL / 3)
        return F.struct(
            e.alias("encoding"), ((n1 > 0) & (n0 > 0) & (p_chi > level) & (p_runs > level) & (p_serial > level)).alias("random"),
            F.log10(F.greatest(upper_tail(z), F.lit(1e-40))).alias("ordinary"),
        )

    encoding = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(token.rlike(ENCODINGS[k][1]), k).otherwise(encoding)
    return bound(encoding, lambda e: bound(coded(e), lambda c: bound(moments(e, c), lambda m: bound(sums(c, m), lambda t: judged(e, m, t)))))


def limits(tested: DataFrame) -> dict[int, float]:
    """For each encoding the highest log-chance that the step-up procedure accepts; counts on a grid, ranks from below."""
    cell = F.least(F.floor(-F.col("ordinary") * STEPS), F.lit(GRID)).cast("int")
    rows = tested.groupBy("encoding", cell.alias("cell")).count().collect()  # at most six times GRID rows
    out = {}
    for encoding in {r["encoding"] for r in rows}:
        cells = sorted(((r["cell"], r["count"]) for r in rows if r["encoding"] == encoding), reverse=True)
        total, rank = sum(c for _, c in cells), 0
        for at, count in cells:
            rank += count
            if 10 ** (-at / STEPS) <= FALSE_DISCOVERIES * rank / total:
                out[encoding] = -at / STEPS
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """The columns of docs, whose text is in `text`, and base, found: arrays of (start, kind, end) without and with the
    battery's spans. Two passes: candidates are counted over all texts, then each row is answered alone."""
    text = F.coalesce("text", F.lit(""))
    token = lambda c: F.substring(text, c["start"] + 1, c["end"] - c["start"])
    rows = docs.where(text.rlike(CANDIDATE)).select(text.alias("text")).withColumn("base", base_spans(F.col("text")))
    tokens = rows.select("text", F.explode(candidates(F.col("text"), F.col("base"))).alias("c")).select(token(F.col("c")).alias("token"))
    accepted = limits(tokens.select(battery(F.col("token")).alias("b")).select("b.*"))

    def discovered(c: Column) -> Column:
        good = lambda b: b["random"] & F.coalesce(
            F.element_at(F.create_map(*[F.lit(x) for pair in accepted.items() for x in pair]), b["encoding"]) >= b["ordinary"], F.lit(False)
        )
        return bound(battery(token(c)), good)

    out = docs.withColumn("base", base_spans(text))
    if not accepted:
        return out.withColumn("found", F.col("base"))
    more = F.when(text.rlike(CANDIDATE), F.filter(candidates(text, F.col("base")), discovered)).otherwise(F.slice("base", 1, 0))
    return out.withColumn("found", F.array_sort(F.concat("base", more)))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    found = secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), count(3))
