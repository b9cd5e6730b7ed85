"""URL filter: rules first, then gradient-boosted trees on lexical features, learned from the URLs that rules label.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; path: from there up to "?", "#" or the end.
A rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule wins.

Features: lengths, path depth, digit and punctuation ratios, character entropy, numbers of parameters, host labels and
hyphens, and suffix statistics: the smoothed share of blocked URLs among all labelled ones that share the last host label,
and the last two. The trees are Spark's own (GBTClassifier), fitted on at most TRAINING labelled rows, those with the
smallest hash of the URL; suffix statistics count all labelled rows.

A null URL, or one without "://", has empty host and path, fits no rule and is judged by the trees. Without labelled URLs
of both kinds the only kind there is (allow, if none) is every verdict. Rows that repeat are answered alike.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules that the contract of this operator gives (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TRAINING = 20_000
TREES, DEPTH = 20, 4
SMOOTHING = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "punctuation_ratio", "entropy", "parameters", "query_length", "labels",
    "hyphens", "fragment", "secure", "suffix_rate", "domain_rate", "suffix_rows", "domain_rows",
]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.split(text, "")
    each = lambda cs: F.aggregate(
        F.array_distinct(cs), F.lit(0.0), lambda acc, c: acc - F.size(F.filter(cs, lambda x: x == c)) / F.size(cs) * F.log2(F.size(F.filter(cs, lambda x: x == c)) / F.size(cs))
    )
    return F.get(F.transform(F.array(chars), each), F.lit(0))


def lexical(pages: DataFrame) -> DataFrame:
    """pages (with url, host, path) and the features that need no other row, and suffix and domain."""
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    count = lambda text, chars: (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.array_remove(F.split("host", r"\."), "")
    return pages.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"), "digit_ratio": count(url, "[0-9]") / n, "host_digits": count(F.col("host"), "[0-9]"),
        "punctuation_ratio": count(url, "[^A-Za-z0-9]") / n, "entropy": F.coalesce(entropy(url), F.lit(0.0)), "parameters": count(query, "="),
        "query_length": F.length(query).cast("double"), "labels": F.size(labels).cast("double"), "hyphens": count(F.col("host"), "-"),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.startswith(url, F.lit("https:")).cast("double"),
        "suffix": F.coalesce(F.get(F.reverse(labels), F.lit(0)), F.lit("")), "domain": F.concat_ws(".", F.slice(F.concat(F.array(F.lit("")), labels), -2, 2)),
    })


def rates(rows: DataFrame, key: str) -> DataFrame:
    """The smoothed share of blocked rows for each value of the key, and the log of its rows. A value's rows are added up
    before the shuffle, so a hot value is one row for each task."""
    blocked, n = F.sum((F.col("verdict") == "block").cast("long")), F.count("*")
    return rows.where("verdict is not null").groupBy(key).agg(
        ((blocked + SMOOTHING / 2) / (n + SMOOTHING)).alias(f"{key}_rate"), F.log1p(n).alias(f"{key}_rows")
    )


def featured(pages: DataFrame) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict (the rule's) and all features."""
    text, verdict = fitting(RULES)
    rows = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumns({"rule": text, "verdict": verdict})
    rows = lexical(rows)
    for key in ("suffix", "domain"):
        rows = rows.join(rates(rows, key), key, "left").fillna({f"{key}_rate": 0.5, f"{key}_rows": 0.0})
    return rows


def fitted(rows: DataFrame) -> GBTClassificationModel | str:
    """The trees, or the only verdict that the labelled rows have."""
    known = rows.where("verdict is not null")
    sample = known.select(*FEATURES, (F.col("verdict") == "block").cast("double").alias("label"), F.xxhash64("url").alias("order"))
    sample = sample.orderBy("order", *FEATURES).limit(TRAINING)
    kinds = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(kinds) < 2:
        return "block" if kinds == {1.0} else "allow"
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label").repartition(4, "label", F.hash("features"))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=32).fit(vectors)


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' chance of block; null if there are none)."""
    rows = featured(pages.select("page_id", "url"))
    model = fitted(rows)
    if isinstance(model, str):
        scored = rows.withColumn("score", F.lit(None).cast("double")).withColumn("guess", F.lit(model))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
        scored = scored.withColumn("guess", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", "guess").alias("verdict"), "score")
