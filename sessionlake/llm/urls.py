"""URL filters: rules by host and path, and a classifier for the rest.

The classifier is a logistic regression on hashed character n-grams of host and
path, trained from a small labelled table of URLs; training and scoring are
DataFrame expressions.  Gradient descent from zero weights keeps the weights a
sum of the examples' features, so the training runs on one coefficient for each
example and their table of inner products.

Defined cases: a null url, or one without ``://``, has an empty host and path;
so has no rule, and the classifier judges the empty strings; a url of any
length is judged whole; of rules of equal length that fit, the first in text
order counts; repeated rows are judged one by one; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, step

#: Rules become one expression, and examples one row; both are small by contract.
MAX_RULES = 1_000
MAX_EXAMPLES = 512

BUCKETS = 8192
SIZES = (3, 4, 5)
EPOCHS = 150
RATE = 0.5
DECAY = 0.001
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = [F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(found[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found[1]


def rule_column(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule ``(host, path, verdict)`` that fits, and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most")
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(letters: str, n: int) -> Column:
    first = F.slice(letters, F.lit(1), F.greatest(F.size(letters) - (n - 1), F.lit(0)))
    gram = lambda x, i: F.concat(x, *[F.get(letters, i + k) for k in range(1, n)])
    # the first 16 bits of MD5, which any SQL engine can compute too
    return F.transform(first, lambda x, i: F.pmod(F.conv(F.substring(F.md5(gram(x, i)), 1, 4), 16, 10).cast("int"), F.lit(BUCKETS)))


def with_features(df: DataFrame, keep: list[str], host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``features``, the distinct buckets of the n-grams of host and path."""
    text = F.concat(F.lit("^"), F.col(host), F.lit("$"), F.col(path))
    df = step(df, keep, letters=F.split(text, ""))
    return step(df, keep, features=F.array_distinct(F.concat(*[_grams("letters", n) for n in SIZES])))


def train(examples: DataFrame, url: str = "url", label: str = "label") -> tuple[float, list[float]]:
    """Bias and a weight for each bucket, from ``url, label`` (1: to be blocked)."""
    rows = need(examples, url, label).toDF("url", "label").filter("label IS NOT NULL")
    host, path = host_and_path(F.col("url"))
    rows = with_features(rows.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")), ["label"])
    one = rows.limit(MAX_EXAMPLES + 1).agg(F.array_sort(F.collect_list(F.struct("label", "features"))).alias("x"))
    one = step(one, ["x"], kernel=F.transform("x", lambda a: F.transform("x", lambda b: F.size(F.array_intersect(a["features"], b["features"])) + F.lit(1.0))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    n = F.size("x")
    descend = lambda a, _: F.transform("kernel", lambda k, i: F.get(a, i) * (1 - RATE * DECAY) + (F.get("x", i)["label"] - 1 / (1 + F.exp(-dot(k, a)))) * RATE / n)
    fitted = step(one, ["x"], a=F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), F.transform("x", lambda _: F.lit(0.0)), descend))
    parts = fitted.select(F.inline(F.arrays_zip(F.col("x.features").alias("features"), "a"))).select("a", F.explode(F.concat(F.array(F.lit(-1)), "features")).alias("k"))
    found = {r.k: r for r in parts.groupBy("k").agg(F.sum("a").alias("w"), F.count("*").alias("n")).collect()}  # a row for each bucket at most
    if not found:
        return 0.0, [0.0] * BUCKETS
    if found[-1].n > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} labelled urls")
    return found[-1].w, [found[k].w if k in found else 0.0 for k in range(BUCKETS)]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], examples: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, score``; score is the classifier's."""
    bias, weights = train(examples)
    df = need(pages, key, url).toDF("id", "url")
    host, path = host_and_path(F.col("url"))
    df = with_features(df.select("id", host.alias("host"), path.alias("path")), ["id", "host", "path"])
    table = F.split(F.lit(",".join(repr(w) if w else "0" for w in weights)), ",").cast("array<double>")  # folded into one constant
    total = F.aggregate("features", F.lit(bias), lambda s, k: s + F.get(table, k))
    df = step(df, ["id", "host", "path"], score=1 / (1 + F.exp(-total)))
    rule, verdict = rule_column(rules, F.col("host"), F.col("path"))
    other = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return df.select(F.col("id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), F.round("score", 4).alias("score"))
