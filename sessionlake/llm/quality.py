"""Quality rules of documents and of the hosts that they come from.

Everything here is a DataFrame expression.  Each document is measured by
itself; rule failures are then counted for each host, each host's failure rate
is shrunk towards a beta prior fitted to all hosts, and the host's verdict is
joined back to its documents.

Defined cases: a null text has no words, and so fails; the empty text likewise;
a text is measured whole at any length; repeated rows are measured and counted
one by one; a document whose host is null gets no host verdict; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, step

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINES_PERCENT = 60

#: A host is rejected where the shrunk failure rate of a rule is above this.
HOST_MAX_RATE = 0.5

_SPACE = "[\\x20\\x09-\\x0D]+"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``,
    and the columns to carry, as ``carried0`` and so on."""
    more = [f"carried{i}" for i in range(len(carry))]
    at = [docs.columns.index(c) for c in (key, host, text, *carry)]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    df = plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, ["id", "host", "text", *more])])
    df = df.select("id", "host", *more, F.coalesce("text", F.lit("")).alias("text"))
    stripped = F.regexp_replace("text", f"^{_SPACE}|{_SPACE}$", "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    df = step(
        df, ["id", "host", *more],
        words=F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, _SPACE)),
        n_symbols=F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint"),
        lines=lines,
    )
    df = step(
        df, ["id", "host", *more, "n_symbols"],
        n_words=F.size("words").cast("bigint"),
        word_chars=F.length(F.array_join("words", "")).cast("bigint"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        hashes=F.transform("words", lambda x: F.xxhash64(x)),
    )
    rest = ["id", "host", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # a window is told by a 64-bit hash of its words' hashes
    first = F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0)))
    df = step(df, rest, windows=F.transform(first, lambda x, i: F.xxhash64(x, *[F.get("hashes", i + k) for k in range(1, WINDOW)])))
    df = step(df, [*rest, "windows"], ordered=F.sort_array("windows"))
    repeats = F.exists(F.transform("ordered", lambda x, i: x.eqNullSafe(F.get("ordered", i - 1))), lambda x: x)
    # only texts with a repeated window go on to find where they are
    df = step(df, rest, placed=F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("placed", lambda x, i: x["h"].eqNullSafe(F.get("placed", i - 1)["h"]) | x["h"].eqNullSafe(F.get("placed", i + 1)["h"]))
    df = step(df, rest, at=F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    return df.select(
        F.col("id").alias(key), F.col("host").alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"), *more,
    )


def rules() -> dict[str, Column]:
    """What a document fails by; ``short`` and ``repeats`` reject it by itself."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n,
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * n,
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """``host, documents`` and each rule's failures, counted by host."""
    return measured.filter("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("documents"), *[F.count_if(c).alias(k) for k, c in rules().items()]
    )


def fit_beta(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Each rule's prior by moments: the mean rate, and the part of the variance
    between hosts that their counts don't explain.  One row comes to the driver."""
    names = list(rules())
    rate = {k: F.col(k) / F.col("documents") for k in names}
    row = hosts.agg(
        F.count("*").alias("hosts"),
        F.avg(1 / F.col("documents")).alias("inverse"),
        *[F.avg(rate[k]).alias(f"{k}_mean") for k in names],
        *[F.var_pop(rate[k]).alias(f"{k}_var") for k in names],
    ).first()
    out = {}
    for k in names:
        if not row["hosts"]:
            out[k] = (1.0, 1.0)
            continue
        mean = min(max(row[f"{k}_mean"], 1e-3), 1 - 1e-3)
        spread, noise = mean * (1 - mean), row["inverse"]
        between = (row[f"{k}_var"] - spread * noise) / max(1 - noise, 1e-9)
        strength = min(max(spread / between - 1, 2.0), 1000.0) if between > 0 else 1000.0
        out[k] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(hosts: DataFrame, prior: dict[str, tuple[float, float]], most: float = HOST_MAX_RATE) -> DataFrame:
    """``host, host_rejected``."""
    shrunk = [(F.col(k) + a) / (F.col("documents") + a + b) for k, (a, b) in prior.items()]
    return hosts.select("host", (F.greatest(*shrunk) > most).alias("host_rejected"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the five measures, ``base_failed, host_rejected, kept``, and the
    columns to carry, as ``carried0`` and so on; so whole rows can be filtered by
    their own verdict, without a join of the texts."""
    ws = Workspace(docs.sparkSession, "quality")
    by_rule = rules()
    measured = measure(docs, key, text, host, carry).withColumn("base_failed", by_rule["short"] | by_rule["repeats"])
    measured = ws.keep(measured, "measured", "zstd" if carry else "snappy")  # so that texts are measured once
    hosts = ws.keep(host_rates(measured), "hosts")
    verdicts = host_verdicts(hosts, fit_beta(hosts)).filter("host_rejected")
    verdicts = ws.keep(verdicts, "verdicts")  # Spark knows its size, and broadcasts it only if that allows
    out = measured.join(verdicts, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), *[f"carried{i}" for i in range(len(carry))],
    )
