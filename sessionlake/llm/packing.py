"""Packing of documents into batches of like lengths.

A dynamic program over the histogram of all lengths chooses the bucket lengths
with the least padding; inside each bucket, batches hold as many documents as
the token budget has room for at the bucket's length.  A document's place in
its bucket is its rank in the order of a hash of its key.  Rows are dealt to
ranges of bucket, hash and row number, and counted from the sizes of these, so
neither a bucket nor a key meets in one task.

Tokens are words unless ``length`` says otherwise, such as
``F.size("ids")`` of encoded texts.

Bounds: the histogram has a row for each different length.  k different lengths
above 65,536 words need more than k * 65,536 words of text, so its size follows
the number of very long documents at most.

Defined cases: the length of a text is its number of words (runs of anything
but ASCII white space); a null or empty text has length 0 and is packed too; a
text longer than the budget is a batch by itself, and is not cut; repeated rows
are packed one by one; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, need

BUCKETS = 16
BUDGET = 16_384

#: A partition's number and a row's place in it share a number.
_PLACES = 33


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """The largest lengths of the buckets with the least total padding.

    ``cost[j]`` is the least padding of the first j lengths in k buckets; the
    best start of the last bucket minimises lines in the length, so each round
    walks a lower envelope once.  Of equal costs, the earliest start counts.
    """
    rows = sorted(histogram)
    m = len(rows)
    if not m:
        return []
    v = [0] + [r[0] for r in rows]
    count, total = [0], [0]
    for length, n in rows:
        count.append(count[-1] + n)
        total.append(total[-1] + n * length)
    cost: list[int | None] = [0] + [None] * m
    starts: list[list[int]] = []
    for _ in range(min(buckets, m)):
        lines: deque[tuple[int, int, int]] = deque()  # slope, offset, start
        after: list[int | None] = [None] * (m + 1)
        start = [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] is not None:
                new = (-count[i], cost[i] + total[i], i)
                while len(lines) > 1 and _useless(lines[-2], lines[-1], new):
                    lines.pop()
                lines.append(new)
            while len(lines) > 1 and lines[1][0] * v[j] + lines[1][1] < lines[0][0] * v[j] + lines[0][1]:
                lines.popleft()
            if lines:
                slope, offset, start[j] = lines[0]
                after[j] = slope * v[j] + offset + v[j] * count[j] - total[j]
        cost = after
        starts.append(start)
    out, j = [], m
    for start in reversed(starts):
        out.append(v[j])
        j = start[j]
    return out[::-1]


def _useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether line b is nowhere below both a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """``key, n_tokens, bucket, bucket_length, batch, slot``, a row for each row.
    ``length`` may give other lengths than words, from the columns of ``docs``."""
    ws = Workspace(docs.sparkSession, "packing")
    if length is None:
        given = need(docs, key, text).toDF("id", "text").select("id", word_count(F.col("text")).alias("n"))
    else:
        given = docs.select(F.col(f"`{key}`").alias("id"), length.cast("bigint").alias("n"))
    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    # a row's number parts rows of the same key; it is written, so that it holds
    rows = ws.keep(given.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("place", order).withColumn("row", F.monotonically_increasing_id()), "lengths")
    histogram = [(r.n, r.documents) for r in rows.groupBy("n").agg(F.count("*").alias("documents")).collect()]
    ends = boundaries(histogram, buckets)
    room = [max(1, budget // max(1, e)) for e in ends]
    members = [sum(n for v, n in histogram if v <= e and (not i or v > ends[i - 1])) for i, e in enumerate(ends)]
    first = [0]
    for n, r in zip(members, room):
        first.append(first[-1] + math.ceil(n / r))
    constant = lambda x: F.array(*[F.lit(i).cast("bigint") for i in x]) if x else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(constant(ends), lambda e: e < F.col("n"))))
    ordered = ["bucket", "place", "id", "n", "row"]
    rows = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("at", F.monotonically_increasing_id())
    rows = ws.keep(rows.select("id", "n", "bucket", F.shiftright("at", _PLACES).alias("range"), F.col("at").bitwiseAND((1 << _PLACES) - 1).alias("place")), "ranges")
    sizes = rows.groupBy("bucket", "range").agg(F.count("*").alias("size"), F.min("place").alias("start"))
    # a row for each range, and one more for each bucket; their running sums, by bucket
    before = F.sum("size").over(Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ws.keep(sizes.select("bucket", "range", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("before")), "offsets")
    out = rows.join(offsets, ["bucket", "range"]).withColumn("rank", F.col("before") + F.col("place"))
    per = F.get(constant(room), F.col("bucket"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_tokens"), "bucket", F.get(constant(ends), F.col("bucket")).alias("bucket_length"),
        (F.get(constant(first), F.col("bucket")) + F.floor(F.col("rank") / per)).cast("bigint").alias("batch"),
        (F.col("rank") % per).cast("bigint").alias("slot"),
    )
