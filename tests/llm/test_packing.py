import itertools
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from sessionlake.llm import packing

DOCS = "doc_id bigint, text string"


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= v) - v) for v, n in histogram)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    rows = sorted(histogram.items())
    lengths = [v for v, _ in rows]
    ends = packing.boundaries(rows, k)
    best = min(padding(rows, (*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
    assert len(ends) == min(k, len(lengths)) and ends == sorted(set(ends)) and ends[-1] == lengths[-1] and padding(rows, ends) == best


def test_many_lengths_are_quick():
    rng = random.Random(1)
    ends = packing.boundaries([(v, rng.randint(1, 10**9)) for v in range(60_000)], 16)
    assert len(ends) == 16


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * (rng.choice([3, 3, 3, 50, rng.randint(0, 300)])))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), buckets=4, budget=600).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    by = {}
    for r in got:
        assert r.n_tokens == len(rows[r.doc_id][1].split()) <= r.bucket_length
        by.setdefault(r.batch, []).append(r)
    assert sorted(by) == list(range(len(by)))
    partial = {}
    for batch in by.values():
        assert len({r.bucket for r in batch}) == 1 and sorted(r.slot for r in batch) == list(range(len(batch)))
        room = max(1, 600 // max(1, batch[0].bucket_length))
        assert len(batch) <= room
        partial[batch[0].bucket] = partial.get(batch[0].bucket, 0) + (len(batch) < room)
    assert all(n <= 1 for n in partial.values())  # only a bucket's last batch isn't full
    again = packing.pack(spark.createDataFrame(rows, DOCS).repartition(7), buckets=4, budget=600).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_edge_cases(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, 0, 0), (2, "", 0, 0), (3, "x " * 100_000, 0, 0), (None, "a b", 0, 0), (4, "a b", 0, 0), (4, "a b", 0, 0)]
    got = packing.pack(spark.createDataFrame(rows, DOCS + ", n int, bucket int"), budget=1000).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 2, 2, 100_000]
    alone = [r for r in got if r.doc_id == 3][0]
    assert alone.bucket_length >= 100_000 and sum(r.batch == alone.batch for r in got) == 1


def test_given_lengths(spark):
    df = spark.createDataFrame([(1, 5), (2, 70_000), (3, None)], "doc_id bigint, size int")
    got = {r.doc_id: r.n_tokens for r in packing.pack(df, text="size", length=F.col("size")).collect()}
    assert got == {1: 5, 2: 70_000, 3: 0}


def test_long_lengths_are_exact(spark):
    lengths = [65_540, 65_541, 65_599, 131_100, 10**12 + 1, 10**12 + 2, 3]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, size bigint")
    got = {r.n_tokens: r.bucket_length for r in packing.pack(df, text="size", length=F.col("size")).collect()}
    assert got == {n: n for n in lengths}  # fewer lengths than buckets: no padding
    got = {r.n_tokens: r.bucket_length for r in packing.pack(df, text="size", buckets=3, length=F.col("size")).collect()}
    ends = packing.boundaries([(n, 1) for n in lengths], 3)
    assert got == {n: min(e for e in ends if e >= n) for n in lengths}


def test_a_hot_key_is_dealt_to_ranges(spark):
    """Rows of one key, and rows without one, lie in several tasks and keep their order."""
    rows = [(7 if i % 3 else None, "w " * (1 + i % 4)) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(8)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join ranges as small as these
    kept = {}
    keep = packing.Workspace.keep

    def spy(self, df, label, *more):
        kept[label] = keep(self, df, label, *more)
        return kept[label]

    packing.Workspace.keep = spy
    try:
        got = packing.pack(docs, buckets=2, budget=40).collect()
        sizes = [r["count"] for r in kept["ranges"].groupBy("range").count().collect()]
    finally:
        packing.Workspace.keep = keep
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) > 2 and max(sizes) < 1500
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r)
    assert len(got) == 3000 and sorted(by) == list(range(len(by)))
    for rows_of in by.values():
        assert sorted(r.slot for r in rows_of) == list(range(len(rows_of)))
    first, last = {}, {}
    for r in sorted(got, key=lambda r: r.batch):
        first.setdefault((r.bucket, r.doc_id), r.batch)
        last[r.bucket, r.doc_id] = r.batch
    for bucket in {b for b, _ in first}:  # one key's rows follow the other's
        a, b = (None, 7) if first[bucket, None] < first[bucket, 7] else (7, None)
        assert last[bucket, a] <= first[bucket, b]


def test_lengths_in_tokens(spark):
    import public_tokenizers as P

    from sessionlake.llm import bpe

    docs = spark.createDataFrame([(1, "some words here"), (2, "naïveté, 漢字"), (3, None)], DOCS)
    ids = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = {r.doc_id: len(r.ids) for r in ids.collect()}
    got = packing.pack(ids, length=F.size("ids"), buckets=2).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(set(want.values())) == 3
