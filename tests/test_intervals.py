"""Events in intervals against brute force: runs out of order, dense events, missing bounds; and what is sent."""

import random
import time
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

import sessionlake as S
from sessionlake import queries
from sessionlake.operators import intervals

UNITS = "_nwb_path string, _table_index bigint, spike_times array<bigint>, obs_intervals array<array<bigint>>"
TRIALS = "_nwb_path string, _table_index bigint, start_time bigint, stop_time bigint, label string"
WINDOWS = {"whole": ("start_time", "stop_time"), "before": ("start_time - 7", "start_time"), "reversed": ("stop_time", "start_time")}


def made(seed):
    rng = random.Random(seed)
    units, trials = [], []
    for p in "pq":
        for i in range(14):
            n = rng.choice([0, 1, 3, 40, 300])
            seen = rng.choice([None, [], [[100, 900]], [[0, 300], [400, 1000]], [[None, 500]]])
            units.append((p, i, sorted(rng.choices(range(1000), k=n)) if i else None, seen))
        for i in range(60):
            start = rng.choice([None, *rng.choices(range(1000), k=9)])
            stop = rng.choice([None, *[(start or 0) + rng.choice([-5, 0, 20, 20, 20, 400]) for _ in range(15)]])
            trials.append((p, i, start, stop, f"t{i}"))
    units.append(("alone", 0, [1, 2], None))
    return units, trials


def inside(times, begin, end):
    return [] if begin is None or end is None else [t for t in times or [] if begin <= t < end]


def held(seen, start, stop):
    return not seen or any(not ((a is not None and start is not None and a > start) or (b is not None and stop is not None and b < stop)) for a, b in seen)


def brute(units, trials, masked):
    out = {}
    for p, i, times, seen in units:
        for q, j, start, stop, _ in trials:
            if p == q:
                got = [inside(times, start, stop), inside(times, None if start is None else start - 7, start), inside(times, stop, start)]
                out[p, i, j] = got if not masked or held(seen, start, stop) else [None] * 3
    return out


def test_held_as_brute_force_has_it(spark):
    units, trials = made(0)
    seen = spark.createDataFrame([(u[3], t[2], t[3]) for u in units for t in trials], "seen array<array<bigint>>, a bigint, b bigint")
    assert all(r.got == held(r.seen, r.a, r.b) for r in seen.withColumn("got", intervals.observed(F.col("seen"), F.col("a"), F.col("b"))).collect())


@pytest.mark.parametrize("run", [5, 1_024])
@pytest.mark.parametrize("masked", [False, True])
def test_against_brute_force(spark, monkeypatch, run, masked):
    monkeypatch.setattr(intervals, "RUN", run)
    units, trials = made(run + masked)
    want = brute(units, trials, masked)
    us, ts = spark.createDataFrame(units, UNITS).repartition(3), spark.createDataFrame(trials, TRIALS).repartition(3)
    for only in (False, True):
        rows = {k: v for k, v in want.items() if not only or any(v)}
        got = S.events_in_intervals(us, WINDOWS, ts, apply_obs_intervals=masked, only_with_events=only).collect()
        key = lambda r: (r["_nwb_path"], r["_units_table_index"], r["_intervals_table_index"])
        assert len(got) == len(rows) and {key(r): [r.whole, r.before, r.reversed] for r in got} == rows
        assert all(r.label == f"t{r['_intervals_table_index']}" for r in got)
        got = S.events_in_intervals(us, WINDOWS, ts, apply_obs_intervals=masked, as_counts=True, keep_only_necessary_cols=True, only_with_events=only).collect()
        assert {key(r): [r.whole, r.before, r.reversed] for r in got} == {k: [None if x is None else len(x) for x in v] for k, v in rows.items()}
    got = S.events_in_intervals(us, {"a": ("start_time", "stop_time")}, ts, apply_obs_intervals=masked, align_times=True, only_with_events=True).collect()
    start = {(t[0], t[1]): t[2] for t in trials}
    assert {key(r): [t + start[key(r)[0], key(r)[2]] for t in r.a] for r in got} == {k: v[0] for k, v in want.items() if v[0]}


def sent(spark):
    time.sleep(1)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_what_is_sent_does_not_grow_with_pairs(spark):
    units = spark.range(0, 3_000, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.col("id").alias(S.TABLE_INDEX), F.array(F.col("id") * 1_000).alias("spike_times"))
    trials = spark.range(0, 2_000, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.col("id").alias(S.TABLE_INDEX), (F.xxhash64("id") % 1_000_000).alias("start_time")).withColumn("stop_time", F.col("start_time") + 7_919)
    before = sent(spark)
    found = S.events_in_intervals(units, {"n": ("start_time", "stop_time")}, trials, as_counts=True, keep_only_necessary_cols=True)
    pairs = found.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("_intervals_table_index") * F.col("n"))).first()
    assert pairs.rows == 6_000_000 and pairs.n > 0
    assert sent(spark) - before < 1_000_000  # blocks of 16 units took some 10 MB


def test_many_events_in_a_run(spark):
    """Intervals in order of time, and in each of their runs nearly as many events as are searched in its bounds."""
    rng = random.Random(1)
    starts = sorted(rng.randrange(4_000_000) for _ in range(4_096))
    times = {i: sorted(rng.choices(range(4_000_000), k=800)) for i in range(48)}
    seen = {i: [[0, 2_000_000]] if i % 2 else None for i in times}
    units = spark.createDataFrame([("p", i, times[i], seen[i]) for i in times], UNITS)
    trials = spark.createDataFrame([("p", j, s, s + 5_000, "") for j, s in enumerate(starts)], TRIALS)
    began = time.time()
    got = S.events_in_intervals(units, {"n": ("start_time", "stop_time")}, trials, as_counts=True, keep_only_necessary_cols=True).collect()
    took = time.time() - began
    count = lambda i, s: bisect_left(times[i], s + 5_000) - bisect_left(times[i], s) if held(seen[i], s, s + 5_000) else None
    assert {(r["_units_table_index"], r["_intervals_table_index"]): r.n for r in got} == {(i, j): count(i, s) for i in times for j, s in enumerate(starts)}
    assert took < 15  # 1.5 s, and 33 s with what a run has found again for each event


def test_what_is_sent_with_observations_does_not_grow_with_pairs(spark):
    units = spark.range(0, 3_000, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.col("id").alias(S.TABLE_INDEX), F.array(F.col("id") * 1_000).alias("spike_times"))
    units = units.withColumn("obs_intervals", F.array(F.array(F.lit(0).cast("bigint"), F.lit(1_500_000).cast("bigint"))))
    trials = spark.range(0, 2_000, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.col("id").alias(S.TABLE_INDEX), (F.col("id") * 1_000).alias("start_time")).withColumn("stop_time", F.col("start_time") + 8_000)
    before = sent(spark)
    found = S.events_in_intervals(units, {"n": ("start_time", "stop_time")}, trials, as_counts=True, keep_only_necessary_cols=True)
    pairs = found.agg(F.count("*").alias("rows"), F.count("n").alias("held"), F.sum("n").alias("n")).first()
    assert (pairs.rows, pairs.held, pairs.n) == (6_000_000, 3_000 * 1_493, 8 * 1_493)
    assert sent(spark) - before < 1_500_000


@pytest.mark.parametrize("window", list(WINDOWS))
@pytest.mark.parametrize("fixed", [False, True])
def test_sums_against_brute_force(spark, fixed, window):
    units, trials = made(7)
    if fixed:  # begins and ends have one order
        trials = [(p, i, start, None if start is None else start + 90, label) for p, i, start, _, label in trials]
    units += [(None, 5, [1, 2], None), ("q", 90, [100] * 9 + [None], None)]
    trials += [("nobody", 1, 0, 10, ""), (None, 2, 0, 10, "")]
    at = list(WINDOWS).index(window)
    each = {}
    for (p, i, j), got in brute([(p, i, [t for t in times or [] if t is not None], seen) for p, i, times, seen in units if p], trials, False).items():
        each.setdefault((p, j), []).append(len(got[at]))
    us, ts = spark.createDataFrame(units, UNITS).repartition(3), spark.createDataFrame(trials, TRIALS).repartition(3)
    got = intervals.summed_intervals(us, WINDOWS[window], ts).collect()
    assert sorted((r["_nwb_path"], r["_intervals_table_index"], r.units, r.events, r.most) for r in got) == sorted((*k, len(n), sum(n), max(n)) for k, n in each.items())


def test_sums_take_no_time_of_pairs(spark):
    """64 million pairs, of which 3 in 10 have events."""
    units = spark.range(0, 4_000, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.col("id").alias(S.TABLE_INDEX), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: k * 100_000 + F.col("id") * 20).alias("spike_times"))
    trials = spark.range(0, 16_000, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.col("id").alias(S.TABLE_INDEX), (F.col("id") * 250).alias("start_time")).withColumn("stop_time", F.col("start_time") + 30_000)
    began = time.time()
    got = intervals.summed_intervals(units, ("start_time", "stop_time"), trials).agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("events").alias("events"), F.max("most").alias("most")).first()
    want = sum(min(t // 250, 15_999) - max((t - 30_000) // 250, -1) for t in (k * 100_000 + i * 20 for i in range(4_000) for k in range(40)))
    assert (got.n, got.units, got.events, got.most) == (16_000, 64_000_000, want, 1)
    assert time.time() - began < 60


def test_counts_query_takes_no_time_of_pairs(spark):
    """7.6 million pairs; with each of them made it took more than 80 s."""
    began = time.time()
    got = queries.spikes_in_intervals_counts(spark, "/root/testdata/sf0.1").agg(F.count("*").alias("n"), F.sum("units").alias("units")).first()
    assert (got.n, got.units) == (20_302, 7_613_250)
    assert time.time() - began < 40


def test_pairs_take_little_room_in_files(spark, tmp_path):
    """Intervals of a run follow each other for one unit after another, so files repeat themselves within a page."""
    units = spark.range(0, 600, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.col("id").alias(S.TABLE_INDEX), F.array(F.col("id") * 100_000).alias("spike_times"))
    trials = spark.range(0, 30_000, 1, 4).select(F.lit("p").alias(S.SESSION_PATH), F.xxhash64("id").alias(S.TABLE_INDEX), (F.col("id") * 5_000).alias("start_time")).withColumn("stop_time", F.col("start_time") + 20_000)
    found = S.events_in_intervals(units, {"n": ("start_time", "stop_time")}, trials, as_counts=True, keep_only_necessary_cols=True)
    found.write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert got.rows == 18_000_000 and got.n == sum(min(t // 5_000, 29_999) - max((t - 20_000) // 5_000, -1) for t in range(0, 60_000_000, 100_000))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 15_000_000
