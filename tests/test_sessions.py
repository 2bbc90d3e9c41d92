import json
import math
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import pytest
from pyspark.sql import functions as F

import sessionlake as S
from sessionlake.functions import scalars
from sessionlake.operators import arrays, intervals, metadata, scan
from sessionlake.plans import catalog, schema
from sessionlake.sources import zarr2
from sessionlake.sources.container import clear_cache, open_container, web_address
from sessionlake.streaming.ingest import session_lengths, stream_lake
from sessionlake.sources import hdf5_writer
from tests import sessions


def test_scan_rows_types_and_provenance(spark, two):
    df = S.scan(spark, two, "trials")
    assert dict(df.dtypes) == {"id": "bigint", "start_time": "double", "stop_time": "double", "condition": "string", "_nwb_path": "string", "_table_path": "string", "_table_index": "bigint"}
    rows = df.orderBy("_nwb_path", "_table_index").collect()
    assert len(rows) == 12 and [r["_table_index"] for r in rows] == [*range(6)] * 2
    assert {r["_nwb_path"] for r in rows} == {os.path.realpath(p) for p in two} and rows[0]["_table_path"] == "intervals/trials"
    assert [r.condition for r in rows[:6]] == list("ABCDEF")


def test_without_consolidated_metadata(spark, tmp_path):
    path = sessions.write(str(tmp_path / "plain.zarr"), 1, consolidated=False)
    assert S.scan(spark, path, "/units").count() == 4


def test_array_columns(spark, two):
    df = S.scan(spark, two[0], "units")
    kinds = dict(df.dtypes)
    assert kinds["spike_times"] == "array<double>" and kinds["obs_intervals"] == "array<array<double>>" and kinds["waveform_mean"] == "array<array<double>>"
    assert not [c for c in kinds if c.endswith("times_index")]
    rows = df.orderBy("_table_index").collect()
    assert [r.spike_times for r in rows] == [sessions.spikes(0, u) for u in range(4)]
    assert rows[1].obs_intervals == [[2.1, 7.5]] and rows[2].waveform_mean == np.arange(12.0, 18.0).reshape(3, 2).tolist()
    assert "spike_times" not in S.scan(spark, two, "units", exclude_array_columns=True).columns
    tags = S.scan(spark, two[0], "epochs").orderBy("id").collect()
    assert [r.tags for r in tags] == [[f"tag_{i}", "task"] for i in range(3)]


def test_small_slices_give_the_same_rows(spark, two):
    from sessionlake.sources import datasource

    whole = S.scan(spark, two[0], "units")
    part = datasource.load(spark, [(two[0], 4)], "units", whole.schema, rowsPerSlice="3", batchRows="2")
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))


def test_filters_reach_the_reader(spark, two):
    one = S.scan(spark, two, "units", columns=["structure", "spike_times"], where=[("_table_index", "=", 2), ("_nwb_path", "=", os.path.realpath(two[1])), ("id", ">", 0)])
    assert [r.spike_times for r in one.collect()] == [sessions.spikes(1, 2)]
    trials = S.scan(spark, two, "trials")
    for where, f in (
        ([("start_time", ">", 4)], "start_time > 4"), ([("condition", "=", "B")], "condition = 'B'"), ([("condition", "in", ["A", "F"]), ("start_time", "<", 8)], "condition IN ('A', 'F') AND start_time < 8"),
        ([("condition", "is null", None)], "condition IS NULL"), ([("id", "<>", 3), ("stop_time", "is not null", None)], "id <> 3"),
    ):
        want = sorted(map(str, trials.filter(f).collect()))
        assert sorted(map(str, S.scan(spark, two, "trials", where=where).collect())) == want
    assert trials.count() == 12 and trials.filter("id = 1").union(trials).count() == 14
    assert S.scan(spark, two, "units", where=[("_nwb_path", "=", "nothing")]).count() == 0
    with pytest.raises(ValueError):
        S.scan(spark, two, "units", where=[("spike_times", "=", 1)])
    with pytest.raises(S.ColumnError):
        S.scan(spark, two, "units", where=[("nothing", "=", 1)])


def test_projection_and_errors(spark, two):
    assert S.scan(spark, two, "trials", columns="condition").columns == ["condition", "_nwb_path", "_table_path", "_table_index"]
    assert "condition" not in S.scan(spark, two, "trials", exclude_columns="condition").columns
    with pytest.raises(ValueError):
        S.scan(spark, two, "trials", columns=["id"], exclude_columns=["id"])
    with pytest.raises(ValueError):
        S.scan(spark, two, "trials", exclude_columns=["_nwb_path"])
    with pytest.raises(S.ColumnError):
        S.scan(spark, two, "trials", columns=["nothing"])
    with pytest.raises(S.InternalPathError):
        S.scan(spark, two, "intervals/nothing")
    with pytest.raises(ValueError):
        S.scan(spark, [], "trials")


def test_missing_table_and_column(spark, two, tmp_path):
    w = sessions.Writer(str(tmp_path / "few.zarr"))
    w.table("intervals/trials", {"id": np.arange(2), "extra": np.arange(2.0)})
    paths = [*two, w.root]
    df = S.scan(spark, paths, "trials")
    assert df.count() == 14 and df.filter("extra IS NULL").count() == 12 and df.filter("start_time IS NULL").count() == 2
    assert S.scan(spark, paths, "units").count() == 8
    with pytest.raises(S.InternalPathError):
        S.scan(spark, paths, "units", raise_on_missing=True)


def test_majority_type_and_null_for_nan(spark, tmp_path):
    paths = []
    for i, values in enumerate([np.array([42, 7]), np.array([42, 7]), np.array([math.nan, 15.0])]):
        w = sessions.Writer(str(tmp_path / f"t{i}.zarr"))
        w.table("intervals/trials", {"start_time": np.arange(2.0), "brain_region_id": values})
        paths.append(w.root)
    df = S.scan(spark, paths, "trials")
    assert dict(df.dtypes)["brain_region_id"] == "bigint"
    got = [r.brain_region_id for r in df.collect()]
    assert got.count(None) == 1 and {x for x in got if x is not None} == {42, 7, 15}
    assert dict(S.scan(spark, paths, "trials", schema_overrides={"brain_region_id": "string"}).dtypes)["brain_region_id"] == "string"
    assert S.scan(spark, paths, "trials", schema="start_time double").columns == ["start_time"]


def test_limit_opens_few_sessions(spark, two):
    assert S.scan(spark, two, "trials", n_rows=7).count() == 7
    assert S.scan(spark, [two[0], str(two[1]) + "-gone"], "trials", n_rows=5, infer_schema_length=1).count() == 5


def test_metadata_alone_answers(spark, two, monkeypatch):
    from sessionlake.sources import rows

    def no_data(*_):
        raise AssertionError("data are read")

    monkeypatch.setattr(rows, "column", no_data)
    assert sorted(r.n_rows for r in S.row_counts(spark, two, "units").collect()) == [4, 4]
    assert S.scan(spark, two, "units", columns=[]).count() == 8 and S.scan(spark, two, "units", columns=[]).columns == ["_nwb_path", "_table_path", "_table_index"]


def test_many_sessions_are_described_by_tasks(spark, two, monkeypatch):
    monkeypatch.setattr(scan, "MANY", 2)
    assert S.scan(spark, two, "units").count() == 8


def test_read_by_term_and_rows(spark, two):
    assert S.read(spark, two, "trial").count() == 12
    df = S.read(spark, two, "units", include_column_names=["spike_times"], rows={two[0]: [1, 3]})
    assert sorted(len(r.spike_times) for r in df.collect()) == [41, 43]
    assert "spike_times" not in S.read(spark, two, "units").columns
    with pytest.raises(S.InternalPathError):
        S.read(spark, two[0], "zzzzqqqq")


def test_metadata_table_and_general(spark, two):
    general = S.scan(spark, two, "session").orderBy("_nwb_path").collect()
    assert len(general) == 2 and general[0].identifier == "id-0" and general[0].keywords == ["a", "b", "c"] and general[1].session_id == "ses/1"
    assert S.scan(spark, two, "general/subject").count() == 2


def test_rate_series(spark, two):
    series = S.get_timeseries(two[0], "running_speed_with_rate")
    df = series.frame(spark)
    assert [r.timestamps for r in df.orderBy("_table_index").collect()] == [2 + i / 4 for i in range(10)] == series.timestamps.tolist()
    assert df.filter("timestamps > 3").count() == 5 and "starting_time" not in df.columns
    assert (series.rate, series.unit, series.starting_time, series.description) == (4.0, "m/s", 2.0, "speed")
    assert len(S.get_timeseries(two[0], match_all=True)) == 2
    assert S.scan(spark, two[0], "processing/behavior/running_speed_with_timestamps").count() == 12
    with pytest.raises(S.InternalPathError):
        S.get_timeseries(two[0], "nothing")


def brute(units, trials, begin, end):
    out = {}
    for u in units:
        for t in trials:
            out[u["_nwb_path"], u["_table_index"], t["_table_index"]] = [x for x in u["spike_times"] if begin(t) <= x < end(t)]
    return out


def test_events_in_intervals(spark, two):
    units, trials = S.scan(spark, two, "units"), S.scan(spark, two, "trials")
    windows = {"whole": ("start_time", "stop_time"), "before": (F.col("start_time") - 0.5, F.col("start_time")), "reversed": ("stop_time", "start_time")}
    us, ts = units.collect(), trials.collect()
    by = {}
    for p in {u["_nwb_path"] for u in us}:
        own_u, own_t = [u for u in us if u["_nwb_path"] == p], [t for t in ts if t["_nwb_path"] == p]
        by |= {k: [v] for k, v in brute(own_u, own_t, lambda t: t.start_time, lambda t: t.stop_time).items()}
        for k, v in brute(own_u, own_t, lambda t: t.start_time - 0.5, lambda t: t.start_time).items():
            by[k].append(v)
    got = S.events_in_intervals(units, windows, trials, apply_obs_intervals=False, keep_only_necessary_cols=True).collect()
    assert len(got) == 2 * 4 * 6
    for r in got:
        assert [r.whole, r.before] == by[r["_nwb_path"], r["_units_table_index"], r["_intervals_table_index"]] and r.reversed == []
    counts = S.events_in_intervals(units, {"n": ("start_time", "stop_time")}, trials, as_counts=True)
    seen = {(u["_nwb_path"], u["_table_index"]): u.obs_intervals for u in us}
    for r in counts.collect():
        held = any(a <= r.start_time and b >= r.stop_time for a, b in seen[r["_nwb_path"], r["_units_table_index"]])
        assert r.n == (len(by[r["_nwb_path"], r["_units_table_index"], r["_intervals_table_index"]][0]) if held else None)
    assert {"structure", "condition", "id_units", "id_intervals"} <= set(counts.columns)
    aligned = S.events_in_intervals(units, {"a": ("start_time", "stop_time")}, trials, intervals_filter="condition = 'A'", apply_obs_intervals=False, align_times=True, keep_only_necessary_cols=True)
    assert aligned.count() == 8 and all(0 <= t < 1.8 for r in aligned.collect() for t in r.a)
    with pytest.raises(ValueError):
        S.events_in_intervals(units, windows, trials, as_counts=True, align_times=True)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop|EvalPython|MapIn", plan)
    # runs with blocks, and these with units: the result isn't joined again
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", plan.split("Initial Plan")[0])) == 2


def test_binary_search_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (0, 1, 2, 7, 33):
        events = sorted(rng.integers(0, 20, n).astype(float).tolist())
        rows += [(events, float(x)) for x in (-1, 0, 5, 5.5, 19, 20, 21)]
    df = spark.createDataFrame(rows, "events array<double>, at double").withColumn("got", intervals.position(F.col("events"), F.col("at")))
    assert all(r.got == int(np.searchsorted(r.events, r.at)) for r in df.collect())


def test_is_observed(spark):
    units = spark.createDataFrame([("p", 0, [[0.0, 5.0]]), ("p", 1, []), ("p", 2, None), ("q", 0, [[9.0, 10.0]])], "_nwb_path string, _table_index bigint, obs_intervals array<array<double>>")
    rows = [("p", 0, 1.0, 2.0), ("p", 0, 1.0, 2.0), ("p", 0, 4.0, 6.0), ("p", 1, 0.0, 1.0), ("p", 2, 0.0, 1.0), ("q", 0, 1.0, 2.0)]
    given = spark.createDataFrame(rows, "_nwb_path string, _units_table_index bigint, start_time double, stop_time double")
    got = sorted((r["_nwb_path"], r["_units_table_index"], r.start_time, r.is_observed) for r in S.insert_is_observed(given, units).collect())
    assert got == sorted([("p", 0, 1.0, True), ("p", 0, 1.0, True), ("p", 0, 4.0, False), ("p", 1, 0.0, True), ("p", 2, 0.0, True), ("q", 0, 1.0, False)])
    with pytest.raises(S.InternalPathError):
        S.insert_is_observed(given, units.filter("_nwb_path = 'p'"))


def test_array_operators(spark):
    flat = spark.createDataFrame([("a", 1, 2, 9.0), ("a", 1, 1, 8.0), ("a", 2, 1, 7.0), ("b", 1, 1, 6.0)], "k string, i int, o int, v double")
    assert {r.k: r.v for r in S.assemble_ragged(flat, ["k"], "v", ["i", "o"]).collect()} == {"a": [8.0, 9.0, 7.0], "b": [6.0]}
    assert {r.k: r.v for r in S.assemble_ragged_nested(flat, ["k"], ["i"], "v", ["o"]).collect()} == {"a": [[8.0, 9.0], [7.0]], "b": [[6.0]]}
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [2, 2, 6])], "v array<int>, e array<int>")
    row = df.select(arrays.slices(F.col("v"), F.col("e")).alias("s"), S.fixed_shape(F.col("v"), (3, 2)).alias("f"), S.fixed_shape(F.slice("v", 1, 0), (2,)).alias("e")).first()
    assert row.s == [[1, 2], [], [3, 4, 5, 6]] and row.f == [[[1, 2], [3, 4], [5, 6]]] and row.e == []
    pairs = spark.createDataFrame([(1, [[0.0, 1.0], [2.0, 3.0]]), (2, []), (3, None)], "k int, p array<array<double>>")
    assert sorted((r.k, r.a, r.b) for r in arrays.explode_pairs(pairs, "p", "a", "b").collect() if r.a is not None) == [(1, 0.0, 1.0), (1, 2.0, 3.0)]
    assert arrays.explode_pairs(pairs, "p", "a", "b").count() == 4


def test_merge_array_column(spark, two):
    light = S.read(spark, two, "units")
    merged = S.merge_array_column(light, S.scan(spark, two, "units", columns=["spike_times"]), "spike_times")
    assert sorted(len(r.spike_times) for r in merged.collect()) == [40, 40, 41, 41, 42, 42, 43, 43]
    assert S.merge_array_column(light, light, "nothing").filter("nothing IS NULL").count() == 8


def test_diagonal_union(spark):
    a = spark.createDataFrame([(1, "x")], "n bigint, s string")
    b = spark.createDataFrame([(2, 0.5)], "n bigint, d double")
    c = spark.createDataFrame([("y",), ("3",)], "n string")
    assert sorted(map(str, scan.diagonal_union(a, b, c).collect())) == sorted(["Row(n=1, s='x', d=None)", "Row(n=2, s=None, d=0.5)", "Row(n=None, s=None, d=None)", "Row(n=3, s=None, d=None)"])


def test_catalog_and_sql(spark, two):
    paths = S.internal_paths(two[0])
    assert set(paths) == {f"/{p}" for p in ("intervals/trials", "intervals/epochs", "units")} | {f"/processing/behavior/running_speed_with_{k}/{d}" for k, d in (("timestamps", "data"), ("timestamps", "timestamps"), ("rate", "data"))}
    frame = catalog.catalog_frame(spark, two)
    common = {r.path: r.sessions for r in S.common_tables(frame, 2).collect()}
    assert common == {"/intervals/trials": 2, "/intervals/epochs": 2, "/units": 2, "/general": 2, "/general/subject": 2} or "/general/subject" in common
    assert S.common_tables(frame, 3).count() == 0
    views = S.sql_context(spark, two, full_path=True)
    assert "intervals/trials" in views and "general" in views
    assert spark.sql("SELECT condition FROM `intervals/trials` WHERE id = 3").count() == 2
    views = S.sql_context(spark, two, exclude_timeseries=True, table_names=["units", "session"])
    assert set(views) == {"units", "session"}
    assert spark.sql("SELECT count(DISTINCT _nwb_path) AS n FROM units").first().n == 2


def test_metadata(spark, two):
    rows = S.session_metadata(spark, two).orderBy("identifier").collect()
    assert [r.session_id for r in rows] == ["ses/0", "ses/1"] and rows[0].keywords == ["a", "b", "c"] and rows[0].subject_id == "m0" and str(rows[1].session_start_time) == "2024-01-02 10:00:00"
    one = S.Session(two[0], spark)
    assert one.identifier == "id-0" and one.subject.species == "Mus musculus" and one.units.count() == 4 and "obs_intervals" in one.units.columns
    assert one.trials.count() == 6 and one.describe()["age"] == "P90D" and "m0" in one._repr_html_()


def test_attributes(spark, two):
    assert S.get_attrs(two[0], "/intervals/trials") == {"colnames": ["id", "start_time", "stop_time", "condition"], "neurodata_type": "DynamicTable", "description": "trials 0", "same": "x"}
    assert S.get_attrs(two[0], "/") == {"neurodata_type": "NWBFile"} and "object_id" in S.get_attrs(two[0], "/", exclude_private=False)
    with pytest.raises(S.InternalPathError):
        S.get_attrs(two[0], "/nothing")
    below = S.get_sub_attrs(two[0])
    assert "intervals/trials" in below and "units/spike_times_index" not in below and S.get_sub_attrs(two[0], "/nothing") == {}
    got = {r.name: (r.common, r.deviations) for r in S.consolidate_attrs(S.attrs_frame(spark, two, "intervals/trials")).collect()}
    assert got["same"] == ('"x"', {}) and got["description"] == ('"trials 0"', {os.path.realpath(two[1]): '"trials 1"'})


def test_export(spark, two, tmp_path):
    for kind in ("parquet", "csv", ".JSON", "feather", "arrow"):
        out = S.export_tables(spark, two, str(tmp_path / kind.strip(".")), kind, min_file_count=2)
        assert "/units" in out and os.path.exists(out["/units"])
    assert spark.read.parquet(str(tmp_path / "parquet/units.parquet")).count() == 8
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/trials.csv")).count() == 12
    files = [f for f in os.listdir(tmp_path / "feather/units.feather") if f.endswith(".feather")]
    assert sum(pa.ipc.open_file(str(tmp_path / "feather/units.feather" / f)).read_all().num_rows for f in files) == 8
    S.export_tables(spark, two, str(tmp_path / "sub"), session_subdirs=True)
    assert sorted(os.listdir(tmp_path / "sub")) == ["ses_0", "ses_1"] and spark.read.parquet(str(tmp_path / "sub/ses_1/trials.parquet")).count() == 6
    with pytest.raises(ValueError):
        S.export_tables(spark, two, str(tmp_path), "nothing")
    for kind in ("avro", "delta", "excel"):
        with pytest.raises(RuntimeError):
            S.export_tables(spark, two, str(tmp_path / kind), kind, ignore_errors=False)


def test_lake_and_stream(spark, two, tmp_path):
    lake = str(tmp_path / "lake")
    S.ingest(spark, two, "trials", lake)
    df = S.scan_lake(spark, lake, "trials", ["condition", "_table_index", "session"])
    assert df.count() == 12
    one = df.filter(F.col("session") == df.first().session)
    assert one.count() == 6 and "PartitionFilters: [isnotnull(session" in one._jdf.queryExecution().executedPlan().toString()
    q = session_lengths(stream_lake(spark, lake, "trials")).writeStream.outputMode("complete").format("memory").queryName("lengths").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n_rows for r in spark.sql("SELECT * FROM lengths").collect()] == [6, 6]


def test_archive_addresses():
    from sessionlake.sources.archive import Archive

    pages = {
        "a/dandisets/1/": {"most_recent_published_version": {"version": "v2"}},
        "a/dandisets/1/versions/v2/assets/": {"results": [{"asset_id": "x", "path": "b.nwb"}, {"asset_id": "n", "path": "notes.txt"}], "next": "more"},
        "more": {"results": [{"asset_id": "y", "path": "c.nwb"}], "next": None},
        "a/dandisets/1/versions/v2/assets/x/": {"contentUrl": ["https://api/x/s3/download", "https://bucket.s3.amazonaws.com/blobs/x"]},
        "a/dandisets/1/versions/v2/assets/y/": {"contentUrl": ["https://api/y"]},
        "a/dandisets/1/versions/v2/assets/z/": {"contentUrl": ["ftp://s3/z"]},
    }
    a = Archive("a", lambda url, params: pages[url], lambda url: url + "?resolved")
    assert a.urls("1") == ["https://bucket.s3.amazonaws.com/blobs/x?resolved", "https://api/y?resolved"]
    assert len(a.urls("1", most=1)) == 1 and len(a.urls("1", keep=lambda x: x["path"] == "c.nwb")) == 1
    with pytest.raises(ValueError):
        a.asset_url("1", "z")


def test_containers(two, tmp_path):
    clear_cache()
    assert open_container(two[0]) is open_container(two[0])
    with pytest.raises(FileNotFoundError):
        open_container(str(tmp_path / "nothing.zarr"))
    with pytest.raises(OSError):
        (tmp_path / "x.nwb").write_bytes(b"\x89HDF" * 400)
        open_container(str(tmp_path / "x.nwb"))
    assert web_address("s3://b/k/x.zarr") == "https://b.s3.amazonaws.com/k/x.zarr"
    with pytest.raises(S.InternalPathError):
        open_container(two[0])["nothing"]


@pytest.fixture(scope="module")
def hdf(tmp_path_factory):
    where = tmp_path_factory.mktemp("hdf")
    return [sessions.write(str(where / f"s{i}.nwb"), i, writer=hdf5_writer.Writer, flags=np.array([True, False]), fixed=["a", "bé"], numbers=np.arange(5, dtype="<u2")) for i in range(2)]


def test_hdf5_gives_what_zarr_gives(spark, two, hdf):
    for table in ("trials", "epochs", "units", "general", "general/subject", "processing/behavior/running_speed_with_rate", "processing/behavior/running_speed_with_timestamps"):
        a, b = S.scan(spark, two, table), S.scan(spark, hdf, table)
        assert sorted(a.dtypes) == sorted(b.dtypes)
        names = sorted(c for c in a.columns if c != "_nwb_path")
        assert sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))
    assert set(S.internal_paths(hdf[0])) - {"/flags", "/fixed", "/numbers"} == set(S.internal_paths(two[0]))
    assert S.get_attrs(hdf[0], "intervals/trials") == S.get_attrs(two[0], "intervals/trials")
    assert S.get_timeseries(hdf[1], "with_rate").unit == "m/s" and S.Session(hdf[1], spark).identifier == "id-1"
    counts = S.events_in_intervals(S.scan(spark, hdf, "units"), {"n": ("start_time", "stop_time")}, S.scan(spark, hdf, "trials"), as_counts=True)
    assert counts.count() == 48


def test_hdf5_values(hdf):
    root = open_container(hdf[0])
    assert root["flags"].read().tolist() == [True, False] and root["fixed"].read().tolist() == ["a", "bé"]
    assert root["numbers"].dtype == np.dtype("<u2") and root["numbers"].read(1, 3).tolist() == [1, 2]
    assert root["units/waveform_mean"].read(1, 4).tolist() == np.arange(24.0).reshape(4, 3, 2)[1:].tolist()
    assert root["identifier"].scalar() == "id-0" and root.get("units/nothing") is None


def test_sessions_on_the_web(spark, two):
    import functools
    import http.server
    import threading

    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=os.path.dirname(two[0])))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/{os.path.basename(two[0])}"
        df = S.scan(spark, url, "units", columns="spike_times")
        assert df.count() == 4 and df.first()["_nwb_path"] == url
    finally:
        server.shutdown()


def test_codecs():
    import bz2
    import lzma
    import zlib

    import zstandard

    data = np.arange(1000, dtype="<i4").tobytes()
    for name, packed in {"zlib": zlib.compress(data), "bz2": bz2.compress(data), "lzma": lzma.compress(data), "zstd": zstandard.compress(data), "lz4": struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)}.items():
        assert zarr2.CODECS[name](packed) == data
    turned = np.frombuffer(data, np.uint8).reshape(-1, 4).T.reshape(4, -1)
    parts = [zstandard.compress(row.tobytes()) for row in turned]
    body = b"".join(struct.pack("<i", len(p)) + p for p in parts)
    assert zarr2.blosc(struct.pack("<BBBBIIIi", 2, 1, 4 << 5 | 1, 4, len(data), len(data), 20 + len(body), 20) + body) == data
    assert zarr2.blosc(struct.pack("<BBBBIII", 2, 1, 2, 4, 8, 8, 24) + b"12345678") == b"12345678"


def test_votes_and_types():
    assert schema.voted([{"a": "bigint", "b": "x"}, {"a": "double"}, {"a": "double"}]) == {"a": "double", "b": "x"}
    assert [schema.scalar_type(np.dtype(t)) for t in ("u1", "u4", "u8", "f4", "bool", "S3", "O")] == ["smallint", "bigint", "decimal(20,0)", "float", "boolean", "string", "string"]


def test_scalars(spark):
    assert scalars.interpreted(b"['a', 'b']") == ["a", "b"] and scalars.interpreted("2024-01-02T03:04:05").year == 2024 and scalars.interpreted("[__import__('os')]") == "[__import__('os')]"
    row = spark.range(1).select(scalars.as_strings(F.lit("['a','b']")).alias("l"), scalars.as_timestamp(F.lit("x")).alias("t"), scalars.safe_name(F.lit("a/b:c ")).alias("n")).first()
    assert row.l == ["a", "b"] and row.t is None and row.n == "a_b_c" and json.dumps(scalars.plain({"a": np.arange(2), "b": b"\xff"})) == '{"a": [0, 1], "b": "ff"}'


def test_most_common(spark):
    rows = [(0, "p", "k", "1"), (1, "p", "k", "2"), (2, "p", "k", "2"), (0, "p", "t", "b"), (1, "p", "t", "a")]
    df = spark.createDataFrame([(f"s{a}", *r) for r in rows for a in [r[0]]], "session string, at bigint, path string, name string, value string")
    assert {r.name: r.common for r in metadata.most_common(df, ["path", "name"], "value", "at").collect()} == {"k": "2", "t": "b"}
