"""Queries over containers that are written from ``events``, in both formats.

A recording has a quarter of the users' events: units with their ragged event
times, trials, a signal with a rate, one with timestamps, a broken one, and what
a recording and its subject say of themselves.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import facade, sinks
from .constants import SESSION_PATH, TABLE_INDEX, UNIT_INDEX
from .functions import scalars
from .operators import intervals, metadata, scan, timeseries
from .plans.catalog import catalog_frame
from .queries import _CUSTOMERS, _EVENTS, _NUMBERED, _PAIRS, _TRIALS, _UNITS, _written, container_root, events, query
from .session import scratch_dir
from .sources.container import open_container

ENDINGS = {"zarr": ".nwb.zarr", "hdf5": ".nwb", "odd": ".zarr.h5"}
SPEED, LICKS, BROKEN = (f"processing/behavior/{x}" for x in ("speed", "licks", "broken"))

_made: dict[tuple[str, str, str], list[str]] = {}


def recordings(spark: SparkSession, sf_dir: str, kind: str = "zarr") -> list[str]:
    """Paths of the recordings, each written by the task that has it; they are
    written once for an application."""
    known = (spark.sparkContext.applicationId, sf_dir, kind)
    if known in _made:
        return _made[known]
    root, hour = container_root(spark), 3_600_000_000

    def write(key, e):
        import numpy as np
        import pandas as pd

        from .sources.hdf5_writer import Writer
        from .sources.zarr2_writer import ZarrWriter

        e = e.sort_values("event_id")
        name = key[0].removesuffix(".nwb")
        w = (ZarrWriter if kind == "zarr" else Writer)(f"{root}/{name}{ENDINGS[kind]}")
        w.group("", neurodata_type="NWBFile", namespace="core", object_id=f"o-{name}")
        w.array("identifier", f"id-{name}")
        w.array("session_description", f"recording {name}")
        w.array("session_start_time", f"2024-01-0{int(name[-1]) + 1}T10:00:00+00:00")
        w.array("general/session_id", f"ses/{name}")
        w.array("general/institution", "somewhere")
        w.array("general/keywords", ["a", "b", "c"])
        w.group("general/subject", neurodata_type="Subject")
        for field, value in {"subject_id": f"m-{name}", "species": "Mus musculus", "age": "P90D"}.items():
            w.array(f"general/subject/{field}", value)
        times = {u: np.sort(t.to_numpy()) for u, t in e.groupby("user_id")["us"]}
        w.table("units", {"id": np.array(list(times)), "name": [f"user {u}" for u in times], "spike_times": list(times.values())}, description="all users")
        t = e[e.event_type == "signup"]
        w.table(
            "intervals/trials", {"id": t.event_id.to_numpy(), "start_time": t.us.to_numpy(), "stop_time": t.us.to_numpy() + hour, "value": t.value.to_numpy()},
            description="trials of " + name, same="x",
        )
        w.group("processing", neurodata_type="NWBFile")
        w.group("processing/behavior", neurodata_type="ProcessingModule")
        values = e.value.to_numpy()
        w.group(SPEED, neurodata_type="TimeSeries", description="speed")
        w.array(f"{SPEED}/data", values, unit="m/s", conversion=0.5)
        w.array(f"{SPEED}/starting_time", np.array(2.0), rate=8.0, unit="seconds")
        w.group(LICKS, neurodata_type="TimeSeries", timestamps_unit="microseconds")
        w.array(f"{LICKS}/data", values, unit="n")
        w.array(f"{LICKS}/timestamps", e.us.to_numpy() / 8, unit="seconds")
        w.array(f"{LICKS}/control", np.arange(len(values) - 1), unit="n")
        w.group(BROKEN, neurodata_type="TimeSeries")
        w.array(f"{BROKEN}/data", values[:5], unit="n")
        w.array(f"{BROKEN}/timestamps", np.arange(3.0), unit="seconds")
        w.close()
        return pd.DataFrame({"path": [w.root]})

    rows = events(spark, sf_dir).select(SESSION_PATH, "event_id", "user_id", "event_type", "value", "us")
    _made[known] = sorted(r.path for r in rows.groupBy(SESSION_PATH).applyInPandas(write, "path string").collect())
    return _made[known]


def recording(path=SESSION_PATH):
    return F.regexp_extract(path, r"([^/.]+)\.[^/]*$", 1).alias("session")


def name_of(path: str) -> str:
    return posixpath.basename(path).split(".")[0]


_S = "replace(s, '.nwb', '') AS session"
_ALL = f"(SELECT DISTINCT s FROM {_EVENTS})"
_IDS = f"SELECT {_S}, user_id AS id, 'user ' || user_id AS name, row_number() OVER (PARTITION BY s ORDER BY user_id) - 1 AS _table_index FROM {_UNITS}"
_RAGGED = f"SELECT {_S}, user_id AS id, len(times)::INT AS n, times[1] AS first, times[-1] AS last FROM {_UNITS}"


@query(_IDS)
def hdf5_scan(spark, d):
    return scan.scan(spark, recordings(spark, d, "hdf5"), "units", columns=["id", "name"]).select(recording(), "id", "name", TABLE_INDEX)


@query(_RAGGED)
def hdf5_ragged(spark, d):
    df = scan.scan(spark, recordings(spark, d, "hdf5"), "/units", columns=["id", "spike_times"])
    return df.select(recording(), "id", F.size("spike_times").alias("n"), F.get("spike_times", F.lit(0)).alias("first"), F.element_at("spike_times", -1).alias("last"))


@query(f"SELECT {_S}, user_id, event_id, n FROM ({_PAIRS})")
def hdf5_events_in_intervals(spark, d):
    paths = recordings(spark, d, "hdf5")
    us, ts = scan.scan(spark, paths, "units", columns=["id", "spike_times"]), scan.scan(spark, paths, "trials").withColumnRenamed("id", "event_id")
    found = intervals.events_in_intervals(us.withColumn("session", recording()), {"n": ("start_time", "stop_time")}, ts, as_counts=True)
    return found.select("session", F.col("id").alias("user_id"), "event_id", "n")


@query(_IDS)
def open_by_other_format(spark, d):
    """Files whose names look like the other format."""
    return scan.scan(spark, recordings(spark, d, "odd"), "units", columns=["id", "name"]).select(recording(), "id", "name", TABLE_INDEX)


@query(_RAGGED)
def low_memory_scan(spark, d):
    df = scan.scan(spark, recordings(spark, d), "units", low_memory=True, columns=["id", "spike_times"])
    return df.select(recording(), "id", F.size("spike_times").alias("n"), F.get("spike_times", F.lit(0)).alias("first"), F.element_at("spike_times", -1).alias("last"))


@query(f"SELECT session, id, name FROM ({_IDS}) WHERE _table_index IN (0, 2, 5)")
def read_rows_by_search(spark, d):
    paths = recordings(spark, d)
    found = scan.read(spark, paths, "unitz", include_column_names=["id", "name"], rows={p: [0, 2, 5] for p in paths})
    return found.select(recording(), "id", "name")


@query(f"SELECT {_S}, event_id AS id, start_time, value FROM {_TRIALS}")
def read_exact_path(spark, d):
    found = scan.read(spark, recordings(spark, d, "hdf5"), "/intervals/trials", exact_path=True, exclude_column_names=["stop_time"])
    return found.select(recording(), "id", "start_time", "value")


@query(f"SELECT least(count(*), 40) AS n FROM {_TRIALS}")
def scan_n_rows(spark, d):
    return scan.scan(spark, recordings(spark, d), "trials", n_rows=40).agg(F.count("*").alias("n"))


@query(f"SELECT {_S}, 'trials' AS name, count(*) AS n_rows FROM {_TRIALS} GROUP BY s UNION ALL SELECT {_S}, 'units', count(DISTINCT user_id) FROM {_EVENTS} GROUP BY s")
def row_counts_of_metadata(spark, d):
    paths = recordings(spark, d, "hdf5")
    found = [scan.row_counts(spark, paths, t).select(recording(), F.lit(t).alias("name"), "n_rows") for t in ("trials", "units")]
    return found[0].union(found[1])


@query("SELECT * FROM (VALUES ('id', 'bigint'), ('name', 'string'), ('spike_times', 'array<bigint>'), ('_nwb_path', 'string'), ('_table_path', 'string'), ('_table_index', 'bigint')) v(name, type)")
def schema_inspection(spark, d):
    found = scan.table_schema(spark, recordings(spark, d), "units")
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found.fields], "name string, type string")


@query(f"SELECT session, id AS user_id, _table_index AS row FROM ({_IDS})")
def rename_and_drop(spark, d):
    return scan.scan(spark, recordings(spark, d), "units", exclude_array_columns=True).drop("name", "_table_path").withColumnsRenamed({"id": "user_id", TABLE_INDEX: "row"}).select(recording(), "user_id", "row")


@query(f"SELECT count(*) AS n, count(*) AS together, true AS some FROM {_TRIALS}")
def sample_and_rest(spark, d):
    """Two random parts are disjoint and have all rows."""
    df = scan.scan(spark, recordings(spark, d), "trials", columns=["id"])
    a, b = df.randomSplit([0.5, 0.5], seed=11)
    both = a.union(b)
    return df.agg(F.count("*").alias("n")).crossJoin(both.agg(F.countDistinct("id").alias("together"), (F.count("*") > 0).alias("some")))


@query(f"SELECT {_S}, user_id AS id, len(times)::INT AS n FROM {_UNITS} WHERE user_id % 3 = 0")
def late_join_of_arrays(spark, d):
    paths = recordings(spark, d)
    light = scan.scan(spark, paths, "units", exclude_array_columns=True).filter("id % 3 = 0")
    return scan.late_join(light, scan.scan(spark, paths, "units", columns=["spike_times"])).select(recording(), "id", F.size("spike_times").alias("n"))


@query(f"SELECT {_S}, user_id, event_id, n FROM ({_PAIRS}) JOIN (SELECT event_id, value FROM events WHERE value > 30) USING (event_id)")
def filtered_intervals(spark, d):
    paths = recordings(spark, d)
    us, ts = scan.scan(spark, paths, "units", columns=["id", "spike_times"]), scan.scan(spark, paths, "trials").withColumnRenamed("id", "event_id")
    found = intervals.events_in_intervals(us.withColumn("session", recording()), {"n": ("start_time", "stop_time")}, ts, intervals_filter="value > 30", as_counts=True)
    return found.select("session", F.col("id").alias("user_id"), "event_id", "n")


@query(f"SELECT {_S}, i AS _table_index, value AS data, 2.0 + i / 8.0 AS timestamps FROM {_NUMBERED}")
def series_with_rate(spark, d):
    return scan.scan(spark, recordings(spark, d), SPEED).select(recording(), TABLE_INDEX, "data", "timestamps")


@query(f"SELECT {_S}, value AS data, us / 8.0 AS timestamps FROM {_EVENTS} WHERE value > 60")
def series_with_timestamps(spark, d):
    df = scan.scan(spark, recordings(spark, d, "hdf5"), LICKS, columns=["data", "timestamps"], where=[("data", ">", 60.0)])
    return df.select(recording(), "data", "timestamps")


@query(f"SELECT {_S}, value AS data, 2.0 + i / 8.0 AS timestamps FROM {_NUMBERED} WHERE 2.0 + i / 8.0 BETWEEN (SELECT 2.0 + max(i) / 32.0 FROM {_NUMBERED}) AND (SELECT 2.0 + max(i) * 3 / 32.0 FROM {_NUMBERED})")
def series_window(spark, d):
    """The middle half of the longest recording."""
    df = timeseries_frames(spark, recordings(spark, d))
    last = df.agg(F.max("timestamps")).first()[0]
    low, high = 2.0 + (last - 2.0) / 4, 2.0 + (last - 2.0) * 3 / 4
    return df.filter(F.col("timestamps").between(low, high)).select(recording(), "data", "timestamps")


def timeseries_frames(spark, paths: list[str]) -> DataFrame:
    return scan.diagonal_union(*[timeseries.get_timeseries(p, "speed").frame(spark) for p in paths])


@query("SELECT * FROM (VALUES ('data', 'double'), ('timestamps', 'double')) v(name, type)")
def series_drops_other_lengths(spark, d):
    """The column of another length isn't one of the table's."""
    found = scan.table_schema(spark, recordings(spark, d, "hdf5"), LICKS, provenance=False)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found.fields], "name string, type string")


@query(f"""SELECT {_S}, '/processing/behavior/speed' AS path, 8.0 AS rate, 2.0 AS start, 'm/s' AS unit, 'seconds' AS timestamps_unit, 0.5 AS conversion, count(*) AS samples FROM {_EVENTS} GROUP BY s
UNION ALL SELECT {_S}, '/processing/behavior/licks', NULL, first(us ORDER BY event_id) / 8.0, 'n', 'microseconds', NULL, count(*) FROM {_EVENTS} GROUP BY s
UNION ALL SELECT {_S}, '/processing/behavior/broken', NULL, 0.0, 'n', 'seconds', NULL, 5 FROM {_ALL}""")
def series_attributes(spark, d):
    rows = [
        (name_of(p), path, x.rate, x.starting_time, x.unit, x.timestamps_unit, x.conversion, x.data.shape[0])
        for p in recordings(spark, d, "hdf5") for path, x in timeseries.get_timeseries(p, match_all=True).items()
    ]
    return spark.createDataFrame(rows, "session string, path string, rate double, start double, unit string, timestamps_unit string, conversion double, samples bigint")


_PATHS = "(VALUES ('/units', true, false), ('/intervals/trials', true, false), ('/processing/behavior/speed', false, true), ('/processing/behavior/licks', false, true), ('/processing/behavior/broken', false, true)) v(path, is_table, is_series)"


@query(f"SELECT {_S}, path, is_table, is_series FROM {_ALL}, {_PATHS}")
def catalog_of_groups(spark, d):
    found = catalog_frame(spark, recordings(spark, d, "hdf5")).filter("is_group AND (is_table OR is_series) AND path NOT LIKE '/general%'")
    return found.select(recording("session"), "path", "is_table", "is_series")


_META = f"SELECT {_S}, 'id-' || replace(s, '.nwb', '') AS identifier, 'ses/' || replace(s, '.nwb', '') AS session_id, 'somewhere' AS institution, 'recording ' || replace(s, '.nwb', '') AS session_description, NULL::VARCHAR AS lab, 3 AS n_keywords, '2024-01-0' || (s[9]::INT + 1) AS day, 'm-' || replace(s, '.nwb', '') AS subject_id, 'Mus musculus' AS species FROM {_ALL}"


def _metadata(spark, d, kind):
    found = metadata.session_metadata(spark, recordings(spark, d, kind))
    return found.select(
        recording(), "identifier", "session_id", "institution", "session_description", "lab", F.size("keywords").alias("n_keywords"),
        F.date_format("session_start_time", "yyyy-MM-dd").alias("day"), "subject_id", "species",
    )


@query(_META)
def metadata_frame(spark, d):
    return _metadata(spark, d, "zarr")


@query(_META)
def hdf5_metadata_frame(spark, d):
    return _metadata(spark, d, "hdf5")


@query(f"SELECT session, identifier, species, 8 AS n_paths FROM ({_META})")
def describe_sessions(spark, d):
    rows = []
    for p in recordings(spark, d):
        said = facade.Session(p, spark).describe()
        rows.append((name_of(p), said["identifier"], said["species"], len(said["paths"])))
    return spark.createDataFrame(rows, "session string, identifier string, species string, n_paths int")


@query(f"""SELECT {_S}, name, CASE WHEN name = 'description' THEN '"trials of ' || replace(s, '.nwb', '') || '"' ELSE value END AS value
FROM {_ALL}, (VALUES ('colnames', '["id", "start_time", "stop_time", "value"]'), ('neurodata_type', '"DynamicTable"'), ('description', ''), ('same', '"x"')) v(name, value)""")
def attributes_of_table(spark, d):
    return metadata.attrs_frame(spark, recordings(spark, d, "hdf5"), "trials").select(recording("session"), "name", "value")


@query(f"""SELECT {_S}, path, name, value FROM {_ALL}, (VALUES
('processing', 'neurodata_type', '"NWBFile"'), ('processing/behavior', 'neurodata_type', '"ProcessingModule"'),
('processing/behavior/speed', 'neurodata_type', '"TimeSeries"'), ('processing/behavior/speed', 'description', '"speed"'), ('processing/behavior/speed/data', 'unit', '"m/s"'),
('processing/behavior/speed/data', 'conversion', '0.5'), ('processing/behavior/speed/starting_time', 'rate', '8.0'), ('processing/behavior/speed/starting_time', 'unit', '"seconds"'),
('processing/behavior/licks', 'neurodata_type', '"TimeSeries"'), ('processing/behavior/licks', 'timestamps_unit', '"microseconds"'), ('processing/behavior/licks/data', 'unit', '"n"'),
('processing/behavior/licks/timestamps', 'unit', '"seconds"'), ('processing/behavior/licks/control', 'unit', '"n"'), ('processing/behavior/broken', 'neurodata_type', '"TimeSeries"'),
('processing/behavior/broken/data', 'unit', '"n"'), ('processing/behavior/broken/timestamps', 'unit', '"seconds"')) v(path, name, value)""")
def attributes_below(spark, d):
    found = metadata.attrs_frame(spark, recordings(spark, d), "processing", below=True, exclude_empty=True)
    return found.select(recording("session"), "path", "name", "value")


@query("""SELECT 'intervals/trials' AS path, name, common, deviating FROM (VALUES ('same', '"x"', 0), ('description', '"trials of session_0"', 3), ('neurodata_type', '"DynamicTable"', 0),
('colnames', '["id", "start_time", "stop_time", "value"]', 0)) v(name, common, deviating)""")
def consolidated_attributes(spark, d):
    found = metadata.consolidate_attrs(metadata.attrs_frame(spark, recordings(spark, d), "trials"))
    return found.select("path", "name", "common", F.size("deviations").alias("deviating"))


@query(f"SELECT {_S}, true AS same, 0 AS more_reads FROM {_ALL}")
def opened_once(spark, d):
    """An open container is kept, and consolidated metadata is read once for all of it."""
    rows = []
    for p in recordings(spark, d):
        root = open_container(p)
        root.store, kept = Counting(root.store), root.store
        for inside in ("units", "intervals/trials", SPEED):
            root[inside].keys()
        rows.append((name_of(p), open_container(p) is root, root.store.reads))
        root.store = kept
    return spark.createDataFrame(rows, "session string, same boolean, more_reads int")


class Counting:
    """A store that counts what is read of it."""

    def __init__(self, store):
        self.store, self.reads = store, 0

    def get(self, key):
        self.reads += 1
        return self.store.get(key)

    def children(self, key):
        self.reads += 1
        return self.store.children(key)


_TEXTS = [("[1, 2]", "list", "[1, 2]"), ("['a', 'b']", "list", '["a", "b"]'), ("[broken", "str", '"[broken"'), ("2024-01-02T03:04:05+00:00", "datetime", '"2024-01-02 03:04:05+00:00"'), ("plain", "str", '"plain"'), ("", "str", '""')]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in _TEXTS) + ") v(text, kind, json)")
def scalars_interpreted(spark, d):
    import json

    rows = [(t, type(x).__name__, json.dumps(scalars.plain(x))) for t, x in ((t, scalars.interpreted(t)) for t, _, _ in _TEXTS)]
    return spark.createDataFrame(rows, "text string, kind string, json string")


@query("""SELECT * FROM (VALUES ('array', '[1, 2]'), ('bytes', '"ab"'), ('raw bytes', '"ff00"'), ('number', '2.5'), ('nested', '{"a": [1, "x"]}'), ('none', 'null'), ('other', '"(1+2j)"')) v(what, json)""")
def json_of_values(spark, d):
    import json

    import numpy as np

    given = {"array": np.array([1, 2]), "bytes": b"ab", "raw bytes": b"\xff\x00", "number": np.float64(2.5), "nested": {"a": (np.int8(1), b"x")}, "none": None, "other": 1 + 2j}
    return spark.createDataFrame([(k, json.dumps(scalars.plain(v))) for k, v in given.items()], "what string, json string")


@query(f"SELECT {_S}, event_id AS id, value, 'ses_' || replace(s, '.nwb', '') AS folder FROM {_TRIALS}")
def export_by_session(spark, d):
    """Tables in a folder of each session, read back with the folder's name."""
    out = scratch_dir(spark, "by-session")
    sinks.export_tables(spark, recordings(spark, d), out, "parquet", session_subdirs=True)
    found = spark.read.parquet(f"{out}/*/trials.parquet").withColumn("folder", F.regexp_extract(F.input_file_name(), r"/(ses_[^/]+)/trials\.parquet/", 1))
    return found.select(recording(), "id", "value", "folder")


@query("SELECT * FROM (VALUES ('/intervals/trials'), ('/units')) v(path)")
def export_skips_empty(spark, d):
    """What was written: tables that have rows, by path; ``general`` isn't a table here."""
    out = sinks.export_tables(spark, recordings(spark, d, "hdf5"), scratch_dir(spark, "all"), ".JSON", min_file_count=2, full_path=True)
    return spark.createDataFrame([(p,) for p in sorted(out) if not p.startswith("/general")], "path string")


def _arrow_files(spark, d, kind):
    df, path = _written(spark, d, kind)
    names = df.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield from pa.ipc.open_file(content).read_all().select(names).to_batches()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(path).select("content")
    return files.mapInArrow(run, df.schema)


@query(_CUSTOMERS)
def export_arrow_roundtrip(spark, d):
    return _arrow_files(spark, d, "arrow")


@query(_CUSTOMERS)
def export_feather_roundtrip(spark, d):
    return _arrow_files(spark, d, "feather")


_NAMES = [("/intervals/trials", ".csv", True, "intervals_trials.csv"), ("/intervals/trials", ".csv", False, "trials.csv"), ("/a b/c d", ".json", True, "a_b_c_d.json"), ("units", "", True, "units")]


@query("SELECT * FROM (VALUES " + ", ".join(str(row).replace("True", "true").replace("False", "false") for row in _NAMES) + ") v(path, ending, whole, name)")
def export_names(spark, d):
    return spark.createDataFrame([(p, e, w, sinks.output_name(p, e, w)) for p, e, w, _ in _NAMES], "path string, ending string, whole boolean, name string")


_ERRORS = [
    ("no such table", "InternalPathError"), ("no such column", "ColumnError"), ("no such format", "ValueError"), ("both included and excluded", "ValueError"),
    ("no sessions", "ValueError"), ("no such file", "FileNotFoundError"), ("counts and times", "ValueError"), ("array as a table", "InternalPathError"), ("unit of nobody", "InternalPathError"),
]


@query("SELECT * FROM (VALUES " + ", ".join(str(x) for x in _ERRORS) + ") v(what, error)")
def errors_by_case(spark, d):
    paths = recordings(spark, d)
    us, ts = scan.scan(spark, paths, "units"), scan.scan(spark, paths, "trials")
    cases = {
        "no such table": lambda: scan.scan(spark, paths, "nothing"),
        "no such column": lambda: scan.scan(spark, paths, "units", columns=["nothing"]),
        "no such format": lambda: sinks.format_of("stone"),
        "both included and excluded": lambda: scan.scan(spark, paths, "units", columns=["id"], exclude_columns=["id"]),
        "no sessions": lambda: scan.scan(spark, [], "units"),
        "no such file": lambda: open_container(paths[0] + ".gone"),
        "counts and times": lambda: intervals.events_in_intervals(us, {"n": ("start_time", "stop_time")}, ts, as_counts=True, align_times=True),
        "array as a table": lambda: scan.scan(spark, paths, "units/id", raise_on_missing=True),
        "unit of nobody": lambda: intervals.insert_is_observed(ts.withColumn(UNIT_INDEX, F.lit(10**9).cast("bigint")), us.withColumn("obs_intervals", F.array().cast("array<array<double>>"))),
    }
    rows = []
    for what, call in cases.items():
        try:
            call()
            rows.append((what, "none"))
        except Exception as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")
