"""Metadata and attributes of sessions, and what sessions have in common."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import SESSION_PATH, InternalPathError, normalise
from ..functions.scalars import interpreted, plain
from ..sources.container import open_container, resolved
from .scan import as_paths

#: What a session and its subject say of themselves.
SESSION_FIELDS = {
    "identifier": "identifier", "session_start_time": "session_start_time", "session_id": "general/session_id", "session_description": "session_description",
    "experiment_description": "general/experiment_description", "experimenter": "general/experimenter", "lab": "general/lab", "institution": "general/institution",
    "related_publications": "general/related_publications", "keywords": "general/keywords", "notes": "general/notes", "data_collection": "general/data_collection",
    "surgery": "general/surgery", "pharmacology": "general/pharmacology", "virus": "general/virus", "source_script": "general/source_script",
    "source_script_file_name": "general/source_script_file_name",
}
SUBJECT_FIELDS = {
    name: f"general/subject/{name}"
    for name in ("age", "age__reference", "description", "genotype", "sex", "species", "subject_id", "weight", "strain", "date_of_birth")
}

#: Attributes that only the file format needs.
PRIVATE = ("id", "object_id", "namespace", "target")
EMPTY = (None, {}, [], "", "no description")

METADATA = (
    ", ".join(f"{n} {'timestamp' if n in ('session_start_time', 'date_of_birth') else 'array<string>' if n == 'keywords' else 'string'}" for n in (*SESSION_FIELDS, *SUBJECT_FIELDS))
    + f", {SESSION_PATH} string"
)


def scalar(path: str, inside: str) -> Any:
    node = open_container(path).get(inside)
    return None if node is None or node.is_group else interpreted(node.scalar())


def describe_session(path: str) -> dict[str, Any]:
    """Fields of the session and its subject, each None where it isn't said."""
    path = resolved(path)
    out = {name: scalar(path, inside) for name, inside in (SESSION_FIELDS | SUBJECT_FIELDS).items()}
    words = out["keywords"]
    out["keywords"] = [] if words is None else [words] if isinstance(words, str) else list(words)
    return out | {SESSION_PATH: path}


def session_metadata(spark: SparkSession, source: Any) -> DataFrame:
    """A row for each session; sessions are read by tasks."""
    paths = as_paths(source)

    def text(name: str, value: Any) -> Any:
        if name == "keywords":
            return [str(v) for v in value]
        if name in ("session_start_time", "date_of_birth"):
            return value if hasattr(value, "year") else None
        return value if value is None or isinstance(value, str) else ", ".join(map(str, value)) if isinstance(value, list) else str(value)

    def run(batches):
        for batch in batches:
            rows = [{k: text(k, v) for k, v in describe_session(p).items()} for p in batch["path"]]
            frame = pd.DataFrame(rows, columns=[*SESSION_FIELDS, *SUBJECT_FIELDS, SESSION_PATH], dtype=object)
            for name in ("session_start_time", "date_of_birth"):
                frame[name] = pd.to_datetime(frame[name], utc=True).dt.tz_localize(None)
            yield frame

    given = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 256))
    return given.mapInPandas(run, METADATA)


def filtered_attrs(attrs: dict[str, Any], exclude_private: bool = True, exclude_empty: bool = False) -> dict[str, Any]:
    out = {k: plain(v) for k, v in attrs.items()}
    if exclude_private:
        out = {k: v for k, v in out.items() if not k.startswith(("_", ".")) and k not in PRIVATE}
    if exclude_empty:
        out = {k: v for k, v in out.items() if v not in EMPTY}
    return out


def get_attrs(path: str, internal_path: str, exclude_private: bool = True, exclude_empty_fields: bool = False) -> dict[str, Any]:
    """Attributes of one node; a path that isn't there is an error."""
    return filtered_attrs(open_container(path)[internal_path].attrs, exclude_private, exclude_empty_fields)


def get_sub_attrs(path: str, parent_path: str = "/", exclude_private: bool = True, exclude_empty: bool = True) -> dict[str, dict[str, Any]]:
    """Attributes of all nodes from a path down, by path without leading slash.
    Left out are specifications, the indexes of ragged columns, and plain
    columns that only say that they are one."""
    root = open_container(path)
    top = root if normalise(parent_path) == "/" else root.get(normalise(parent_path))
    out: dict[str, dict[str, Any]] = {}
    work = [] if top is None else [top]
    while work:
        node = work.pop()
        name = "/" if node is root else node.name.strip("/")
        if name.startswith("specifications"):
            continue
        base = name.removesuffix("_index")
        if base != name and root.get(base) is not None:
            continue
        attrs = filtered_attrs(node.attrs, exclude_private, exclude_empty)
        if exclude_empty and str(attrs.get("neurodata_type", "")).startswith("VectorData"):
            attrs.pop("neurodata_type")
        if attrs or not exclude_empty:
            out[name] = attrs
        if node.is_group:
            work += [n for n in (node.get(k) for k in reversed(node.keys())) if n is not None]
    return out


ATTRS = "session string, at bigint, path string, name string, value string"


def attrs_frame(spark: SparkSession, source: Any, internal_path: str = "/", below: bool = False, exclude_private: bool = True, exclude_empty: bool = False) -> DataFrame:
    """``session, at, path, name, value``: a row for each attribute, whose value
    is JSON; ``at`` is the session's place in the source.  With ``below``, of
    all nodes from the path down.  Sessions without the path have no rows."""
    paths = as_paths(source)
    wanted = normalise(internal_path)

    def run(batches):
        for batch in batches:
            rows = []
            for at, session in zip(batch["at"], batch["session"]):
                if below:
                    found = get_sub_attrs(session, wanted, exclude_private, exclude_empty)
                else:
                    try:
                        found = {wanted: get_attrs(session, wanted, exclude_private, exclude_empty)}
                    except InternalPathError:
                        found = {}
                rows += [(session, at, path, k, json.dumps(v, sort_keys=True)) for path, attrs in found.items() for k, v in attrs.items()]
            yield pd.DataFrame(rows, columns=["session", "at", "path", "name", "value"])

    given = spark.createDataFrame(list(enumerate(paths)), "at bigint, session string").repartition(min(len(paths), 256))
    return given.mapInPandas(run, ATTRS)


def most_common(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``keys, common``: each key's most frequent value; of equally frequent
    ones, that which comes first.  Values are counted before any window."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first", value))
    return counts.withColumn("rank", rank).filter("rank = 1").select(*keys, F.col(value).alias("common"))


def consolidate_attrs(attrs: DataFrame) -> DataFrame:
    """``path, name, common, deviations``: each attribute's most frequent value,
    and a map from the sessions that say otherwise to what they say.  Sessions
    that lack the attribute aren't in it."""
    keys = ["path", "name"]
    common = most_common(attrs, keys, "value", "at")
    other = attrs.join(common, keys).filter("value <> common").groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("session", "value")))).alias("deviations"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return common.join(other, keys, "left").withColumn("deviations", F.coalesce("deviations", none))


def with_subject(sessions: DataFrame, subjects: DataFrame, key: str = SESSION_PATH) -> DataFrame:
    """Sessions with the fields of their subject."""
    return sessions.join(subjects, key, "left")
