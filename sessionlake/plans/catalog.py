"""What sessions hold: paths, tables that many sessions share, and SQL views."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import InternalPathError, normalise
from ..sources.container import Array, Group, open_container, resolved

#: Kinds of nodes that only group others.
CONTAINERS = ("NWBFile", "ProcessingModule")

#: A group whose path holds one of these is a table.
TABLE_MARKS = ("/intervals/", "/units", "/electrodes", "/trials", "/epochs")

CATALOG = "session string, path string, is_group boolean, is_table boolean, is_series boolean, attrs map<string,string>"


def internal_paths(path: str, include_arrays: bool = True, include_table_columns: bool = False, include_metadata: bool = False, include_specifications: bool = False, parents: bool = False) -> dict[str, Group | Array]:
    """Nodes of a session by path.  Columns of tables, the metadata below
    ``/general``, and the format's specifications are left out unless asked for;
    so are scalars, and, without ``parents``, nodes that have others below."""
    out: dict[str, Group | Array] = {}
    work: list[Group | Array] = [open_container(path)]
    root = work[0]
    while work:
        node = work.pop()
        name = "/" if node is root else node.name
        if "/specifications" in name and not include_specifications:
            continue
        if not node.is_group and node.shape == ():
            continue
        kind = node.attrs.get("neurodata_type")
        if name.startswith("/general") and not include_metadata:
            continue
        wanted = name.startswith("/general") or "/specifications" in name or kind is not None and kind not in CONTAINERS or kind is None and not node.is_group and include_arrays
        if wanted and name != "/":
            out[name] = node
        if node.is_group and ("colnames" not in node.attrs or include_table_columns):
            below = [node.get(k) for k in node.keys()]
            work += [n for n in reversed(below) if n is not None]
    if not parents:
        lead = {p.rsplit("/", i)[0] for p in out for i in range(1, p.count("/") + 1)}
        out = {p: n for p, n in out.items() if p not in lead}
    return out


def is_table(path: str, node: Group | Array) -> bool:
    return node.is_group and any(m in path for m in TABLE_MARKS) or "colnames" in node.attrs


def is_series(path: str, node: Group | Array) -> bool:
    if path.endswith(("/data", "/timestamps")) or not node.is_group or is_table(path, node):
        return False
    start = node.get("starting_time")
    timed = "timestamps" in node or start is not None and "rate" in start.attrs
    return timed or "series" in str(node.attrs.get("neurodata_type", "")).lower() and "data" in node


def catalog_frame(spark: SparkSession, source: Any, ignore_errors: bool = False) -> DataFrame:
    """A row for each path of each session; sessions are read by tasks."""
    from ..functions.scalars import plain
    from ..operators.scan import as_paths

    paths = as_paths(source)

    def run(batches):
        import json

        for batch in batches:
            rows = []
            for session in batch["session"]:
                try:
                    nodes = internal_paths(session, include_metadata=True, parents=True)
                except Exception:
                    if not ignore_errors:
                        raise
                    continue
                for path, node in nodes.items():
                    attrs = {k: json.dumps(plain(v)) for k, v in node.attrs.items()}
                    rows.append((session, path, node.is_group, is_table(path, node), is_series(path, node), attrs))
            yield pd.DataFrame(rows, columns=["session", "path", "is_group", "is_table", "is_series", "attrs"])

    given = spark.createDataFrame([(p,) for p in paths], "session string").repartition(min(len(paths), 256))
    return given.mapInPandas(run, CATALOG)


def common_tables(catalog: DataFrame, min_file_count: int = 1, include_series: bool = False, include_metadata: bool = True) -> DataFrame:
    """``path, sessions`` of the tables that at least so many sessions have."""
    wanted = F.col("is_table")
    if include_series:
        wanted = wanted | F.col("is_series")
    if include_metadata:
        wanted = wanted | F.col("path").isin("/general", "/general/subject")
    return catalog.filter(wanted).groupBy("path").agg(F.countDistinct("session").alias("sessions")).filter(F.col("sessions") >= min_file_count)


def view_name(path: str, full_path: bool) -> str:
    path = path.strip("/")
    if full_path:
        return path
    name = path.rsplit("/", 1)[-1]
    return "session" if path == "general" else name


def sql_context(spark: SparkSession, source: Any, full_path: bool = False, min_file_count: int = 1, exclude_timeseries: bool = False, exclude_array_columns: bool = False, table_names: Iterable[str] | None = None, infer_schema_length: int | None = None, ignore_errors: bool = True) -> dict[str, DataFrame]:
    """Registers a temporary view for each common table, named by the last part
    of its path or, with ``full_path``, all of it; then ``spark.sql`` knows them.

    ``table_names`` are view names or paths.  Two tables of one name are an
    error, as one view can't be both.
    """
    from ..operators.scan import as_paths, scan

    paths = as_paths(source)
    found = [r.path for r in common_tables(catalog_frame(spark, paths, ignore_errors), min_file_count, not exclude_timeseries).select("path").collect()]
    wanted = None if table_names is None else {t.strip("/") for t in table_names} | {normalise(t) for t in table_names}
    out: dict[str, DataFrame] = {}
    taken: dict[str, str] = {}
    for path in sorted(found):
        name = view_name(path, full_path)
        if wanted is not None and not {name, path.strip("/")} & wanted:
            continue
        if name in taken:
            raise ValueError(f"{path} and {taken[name]} are both named {name!r}; use full paths")
        taken[name] = path
        try:
            out[name] = scan(spark, paths, path, ignore_errors=ignore_errors, exclude_array_columns=exclude_array_columns, infer_schema_length=infer_schema_length)
        except InternalPathError:
            continue
    for name, df in out.items():
        register(spark, name, df)
    return out


def register(spark: SparkSession, name: str, df: DataFrame) -> None:
    """A temporary view whose name may hold slashes."""
    df.createOrReplaceTempView(f"`{name}`")


def session_name(path: str) -> str:
    """A session's identifier by its own word, else the stem of its file."""
    import os

    from ..functions.scalars import interpreted, safe_file_name

    root = open_container(path)
    for inside in ("general/session_id", "identifier"):
        node = root.get(inside)
        value = None if node is None or node.is_group else interpreted(node.scalar())
        if isinstance(value, str) and value.strip():
            return safe_file_name(value)
    return os.path.splitext(os.path.basename(resolved(path).rstrip("/")))[0]
