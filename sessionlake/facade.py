"""One session as an object."""

from __future__ import annotations

import html
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .constants import TABLE_INDEX
from .operators.arrays import merge_array_column
from .operators.metadata import SESSION_FIELDS, SUBJECT_FIELDS, describe_session, scalar
from .operators.scan import read, scan
from .operators.timeseries import get_timeseries
from .plans.catalog import internal_paths
from .sources.container import open_container, resolved


class Subject:
    def __init__(self, path: str):
        self.path = resolved(path)

    def __getattr__(self, name: str) -> Any:
        if name not in SUBJECT_FIELDS:
            raise AttributeError(name)
        return scalar(self.path, SUBJECT_FIELDS[name])

    def to_dict(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in SUBJECT_FIELDS}


class Session:
    """Fields such as ``identifier``, and tables as lazy frames of the active
    Spark session."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self._spark = resolved(path), spark

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.active()

    def __getattr__(self, name: str) -> Any:
        if name not in SESSION_FIELDS:
            raise AttributeError(name)
        return describe_session(self.path)["keywords"] if name == "keywords" else scalar(self.path, SESSION_FIELDS[name])

    def __getitem__(self, inside: str):
        return open_container(self.path)[inside]

    @property
    def subject(self) -> Subject:
        return Subject(self.path)

    def get_df(self, search_term: str, exact_path: bool = False, **options: Any) -> DataFrame:
        return read(self.spark, self.path, search_term, exact_path, raise_on_missing=True, **options)

    @property
    def trials(self) -> DataFrame:
        return self.get_df("intervals/trials", True)

    @property
    def epochs(self) -> DataFrame:
        return self.get_df("intervals/epochs", True)

    @property
    def electrodes(self) -> DataFrame:
        return self.get_df("electrodes", True)

    @property
    def units(self) -> DataFrame:
        """Without array columns, but for the observation intervals."""
        whole = scan(self.spark, self.path, "units")
        if "obs_intervals" not in whole.columns:
            return self.get_df("units", True)
        arrays = scan(self.spark, self.path, "units", columns=["obs_intervals"])
        return merge_array_column(self.get_df("units", True), arrays, "obs_intervals", [TABLE_INDEX, "_nwb_path"])

    def get_timeseries(self, search_term: str | None = None, **options: Any):
        return get_timeseries(self.path, search_term, **options)

    def describe(self) -> dict[str, Any]:
        return describe_session(self.path) | {"paths": sorted(internal_paths(self.path))}

    def _repr_html_(self) -> str:
        said = self.describe()
        items = lambda names: "".join(f"<li><b>{n}:</b> {html.escape(str(said[n]))}</li>" for n in names)
        paths = "".join(f"<li>{html.escape(p)}</li>" for p in said["paths"])
        return f"<h3>{html.escape(self.path)}</h3><ul>{items(SESSION_FIELDS)}</ul><h4>Subject</h4><ul>{items(SUBJECT_FIELDS)}</ul><details><summary>Paths</summary><ul>{paths}</ul></details>"
