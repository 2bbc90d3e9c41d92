"""Sampled signals as tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import InternalPathError, normalise
from ..sources.container import open_container, resolved
from .scan import scan


def rate_timestamps(index: Column, rate: Column | float, start: Column | float = 0.0) -> Column:
    """The time of each sample of a signal with a constant rate."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return as_column(start) + index / as_column(rate)


@dataclass(frozen=True)
class TimeSeries:
    session: str
    path: str

    @property
    def _group(self):
        return open_container(self.session)[self.path]

    def _attr(self, child: str, name: str) -> Any:
        node = self._group.get(child)
        return None if node is None else node.attrs.get(name)

    def frame(self, spark: SparkSession, **options: Any) -> DataFrame:
        """``data``, ``timestamps`` and provenance, lazily."""
        return scan(spark, self.session, self.path, **options)

    @property
    def data(self):
        return self._group["data"]

    @property
    def timestamps(self):
        import numpy as np

        node = self._group.get("timestamps")
        if node is not None:
            return node.read()
        return self.starting_time + np.arange(self.data.shape[0]) / self.rate

    @property
    def starting_time(self) -> float | None:
        """The time of the first sample, stored as such or among all."""
        node = self._group.get("starting_time")
        if node is not None:
            return float(node.scalar())
        times = self._group.get("timestamps")
        return float(times.read(0, 1)[0]) if times is not None and times.shape[0] else None

    @property
    def rate(self) -> float | None:
        rate = self._attr("starting_time", "rate")
        return None if rate is None else float(rate)

    @property
    def unit(self) -> str | None:
        return self._attr("data", "unit")

    @property
    def conversion(self) -> float | None:
        return self._attr("data", "conversion")

    @property
    def offset(self) -> float | None:
        return self._attr("data", "offset")

    @property
    def resolution(self) -> float | None:
        return self._attr("data", "resolution")

    @property
    def timestamps_unit(self) -> str | None:
        """The series' own word on it, else that of its times."""
        return self._group.attrs.get("timestamps_unit") or self._attr("timestamps", "unit") or self._attr("starting_time", "unit")

    @property
    def description(self) -> str | None:
        return self._group.attrs.get("description")

    @property
    def electrodes(self):
        return self._group.get("electrodes")

    def __getitem__(self, child: str):
        return self._group[child]


def get_timeseries(path: str, search_term: str | None = None, exact_path: bool = False, match_all: bool = False) -> TimeSeries | dict[str, TimeSeries]:
    """The signal at a path, or the first whose path holds the term; with
    ``match_all``, all of them by their path."""
    from ..plans.catalog import internal_paths, is_series

    if not (search_term or match_all):
        raise ValueError("give a search term, or ask for all")
    path = resolved(path)
    root = open_container(path)
    if search_term and exact_path:
        root[search_term]
        return TimeSeries(path, normalise(search_term))
    found = {
        p: TimeSeries(path, p.strip("/")) for p, node in internal_paths(path, parents=True).items() if is_series(p, node) and (not search_term or normalise(search_term) in p)
    }
    if match_all:
        return found
    if not found:
        raise InternalPathError(f"no time series like {search_term!r}")
    return next(iter(found.values()))
