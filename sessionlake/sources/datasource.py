"""Spark's reader of containers: rows of one table out of many sessions.

Spark can't tell a Python source which columns a query needs, so the schema
that is given is the projection: only its columns are read.  Spark can push
filters, but keeps them with the frame and so applies them to every later query
on it; conditions are therefore given to the scan.  They are evaluated on the
columns they name, and all other columns are read for the rows that stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..constants import PROVENANCE, SESSION_PATH, TABLE_INDEX, TABLE_PATH, ColumnError, InternalPathError
from ..plans.schema import Table, describe
from . import rows
from .container import open_container, resolved

NAME = "sessions"

_COMPARE = {"=": pc.equal, "<>": pc.not_equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}

#: ``(column, comparison, value)``; comparisons are those above and ``in``,
#: ``is null`` and ``is not null``, whose value is ignored.
Condition = tuple[str, str, Any]


class Slice(D.InputPartition):
    """Rows of one session; ``stop`` is None where the length isn't known yet."""

    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


class Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.filters = schema, [tuple(x) for x in json.loads(options.get("where", "[]"))]
        # columns that conditions name needn't be in the projection
        self.kinds = to_arrow_schema(T.StructType.fromJson(json.loads(options["kinds"]))) if "kinds" in options else to_arrow_schema(schema)
        self.table = options["table"]
        self.units = json.loads(options["units"])
        self.rows_per_slice = int(options.get("rowsperslice", 200_000))
        self.batch_rows = int(options.get("batchrows", 2_000))
        self.on_missing, self.on_error = options.get("onmissing", "skip"), options.get("onerror", "raise")

    def _wants(self, path: str) -> bool:
        """Whether conditions on the session's path leave it any row."""
        for name, how, value in self.filters:
            if name == SESSION_PATH and (how == "=" and value != path or how == "in" and path not in value):
                return False
        return True

    def partitions(self) -> list[D.InputPartition]:
        out: list[D.InputPartition] = []
        for path, length in self.units:
            if not self._wants(path):
                continue
            if length is None:
                out.append(Slice(path, 0, None))
            else:
                out += [Slice(path, i, min(length, i + self.rows_per_slice)) for i in range(0, length, self.rows_per_slice)]
        return out or [Slice("", 0, 0)]

    def _value(self, root, table: Table, name: str, kind: pa.DataType, path: str, start: int, stop: int) -> pa.Array:
        n = stop - start
        if name == SESSION_PATH:
            return pa.array([path] * n, pa.string())
        if name == TABLE_PATH:
            return pa.array([table.path] * n, pa.string())
        if name == TABLE_INDEX:
            return rows.cast(pa.array(np.arange(start, stop)), kind)
        if name not in table.columns:
            return pa.nulls(n, kind)
        return rows.cast(rows.column(root, table, table.columns[name], start, stop), kind)

    def _kept(self, how: str, value: Any, values: pa.Array) -> pa.Array:
        if how in ("is null", "is not null"):
            return pc.is_null(values) if how == "is null" else pc.is_valid(values)
        if how == "in":
            return pc.is_in(values, pa.array([v for v in value if v is not None], values.type))
        hit = _COMPARE[how](values, pa.scalar(value, values.type))
        if pa.types.is_floating(values.type) and how in (">", ">="):
            hit = pc.or_(hit, pc.is_nan(values))  # in Spark's order, NaN is the largest
        return pc.fill_null(hit, False)

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part.stop == part.start:
            return
        try:
            root = open_container(part.path)
            table = describe(root, self.table)
        except InternalPathError:
            if self.on_missing == "raise":
                raise
            return
        except Exception:
            if self.on_error == "raise":
                raise
            return
        schema = to_arrow_schema(self.schema)
        stop = table.length if part.stop is None else part.stop
        first = sorted({name for name, _, _ in self.filters})
        for i in range(part.start, stop, self.batch_rows):
            j = min(stop, i + self.batch_rows)
            try:
                yield from self._batch(root, table, schema, first, part.path, i, j)
            except Exception:
                if self.on_error == "raise":
                    raise
                return

    def _batch(self, root, table: Table, schema: pa.Schema, first: list[str], path: str, i: int, j: int) -> Iterator[pa.RecordBatch]:
        have = {name: self._value(root, table, name, self.kinds.field(name).type, path, i, j) for name in first}
        kept = pa.array(np.ones(j - i, bool))
        for name, how, value in self.filters:
            kept = pc.and_(kept, self._kept(how, value, have[name]))
        at = np.flatnonzero(kept.to_numpy(zero_copy_only=False))
        if not len(at):
            return
        a, b = int(at[0]), int(at[-1]) + 1  # heavy columns are read from the first to the last row that stays
        take = pa.array(at - a)
        arrays = [
            have[c.name].take(pa.array(at)) if c.name in have else self._value(root, table, c.name, c.type, path, i + a, i + b).take(take) for c in schema
        ]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class SessionSource(D.DataSource):
    """``spark.read.format("sessions")`` with a schema, and the options ``table``
    and ``units``: a JSON list of pairs of path and number of rows or null."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        from ..plans.schema import struct_of, voted

        found = [describe(open_container(path), self.options["table"]) for path, _ in json.loads(self.options["units"])]
        return struct_of(voted([{c.name: c.type for c in t.columns.values()} for t in found]))

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return Reader(schema, {k.lower(): v for k, v in self.options.items()})


def load(spark: SparkSession, units: list[tuple[str, int | None]], table: str, schema: T.StructType, where: Iterable[Condition] = (), whole: T.StructType | None = None, **options: str):
    """``schema`` is the projection; ``whole`` has the types of the conditions' columns too."""
    kinds = {f.name: f.dataType for f in (whole or schema).fields}
    where = list(where)
    for name, how, _ in where:
        if how not in _COMPARE and how not in ("in", "is null", "is not null"):
            raise ValueError(f"no comparison {how!r}")
        if name not in kinds:
            raise ColumnError(name)
        if isinstance(kinds[name], (T.ArrayType, T.MapType)):
            raise ValueError(f"{name} is an array; filter the frame instead")
    spark.dataSource.register(SessionSource)
    pairs = json.dumps([[resolved(p), n] for p, n in units])
    return spark.read.format(NAME).schema(schema).options(table=table, units=pairs, where=json.dumps(where), kinds=(whole or schema).json(), **options).load()


__all__ = ["NAME", "PROVENANCE", "SessionSource", "load"]
