"""Facts about a table in one session, and the one schema of all sessions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

from ..constants import PROVENANCE, InternalPathError, normalise
from ..sources.container import Array, Group

#: Scalars of a session that are stored outside ``general`` but belong to it.
SESSION_SCALARS = ("session_start_time", "session_description", "identifier", "timestamps_reference_time", "file_create_date")

#: A column of references to samples of time series, which can't be a value.
REFERENCES = {"timeseries": "TimeSeriesReferenceVectorData"}

_NUMBERS = {
    "b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint",
    "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "decimal(20,0)", "f2": "float", "f4": "float", "f8": "double",
}


@dataclass(frozen=True)
class Column:
    """``type`` is in Spark's notation; ``indexes`` from the outermost inwards."""

    name: str
    type: str
    path: str
    shape: tuple[int, ...] = ()
    indexes: tuple[str, ...] = ()
    rate: float | None = None
    start: float = 0.0

    @property
    def is_array(self) -> bool:
        return self.type.startswith("array")


@dataclass
class Table:
    path: str
    length: int
    is_metadata: bool
    is_series: bool
    columns: dict[str, Column] = field(default_factory=dict)


def scalar_type(dtype: np.dtype) -> str:
    dtype = np.dtype(dtype)
    return _NUMBERS.get(f"{dtype.kind}{dtype.itemsize}", "string")


def _wrapped(kind: str, levels: int) -> str:
    return "array<" * levels + kind + ">" * levels


def members(root: Group, path: str) -> dict[str, Group | Array]:
    """What a table's columns are read from."""
    table = root[path]
    if not table.is_group:
        raise InternalPathError(f"{path!r} is no table")
    found = {name: table.get(name) for name in table.keys()}
    if path == "general":
        extra = {name: root.get(name) for name in SESSION_SCALARS}
        if (more := root.get("general/metadata")) is not None and more.is_group:
            extra = {name: more.get(name) for name in more.keys()} | {k: v for k, v in extra.items() if v is not None}
        found |= {name: node for name, node in extra.items() if node is not None}
        found = {name: node for name, node in found.items() if not node.is_group}
    for name, kind in REFERENCES.items():
        if name in found and found[name].attrs.get("neurodata_type") == kind:
            found = {k: v for k, v in found.items() if k not in (name, f"{name}_index")}
    return found


def describe(root: Group, path: str) -> Table:
    """Columns with their types and the number of rows, from metadata alone."""
    path = normalise(path)
    found = members(root, path)
    arrays = {name: node for name, node in found.items() if not node.is_group}
    is_series = "data" in arrays and ("timestamps" in found or "starting_time" in found)
    with_rate = is_series and "timestamps" not in found
    is_metadata = path == "general" or all(a.ndim <= 1 for a in arrays.values()) and any(a.ndim == 0 for a in arrays.values()) and not with_rate
    samples = arrays["data"].shape[0] if is_series and arrays["data"].shape else None
    out = Table(path, 1, is_metadata, is_series)
    lengths: list[tuple[int, int]] = []
    for name, node in arrays.items():
        if is_metadata:
            out.columns[name] = Column(name, _wrapped(scalar_type(node.dtype), node.ndim), node.name, node.shape)
            continue
        base = name.removesuffix("_index")
        if base != name and base in arrays:
            continue
        if with_rate and name == "starting_time":
            rate = float(node.attrs.get("rate", 1.0))
            out.columns["timestamps"] = Column("timestamps", "double", node.name, (samples,), rate=rate, start=float(node.scalar()))
            continue
        if samples is not None and node.shape and node.shape[0] != samples:
            continue
        indexes: list[str] = []
        while (index := name + "_index" * (len(indexes) + 1)) in arrays:
            indexes.append(index)
        shape = node.shape
        levels = len(indexes) + max(0, node.ndim - 1)
        out.columns[name] = Column(name, _wrapped(scalar_type(node.dtype), levels), node.name, shape, tuple(arrays[i].name for i in reversed(indexes)))
        rows = arrays[indexes[-1]].shape[0] if indexes else shape[0] if shape else 1
        lengths.append((0 if name == "id" else 1 if shape else 2, rows))
    if not is_metadata:
        out.length = samples if samples is not None else min(lengths)[1] if lengths else 0
    return out


def voted(tables: Iterable[Mapping[str, str]]) -> dict[str, str]:
    """Each column's most common type; of equally common ones, the first."""
    votes: dict[str, Counter] = {}
    for columns in tables:
        for name, kind in columns.items():
            votes.setdefault(name, Counter())[kind] += 1
    return {name: count.most_common(1)[0][0] for name, count in votes.items()}


def struct_of(types: Mapping[str, str], exclude_arrays: bool = False, provenance: bool = True) -> T.StructType:
    out = T.StructType()
    for name, kind in types.items():
        if not (exclude_arrays and kind.startswith("array")):
            out.add(name, T._parse_datatype_string(kind))
    if provenance:
        for name, kind in zip(PROVENANCE, (T.StringType(), T.StringType(), T.LongType())):
            out.add(name, kind)
    return out
