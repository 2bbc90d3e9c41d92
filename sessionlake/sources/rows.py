"""Rows of a table in one container, as Arrow arrays of the wanted types."""

from __future__ import annotations

import decimal
import math

import numpy as np
import pyarrow as pa

from ..plans.schema import Column, Table
from .container import Group


def _leaf(values: np.ndarray) -> pa.Array:
    values = values.reshape(-1)
    if values.dtype.kind in "OSU":
        return pa.array([v.decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else str(v) for v in values.tolist()], pa.string())
    return pa.array(np.ascontiguousarray(values).astype(values.dtype.newbyteorder("=")))


def nested(values: np.ndarray) -> pa.Array:
    """A list level for each dimension after the first."""
    out = _leaf(values)
    for i in range(values.ndim - 1, 0, -1):
        rows = int(np.prod(values.shape[:i]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * values.shape[i]), out)
    return out


def _ragged(root: Group, data: str, indexes: tuple[str, ...], start: int, stop: int) -> pa.Array:
    """Rows that the outermost index deals out of the next one, or of the data."""
    if not indexes:
        return nested(root[data].read(start, stop))
    index = root[indexes[0]]
    ends = index.read(max(0, start - 1), stop).astype(np.int64)
    if start == 0:
        ends = np.concatenate([[0], ends])
    if len(ends) < 2:
        return pa.ListArray.from_arrays(pa.array([0], pa.int32()), _ragged(root, data, indexes[1:], 0, 0))
    inner = _ragged(root, data, indexes[1:], int(ends[0]), int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), inner)


def _number(x, kind: pa.DataType):
    """A value of the type, or None where it has none."""
    try:
        if pa.types.is_boolean(kind):
            return x if isinstance(x, bool) else {"true": True, "false": False}.get(x.lower()) if isinstance(x, str) else bool(x)
        if pa.types.is_decimal(kind):
            return decimal.Decimal(int(x))
        if pa.types.is_floating(kind):
            return float(x)
        if isinstance(x, float) and not math.isfinite(x):
            return None
        n = int(x)
        return n if -(1 << (kind.bit_width - 1)) <= n < 1 << (kind.bit_width - 1) else None
    except (ValueError, TypeError, ArithmeticError):
        return None


def cast(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """The values in another type; what doesn't convert becomes null."""
    if values.type == kind:
        return values
    if pa.types.is_list(kind):
        if not pa.types.is_list(values.type):
            return pa.nulls(len(values), kind)
        return pa.ListArray.from_arrays(values.offsets, cast(values.values, kind.value_type), mask=values.is_null() if values.null_count else None)
    if pa.types.is_list(values.type):
        return pa.array([None if v is None else str(v) for v in values.to_pylist()], kind) if pa.types.is_string(kind) else pa.nulls(len(values), kind)
    try:
        return values.cast(kind)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass
    if pa.types.is_string(kind):
        return pa.array([None if v is None else str(v) for v in values.to_pylist()], kind)
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) or pa.types.is_decimal(kind):
        return pa.array([None if v is None else _number(v, kind) for v in values.to_pylist()], kind)
    out = []
    for v in values.to_pylist():
        try:
            out.append(pa.array([v]).cast(kind)[0].as_py())
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            out.append(None)
    return pa.array(out, kind)


def column(root: Group, table: Table, c: Column, start: int, stop: int) -> pa.Array:
    if c.rate is not None:
        return pa.array(c.start + np.arange(start, stop) / c.rate)
    node = root[c.path]
    if table.is_metadata:
        values = node.scalar() if not c.shape else node.read()
        if not c.shape:
            return _leaf(np.array([values], node.dtype if node.dtype.kind not in "OSU" else object))[: stop - start]
        whole = nested(values)
        return pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)[: stop - start]
    if not c.shape and not c.indexes:
        return _leaf(np.array([node.scalar()] * (stop - start), node.dtype if node.dtype.kind not in "OSU" else object))
    return _ragged(root, c.path, c.indexes, start, stop)
