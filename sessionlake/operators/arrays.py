"""Ragged and fixed-shape array columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SESSION_PATH, TABLE_INDEX


def assemble_ragged(flat: DataFrame, keys: Iterable[str], value: str, order: Iterable[str], name: str | None = None) -> DataFrame:
    """An array of values for each key, in the given order.  Ties of the order
    are broken by the value, so equal rows give equal arrays."""
    order = list(order)
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    gathered = F.array_sort(F.collect_list(item))
    return flat.groupBy(*keys).agg(F.transform(gathered, lambda x: x["v"]).alias(name or value))


def assemble_ragged_nested(flat: DataFrame, keys: Iterable[str], inner: Iterable[str], value: str, order: Iterable[str], name: str | None = None) -> DataFrame:
    """Two levels: for each key, an array in the order of the inner keys, of arrays of values."""
    keys, inner = list(keys), list(inner)
    rows = assemble_ragged(flat, [*keys, *inner], value, order, "v")
    item = F.struct(*[F.col(c) for c in inner], F.col("v"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name or value))


def slices(values: Column, ends: Column) -> Column:
    """The rows of a ragged column, from all its values and the rows' end offsets."""
    return F.transform(ends, lambda end, i: F.slice(values, F.coalesce(F.get(ends, i - 1), F.lit(0)).cast("int") + 1, (end - F.coalesce(F.get(ends, i - 1), F.lit(0))).cast("int")))


def fixed_shape(values: Column, shape: Iterable[int]) -> Column:
    """A flat array as nested arrays, for the sizes of all dimensions after the first."""

    def parts(flat: Column, size: int) -> Column:
        count = F.floor(F.size(flat) / size).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(0), count), 1, count), lambda i: F.slice(flat, i * size + 1, size))

    for size in reversed(list(shape)):
        values = parts(values, size)
    return values


def merge_array_column(df: DataFrame, arrays: DataFrame, column: str, keys: Iterable[str] = (TABLE_INDEX, SESSION_PATH)) -> DataFrame:
    """Adds an array column by its rows' keys; rows without one get null, and a
    frame that lacks the column altogether adds nulls."""
    keys = list(keys)
    if column in df.columns:
        return df
    if column not in arrays.columns:
        return df.withColumn(column, F.lit(None).cast("array<double>"))
    return df.join(arrays.select(*keys, column), keys, "left")


def explode_pairs(df: DataFrame, column: str, start: str, stop: str) -> DataFrame:
    """A row for each pair in an array of pairs; rows without pairs stay, with nulls."""
    pair = df.withColumn("__pair", F.explode_outer(column))
    return pair.withColumn(start, F.get("__pair", F.lit(0))).withColumn(stop, F.get("__pair", F.lit(1))).drop("__pair", column)
