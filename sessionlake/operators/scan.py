"""One lazy frame over a table of many sessions."""

from __future__ import annotations

import difflib
import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PROVENANCE, SESSION_PATH, TABLE_INDEX, TABLE_PATH, ColumnError, InternalPathError, normalise
from ..plans.schema import describe, struct_of, voted
from ..sources import datasource
from ..sources.container import open_container, resolved

Source = str | os.PathLike | Iterable[str | os.PathLike]

#: From so many sessions on, a Spark job reads their metadata.
MANY = 32

Fact = tuple[str, int | None, dict[str, str]]


def as_paths(source: Source) -> list[str]:
    out = [source] if isinstance(source, (str, os.PathLike)) else list(source)
    if not out:
        raise ValueError("no sessions are given")
    return [resolved(os.fspath(p)) for p in out]


def _fact(path: str, table: str, raise_on_missing: bool, ignore_errors: bool) -> Fact | None:
    try:
        found = describe(open_container(path), table)
    except InternalPathError:
        if raise_on_missing:
            raise
        return None
    except Exception:
        if not ignore_errors:
            raise
        return None
    return path, found.length, {c.name: c.type for c in found.columns.values()}


def facts(spark: SparkSession, paths: list[str], table: str, raise_on_missing: bool = False, ignore_errors: bool = False) -> list[Fact]:
    """Path, rows and column types of the table in each session that has it, in
    the order given.  Only names, types and counts come to the driver."""
    if len(paths) < MANY:
        found = [_fact(p, table, raise_on_missing, ignore_errors) for p in paths]
        return [f for f in found if f is not None]

    def run(batches):
        import pandas as pd

        for batch in batches:
            got = [(i, _fact(p, table, raise_on_missing, ignore_errors)) for i, p in zip(batch["at"], batch["path"])]
            rows = [(i, f[0], f[1], f[2]) for i, f in got if f is not None]
            yield pd.DataFrame({"at": [r[0] for r in rows], "path": [r[1] for r in rows], "n": [r[2] for r in rows], "names": [list(r[3]) for r in rows], "types": [list(r[3].values()) for r in rows]})

    given = spark.createDataFrame(list(enumerate(paths)), "at bigint, path string").repartition(min(len(paths), 256))
    rows = given.mapInPandas(run, "at bigint, path string, n bigint, names array<string>, types array<string>").collect()
    return [(r.path, r.n, dict(zip(r.names, r.types))) for r in sorted(rows, key=lambda r: r["at"])]


def table_schema(spark: SparkSession, source: Source, table_path: str, first: int | None = None, exclude_array_columns: bool = False, raise_on_missing: bool = False, ignore_errors: bool = False, provenance: bool = True) -> T.StructType:
    """The sessions' common schema: all columns, each with its most common type."""
    table = normalise(table_path)
    found = facts(spark, as_paths(source)[:first], table, raise_on_missing, ignore_errors)
    if not found:
        raise InternalPathError(f"no session has {table!r}")
    return struct_of(voted([f[2] for f in found]), exclude_array_columns, provenance)


def select_columns(schema: T.StructType, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None, exclude_array_columns: bool = False, many: bool = True) -> T.StructType:
    """The projection that names to include and to exclude leave of a schema.

    Array columns are left out unless they are named; the provenance columns
    stay, unless they are excluded, which many sessions don't allow.
    """
    names = lambda x: [x] if isinstance(x, str) else list(x or [])
    inc, exc = names(include), names(exclude)
    if both := set(inc) & set(exc):
        raise ValueError(f"both included and excluded: {sorted(both)}")
    if many and set(exc) & set(PROVENANCE):
        raise ValueError("provenance columns tell the rows of many sessions apart, and can't be excluded")
    if missing := [n for n in inc if n not in schema.names]:
        raise ColumnError(f"no such columns: {missing}")
    out = T.StructType()
    for f in schema.fields:
        named = f.name in inc
        if f.name in exc or include is not None and not named and f.name not in PROVENANCE:
            continue
        if exclude_array_columns and isinstance(f.dataType, T.ArrayType) and not named:
            continue
        out.add(f)
    return out


def scan(
    spark: SparkSession,
    source: Source,
    table_path: str,
    raise_on_missing: bool = False,
    ignore_errors: bool = False,
    infer_schema_length: int | None = None,
    exclude_array_columns: bool = False,
    low_memory: bool = False,
    schema: T.StructType | str | None = None,
    schema_overrides: Mapping[str, T.DataType | str] | None = None,
    columns: str | Iterable[str] | None = None,
    exclude_columns: str | Iterable[str] | None = None,
    n_rows: int | None = None,
    where: Iterable[datasource.Condition] = (),
) -> DataFrame:
    """A lazy frame of the table's rows in all sessions.

    Columns that a session lacks are null there, and values that don't convert
    to a column's type are null.  ``columns`` and ``where`` are the projection
    and the conditions, such as ``("start_time", ">", 4)``, that reach the reader:
    it reads other columns only for rows that meet all conditions, and opens no
    session that conditions on ``_nwb_path`` exclude.  ``n_rows`` opens no more
    sessions than it takes to have so many rows, unless there are conditions.
    """
    paths, table = as_paths(source), normalise(table_path)
    known = facts(spark, paths[:infer_schema_length], table, raise_on_missing, ignore_errors)
    if schema is None:
        if not known:
            raise InternalPathError(f"no session has {table!r}")
        schema = struct_of(voted([f[2] for f in known]), exclude_array_columns)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    for name, kind in (schema_overrides or {}).items():
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        if name not in schema.names:
            raise ColumnError(name)
        schema = T.StructType([T.StructField(f.name, kind if f.name == name else f.dataType) for f in schema.fields])
    whole, where = schema, list(where)
    schema = select_columns(schema, columns, exclude_columns, exclude_array_columns, len(paths) > 1)
    units = [(p, n) for p, n, _ in known]
    if infer_schema_length is not None:
        units += [(p, None) for p in paths[infer_schema_length:]]
    if n_rows is not None and not where:
        have, few = 0, []
        for p, n in units:
            if have >= n_rows:
                break
            few.append((p, n))
            have += n or 0
        units = few
    out = datasource.load(
        spark, units, table, schema, where, whole, onMissing="raise" if raise_on_missing else "skip", onError="skip" if ignore_errors else "raise", batchRows="200" if low_memory else "2000"
    )
    return out if n_rows is None else out.limit(n_rows)


def find_table(paths: list[str], term: str, exact: bool) -> str:
    """The table that a search term means in the first session that has it."""
    from ..plans.catalog import internal_paths

    term = normalise(term)
    if exact:
        return term
    for path in paths:
        root = open_container(path)
        if term in root:
            return term
        near = difflib.get_close_matches(term, [p.strip("/") for p in internal_paths(path)], n=1, cutoff=0.3)
        if near:
            return near[0]
    raise InternalPathError(f"nothing like {term!r} is in the sessions")


def read(
    spark: SparkSession,
    source: Source,
    search_term: str,
    exact_path: bool = False,
    include_column_names: str | Iterable[str] | None = None,
    exclude_column_names: str | Iterable[str] | None = None,
    rows: Mapping[str, Iterable[int]] | None = None,
    exclude_array_columns: bool = True,
    raise_on_missing: bool = False,
    ignore_errors: bool = False,
    low_memory: bool = False,
) -> DataFrame:
    """As ``scan``, for a table found by a search term and, with ``rows``, only
    the rows with the given indices of each session."""
    paths = as_paths(source)
    table = find_table(paths, search_term, exact_path)
    out = scan(
        spark, paths, table, raise_on_missing, ignore_errors, exclude_array_columns=exclude_array_columns and include_column_names is None,
        low_memory=low_memory, columns=include_column_names, exclude_columns=exclude_column_names,
    )
    if rows is not None:
        pairs = [(resolved(p), int(i)) for p, wanted in rows.items() for i in wanted]
        out = row_subset(out, spark.createDataFrame(pairs, f"{SESSION_PATH} string, {TABLE_INDEX} bigint"))
    return out


def row_subset(df: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = (SESSION_PATH, TABLE_INDEX)) -> DataFrame:
    """The rows whose keys occur in ``wanted``."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def with_provenance(df: DataFrame, session: Column, table: str, order: Iterable[str], ranges: int = 0) -> DataFrame:
    """Adds the provenance columns to rows that have none: the row's index counts
    the session's rows in the given order.

    With ``ranges``, which takes a numeric first column of the order, rows are
    counted in so many ranges of that column, and the ranges' sizes are added up,
    so that a session that holds most rows isn't sorted by one task.
    """
    order = list(order)
    df = df.withColumn(SESSION_PATH, session)
    keys = [SESSION_PATH]
    if ranges > 1:
        splits = df.select(F.percentile_approx(order[0], [i / ranges for i in range(1, ranges)], 10_000).alias("s")).first().s or []
        df = df.withColumn("__range", F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(splits))]), lambda x: x < F.col(order[0]))) if splits else F.lit(0))
        sizes = df.groupBy(SESSION_PATH, "__range").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy(SESSION_PATH).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        df = df.join(sizes.select(SESSION_PATH, "__range", F.coalesce(before, F.lit(0)).alias("__before")), [SESSION_PATH, "__range"])
        keys.append("__range")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    if ranges > 1:
        rank = rank + F.col("__before")
    return df.withColumn(TABLE_PATH, F.lit(table)).withColumn(TABLE_INDEX, rank.cast("bigint")).drop("__range", "__before")


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """All rows under all columns, each column of its most common type; what a
    frame lacks, or what doesn't convert, is null."""
    types = voted([{f.name: f.dataType.simpleString() for f in d.schema.fields} for d in frames])
    out = None
    for d in frames:
        kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
        columns = [
            F.lit(None).cast(t).alias(n) if n not in kinds else F.col(f"`{n}`") if kinds[n] == t else try_cast(F.col(f"`{n}`"), t).alias(n) for n, t in types.items()
        ]
        out = d.select(*columns) if out is None else out.unionByName(d.select(*columns))
    if out is None:
        raise ValueError("no frames are given")
    return out


def try_cast(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def table_length(df: DataFrame) -> DataFrame:
    """``_nwb_path, n_rows`` of a scanned table."""
    return df.groupBy(SESSION_PATH).agg(F.count("*").alias("n_rows"))


def row_counts(spark: SparkSession, source: Source, table_path: str, raise_on_missing: bool = False, ignore_errors: bool = False) -> DataFrame:
    """``_nwb_path, n_rows`` of a table in each session that has it, from metadata alone."""
    found = facts(spark, as_paths(source), normalise(table_path), raise_on_missing, ignore_errors)
    return spark.createDataFrame([(p, n) for p, n, _ in found], f"{SESSION_PATH} string, n_rows bigint")


def late_join(light: DataFrame, heavy: DataFrame, keys: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """Heavy columns for the rows that are left of the light ones."""
    extra = [c for c in heavy.columns if c in keys or c not in light.columns]
    return light.join(heavy.select(*extra), list(keys), "inner")
