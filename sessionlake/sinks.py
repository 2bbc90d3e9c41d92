"""Export of the sessions' common tables to files of other formats."""

from __future__ import annotations

import logging
import os
import urllib.parse
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import SESSION_PATH, InternalPathError
from .functions.scalars import safe_file_name
from .operators.scan import as_paths, scan, table_schema
from .plans.catalog import catalog_frame, common_tables, session_name
from .sources.arrow_sink import NAME as ARROW
from .sources.arrow_sink import ArrowSink

log = logging.getLogger(__name__)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for formats that have none."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _arrow(ending: str) -> Callable[..., None]:
    def write(df: DataFrame, path: str, **options: Any) -> None:
        df.sparkSession.dataSource.register(ArrowSink)
        df.write.format(ARROW).mode("overwrite").options(path=path, ending=ending, **options).save()

    return write


def _spark(name: str, flat: bool = False, **fixed: Any) -> Callable[..., None]:
    def write(df: DataFrame, path: str, by: str | None = None, **options: Any) -> None:
        try:
            writer = (flattened(df) if flat else df).write.format(name).mode("overwrite").options(**(fixed | options))
            (writer.partitionBy(by) if by else writer).save(path)
        except Exception as e:
            if "DATA_SOURCE_NOT_FOUND" in str(e) or "AVRO_NOT_LOADED" in str(e) or "Failed to find" in str(e):
                raise RuntimeError(f"the format {name!r} needs its package on Spark's class path") from e
            raise

    return write


def _excel(df: DataFrame, path: str, **options: Any) -> None:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("the format 'excel' needs the openpyxl library") from e
    most = 1_048_575  # rows of a sheet
    rows = flattened(df).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a sheet holds {most} rows at most")
    rows.to_excel(path, index=False, **options)


#: Writers by format, and the ending of the files.
FORMATS: dict[str, tuple[Callable[..., None], str]] = {
    "parquet": (_spark("parquet"), ".parquet"),
    "csv": (_spark("csv", flat=True, header=True), ".csv"),
    "json": (_spark("json"), ".json"),
    "excel": (_excel, ".xlsx"),
    "feather": (_arrow(".feather"), ".feather"),
    "arrow": (_arrow(".arrow"), ".arrow"),
    "avro": (_spark("avro"), ".avro"),
    "delta": (_spark("delta"), ""),
}


def format_of(name: str) -> str:
    plain = name.lower().strip().lstrip(".")
    if plain not in FORMATS:
        raise ValueError(f"no format {name!r}; there are {', '.join(FORMATS)}")
    return plain


def output_name(path: str, ending: str, full_path: bool = True) -> str:
    path = path if full_path else path.rsplit("/", 1)[-1]
    return path.strip("/").replace("/", "_").replace(" ", "_").strip() + ending


def write_table(df: DataFrame, path: str, output_format: str = "parquet", **options: Any) -> None:
    FORMATS[format_of(output_format)][0](df, path, **options)


#: Formats whose writer deals rows to folders, so that one job writes all sessions.
DEALT = ("parquet", "csv", "json", "avro")
FOLDER = "__folder"


def write_by_session(df: DataFrame, folders: dict[str, str], output_dir: str, name: str, kind: str, **options: Any) -> bool:
    """Writes each session's rows as ``name`` in its folder; whether there were any.

    One job writes all of them below a folder that is only theirs; what it wrote
    is renamed once it has ended, so a lost task leaves nothing half written.
    """
    spark = df.sparkSession
    jvm, base = spark._jvm, output_dir if "://" in output_dir else f"file://{os.path.abspath(output_dir)}"
    place = f"{base}/_writing-{uuid.uuid4().hex}"
    given = spark.createDataFrame(list(folders.items()), f"{SESSION_PATH} string, {FOLDER} string")
    named = df.join(given.withColumnRenamed(SESSION_PATH, "__session"), F.col(SESSION_PATH) == F.col("__session")).drop("__session")
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    store = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        FORMATS[kind][0](named, place, by=FOLDER, **options)
        found = [x.getPath().getName() for x in store.listStatus(path(place))]
        found = [x for x in found if x.startswith(f"{FOLDER}=")]
        for x in found:
            folder = urllib.parse.unquote(x.removeprefix(f"{FOLDER}="))
            store.mkdirs(path(base, folder))
            store.delete(path(base, folder, name), True)
            if not store.rename(path(place, x), path(base, folder, name)):
                raise OSError(f"{folder}/{name} can't be put into its place")
        return bool(found)
    finally:
        store.delete(path(place), True)


def export_tables(
    spark: SparkSession,
    source: Any,
    output_dir: str,
    output_format: str = "parquet",
    full_path: bool = False,
    min_file_count: int = 1,
    exclude_array_columns: bool = False,
    ignore_errors: bool = True,
    session_subdirs: bool = False,
    **write_options: Any,
) -> dict[str, str]:
    """Writes each table that at least so many sessions have, and returns where
    by path.  Empty tables are skipped.  With ``session_subdirs`` each session
    has a folder of its own, named by its identifier; all share one schema, and
    sessions of one identifier share a folder."""
    kind = format_of(output_format)
    paths = as_paths(source)
    found = sorted(r.path for r in common_tables(catalog_frame(spark, paths, ignore_errors), min_file_count).select("path").collect())
    ending, out, taken = FORMATS[kind][1], {}, {}
    for path in found:
        name = output_name(path, ending, full_path)
        if taken.setdefault(name, path) != path:
            raise ValueError(f"{path} and {taken[name]} would both be {name}; use full paths")
    os.makedirs(output_dir, exist_ok=True) if "://" not in output_dir else None
    folders = {p: safe_file_name(session_name(p)) for p in paths} if session_subdirs else {}
    for path in found:
        name = output_name(path, ending, full_path)
        try:
            if session_subdirs:
                schema = table_schema(spark, paths, path, exclude_array_columns=exclude_array_columns, ignore_errors=ignore_errors)
                if kind in DEALT:
                    df = scan(spark, paths, path, schema=schema, ignore_errors=ignore_errors)
                    done = write_by_session(df, folders, output_dir, name, kind, **write_options)
                else:
                    done = False
                    for p in paths:
                        df = scan(spark, p, path, schema=schema, ignore_errors=ignore_errors)
                        if not df.isEmpty():
                            write_table(df, f"{output_dir}/{folders[p]}/{name}", kind, **write_options)
                            done = True
            else:
                df = scan(spark, paths, path, exclude_array_columns=exclude_array_columns, ignore_errors=ignore_errors)
                if done := not df.isEmpty():
                    write_table(df, f"{output_dir}/{name}", kind, **write_options)
        except (InternalPathError, OSError, NotImplementedError) as e:
            if not ignore_errors:
                raise
            log.warning("%s isn't exported: %s", path, e)
            continue
        if done:
            out[path] = output_dir if session_subdirs else f"{output_dir}/{name}"
    return out
