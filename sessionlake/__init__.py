"""Analytics over collections of hierarchical recording sessions, on PySpark.

Functions of this package travel to executors by value, so a cluster needs no
copy of it on the executors' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .constants import SESSION_PATH, TABLE_INDEX, TABLE_PATH, ColumnError, InternalPathError  # noqa: E402
from .facade import Session, Subject  # noqa: E402
from .operators.arrays import assemble_ragged, assemble_ragged_nested, fixed_shape, merge_array_column  # noqa: E402
from .operators.intervals import events_in_intervals, insert_is_observed  # noqa: E402
from .operators.metadata import attrs_frame, consolidate_attrs, get_attrs, get_sub_attrs, session_metadata  # noqa: E402
from .operators.scan import read, row_counts, scan, select_columns, table_length, table_schema  # noqa: E402
from .operators.timeseries import TimeSeries, get_timeseries, rate_timestamps  # noqa: E402
from .plans.catalog import common_tables, internal_paths, sql_context  # noqa: E402
from .session import build_session  # noqa: E402
from .sinks import export_tables  # noqa: E402
from .sources.archive import Archive  # noqa: E402
from .sources.lake import ingest, scan_lake  # noqa: E402
from .sources.remote import set_storage_options  # noqa: E402

__all__ = [
    "SESSION_PATH", "TABLE_INDEX", "TABLE_PATH", "Archive", "ColumnError", "InternalPathError", "Session", "Subject", "TimeSeries",
    "assemble_ragged", "assemble_ragged_nested", "attrs_frame", "build_session", "common_tables", "consolidate_attrs", "events_in_intervals", "export_tables",
    "fixed_shape", "get_attrs", "get_sub_attrs", "get_timeseries", "ingest", "insert_is_observed", "internal_paths", "merge_array_column",
    "rate_timestamps", "read", "row_counts", "scan", "scan_lake", "select_columns", "session_metadata", "set_storage_options", "sql_context", "table_length", "table_schema",
]
