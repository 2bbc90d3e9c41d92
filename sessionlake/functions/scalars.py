"""Interpretation of stored scalars, as column expressions."""

from __future__ import annotations

import datetime
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNSAFE = r'[\\/:*?"<>|]'


def as_timestamp(text: Column) -> Column:
    """The time that an ISO-8601 string says, else null."""
    return F.try_to_timestamp(text)


def as_strings(text: Column) -> Column:
    """The list that a bracketed string says, else the string alone in a list."""
    bracketed = text.startswith("[") & text.endswith("]")
    return F.when(bracketed, F.coalesce(F.from_json(F.regexp_replace(text, "'", '"'), "array<string>"), F.array(text))).when(text.isNotNull(), F.array(text))


def safe_name(text: Column) -> Column:
    """Without the characters that file systems refuse."""
    return F.trim(F.regexp_replace(text, _UNSAFE, "_"))


def safe_file_name(text: str) -> str:
    return re.sub(_UNSAFE, "_", text).strip()


def plain(value: Any) -> Any:
    """A value that JSON can hold."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bytes):
        try:
            return value.decode()
        except UnicodeDecodeError:
            return value.hex()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def interpreted(value: Any) -> Any:
    """A stored scalar as the object that its text says: a time, a list, itself."""
    value = plain(value)
    if isinstance(value, list):
        return value[0] if len(value) == 1 else value
    if not isinstance(value, str):
        return value
    try:
        return datetime.datetime.fromisoformat(value)
    except ValueError:
        pass
    if value.startswith("[") and value.endswith("]"):
        try:
            return json.loads(value.replace("'", '"'))
        except ValueError:
            pass
    return value
