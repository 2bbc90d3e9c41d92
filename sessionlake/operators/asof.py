"""The last mark at or before each row's time, of the same key.

Time is cut into slots.  The last mark of each slot is aggregated first, and a
running maximum over slots, one row each, tells what a slot begins with; inside
a slot, rows and marks are walked in order of time.  So rows are dealt by key and
slot, and no key meets in one task, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, key: str, time: str, mark: Column, width: int, name: str) -> DataFrame:
    """Adds the greatest ``mark`` of the rows of the same key whose time isn't
    later, where marks grow with time, such as the time itself; ``mark`` is null
    in rows that are none.  ``width`` is a slot's, in the unit of ``time``.

    Rows whose key or time is null get null and are no marks."""
    slot, there = F.floor(F.col(time) / width), F.col(key).isNotNull() & F.col(time).isNotNull()
    rows = rows.withColumn("__slot", slot).withColumn("__mark", F.when(there, mark))
    slots = rows.filter(there).groupBy(key, "__slot").agg(F.max("__mark").alias("__mark"))
    earlier = F.max("__mark").over(Window.partitionBy(key).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select(key, "__slot", earlier.alias("__earlier"))
    inside = F.max("__mark").over(Window.partitionBy(key, "__slot").orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("__inside", inside).join(slots, [key, "__slot"], "left")
    return out.withColumn(name, F.coalesce("__inside", "__earlier")).drop("__slot", "__mark", "__inside", "__earlier")
