"""Arrow files as a Spark sink: each task writes one file, which the commit names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "arrowfiles"


@dataclass
class Written(D.WriterCommitMessage):
    temporary: str
    final: str


class Writer(D.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.path, self.overwrite = to_arrow_schema(schema), options["path"], overwrite
        self.ending = options.get("ending", ".arrow")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        temporary = f"{self.path}/_{uuid.uuid4().hex}"
        with pa.ipc.new_file(temporary, self.schema) as out:
            for batch in iterator:
                out.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=self.schema))
        return Written(temporary, f"{self.path}/part-{part:05d}{self.ending}")

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if self.overwrite and os.path.isdir(self.path):
            keep = {m.temporary for m in done}
            for name in os.listdir(self.path):
                if name.endswith(self.ending) and f"{self.path}/{name}" not in keep:
                    os.remove(f"{self.path}/{name}")
        for m in done:
            os.replace(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class ArrowSink(D.DataSource):
    """``df.write.format("arrowfiles").save(path)`` to a folder that the driver
    and all executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return T.StructType()

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)
