"""Tables as Zarr containers of format version 2, for fixtures and round trips."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np

from .remote import put


class ZarrWriter:
    """Collects groups and arrays below a folder; ``close`` writes the
    consolidated metadata."""

    def __init__(self, root: str, **attrs: Any):
        self.root, self.meta = root, {}
        self.group("", **attrs)

    def _store(self, key: str, data: bytes) -> None:
        put(f"{self.root}/{key}", data)

    def _document(self, key: str, what: dict) -> None:
        self.meta[key] = what
        self._store(key, json.dumps(what).encode())

    def group(self, path: str, **attrs: Any) -> None:
        parts = path.split("/") if path else []
        for i in range(len(parts) + 1):
            key = "/".join([*parts[:i], ".zgroup"])
            if key not in self.meta:
                self._document(key, {"zarr_format": 2})
        if attrs:
            self._document(f"{path}/.zattrs".lstrip("/"), attrs)

    def array(self, path: str, values: Any, rows_per_chunk: int = 65_536, **attrs: Any) -> None:
        self.group(path.rpartition("/")[0])
        if attrs:
            self._document(f"{path}/.zattrs", attrs)
        text = isinstance(values, str) or isinstance(values, Sequence) and bool(len(values)) and isinstance(values[0], str)
        data = np.asarray(values, object if text else None)
        chunk = (min(rows_per_chunk, max(1, data.shape[0])), *data.shape[1:]) if data.shape else ()
        self._document(f"{path}/.zarray", {
            "zarr_format": 2, "shape": list(data.shape), "chunks": list(chunk), "dtype": "|O" if text else data.dtype.str, "order": "C",
            "fill_value": "" if text else 0, "compressor": {"id": "zlib", "level": 1}, "filters": [{"id": "vlen-utf8"}] if text else None,
        })
        for i in range(0, data.shape[0] if data.shape else 1, chunk[0] if chunk else 1):
            part = data[i : i + chunk[0]] if chunk else data.reshape(1)
            if chunk and len(part) < chunk[0]:
                part = np.concatenate([part, np.full((chunk[0] - len(part), *chunk[1:]), "" if text else 0, data.dtype)])
            items = [x.encode() for x in part.reshape(-1)] if text else []
            raw = struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(x)) + x for x in items) if text else part.tobytes()
            self._store(f"{path}/{'.'.join(map(str, [i // chunk[0], *[0] * (data.ndim - 1)])) if chunk else '0'}", zlib.compress(raw, 1))

    def table(self, path: str, columns: Mapping[str, Any], **attrs: Any) -> None:
        """Columns of numbers or strings; a list of arrays is stored as a ragged one."""
        self.group(path, colnames=list(columns), neurodata_type="DynamicTable", **attrs)
        for name, values in columns.items():
            if len(values) and isinstance(values[0], (list, np.ndarray)):
                self.array(f"{path}/{name}_index", np.cumsum([len(v) for v in values]))
                values = np.concatenate([np.asarray(v) for v in values])
            self.array(f"{path}/{name}", values)

    def close(self) -> None:
        self._store(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": self.meta}).encode())
