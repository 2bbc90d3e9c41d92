"""Small sessions, written as Zarr of format version 2."""

import gzip
import json
import os
import struct

import numpy as np

TYPES = {"f8": "<f8", "i8": "<i8"}


class Writer:
    def __init__(self, root):
        self.root, self.meta = root, {}
        self.group("")

    def put(self, key, data):
        path = os.path.join(self.root, key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)

    def document(self, key, what):
        self.meta[key] = what
        self.put(key, json.dumps(what).encode())

    def group(self, path, **attrs):
        parts = path.split("/") if path else []
        for i in range(len(parts) + 1):
            above = "/".join(parts[:i])
            if f"{above}/.zgroup".lstrip("/") not in self.meta:
                self.document(f"{above}/.zgroup".lstrip("/"), {"zarr_format": 2})
        if attrs:
            self.document(f"{path}/.zattrs".lstrip("/"), attrs)

    def array(self, path, values, chunk=None, compressor="gzip", **attrs):
        self.group(path.rpartition("/")[0])
        text = isinstance(values, str) or isinstance(values, list) and values and isinstance(values[0], str)
        values = np.array(values, object if text else None)
        chunks = tuple(max(1, n) for n in values.shape) if chunk is None else (chunk, *values.shape[1:])
        packed = {"gzip": gzip.compress, None: bytes}[compressor]
        self.document(
            f"{path}/.zarray",
            {
                "zarr_format": 2, "shape": list(values.shape), "chunks": list(chunks), "dtype": "|O" if text else values.dtype.str, "order": "C", "fill_value": "" if text else 0,
                "compressor": {"id": compressor, "level": 1} if compressor else None, "filters": [{"id": "vlen-utf8"}] if text else None,
            },
        )
        if attrs:
            self.document(f"{path}/.zattrs", attrs)
        if not values.shape:
            self.put(f"{path}/0", packed(self.bytes(values.reshape(1), text)))
        elif values.size:
            for i in range(0, values.shape[0], chunks[0]):
                part = values[i : i + chunks[0]]
                if len(part) < chunks[0]:
                    whole = np.full(chunks, "" if text else 0, values.dtype)
                    whole[: len(part)] = part
                    part = whole
                key = ".".join(map(str, [i // chunks[0], *[0] * (values.ndim - 1)]))
                self.put(f"{path}/{key}", packed(self.bytes(part, text)))

    @staticmethod
    def bytes(values, text):
        if not text:
            return values.tobytes()
        items = [v.encode() for v in values.reshape(-1)]
        return struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(x)) + x for x in items)

    def consolidate(self):
        self.put(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": self.meta}).encode())

    def table(self, path, columns, **attrs):
        self.group(path, colnames=list(columns), neurodata_type="DynamicTable", **attrs)
        for name, values in columns.items():
            self.array(f"{path}/{name}", values, neurodata_type="VectorData")


def spikes(session, unit):
    return [round(0.1 * (unit + 1) * k + 0.01 * session, 6) for k in range(40 + unit)]


def write(path, n=0, consolidated=True, writer=Writer, **more):
    w = writer(path)
    w.group("", neurodata_type="NWBFile", namespace="core", object_id=f"o{n}")
    w.array("identifier", f"id-{n}")
    w.array("session_description", "a session")
    w.array("session_start_time", f"2024-01-0{n + 1}T10:00:00+00:00")
    w.array("general/session_id", f"ses/{n}")
    w.array("general/institution", "somewhere")
    w.array("general/keywords", ["a", "b", "c"])
    w.group("general/subject", neurodata_type="Subject")
    for name, value in {"subject_id": f"m{n}", "species": "Mus musculus", "sex": "F", "age": "P90D"}.items():
        w.array(f"general/subject/{name}", value)
    w.table(
        "intervals/trials",
        {"id": np.arange(6), "start_time": 0.05 + 2.0 * np.arange(6), "stop_time": 1.85 + 2.0 * np.arange(6), "condition": list("ABCDEF")}, description=f"trials {n}", same="x",
    )
    w.table("intervals/epochs", {"id": np.arange(3), "start_time": 0.1 + 4.0 * np.arange(3), "stop_time": 3.6 + 4.0 * np.arange(3), "tags": [t for i in range(3) for t in (f"tag_{i}", "task")], "tags_index": np.array([2, 4, 6])})
    times = [spikes(n, u) for u in range(4)]
    seen = [[[0.0, 5.5], [6.5, 12.0]], [[2.1, 7.5]], [[0.0, 5.5], [6.5, 12.0]], [[2.1, 7.5]]]
    w.table(
        "units",
        {
            "id": np.arange(4), "structure": ["VISp"] * 4, "spike_times": np.array([t for ts in times for t in ts]), "spike_times_index": np.cumsum([len(t) for t in times]),
            "obs_intervals": np.array([p for ps in seen for p in ps]), "obs_intervals_index": np.cumsum([len(p) for p in seen]), "waveform_mean": np.arange(24.0).reshape(4, 3, 2),
        },
    )
    base = "processing/behavior"
    w.group("processing", neurodata_type="NWBFile")
    w.group(base, neurodata_type="ProcessingModule")
    w.group(f"{base}/running_speed_with_timestamps", neurodata_type="TimeSeries")
    w.array(f"{base}/running_speed_with_timestamps/data", np.arange(12.0), chunk=5, unit="m/s", conversion=1.0)
    w.array(f"{base}/running_speed_with_timestamps/timestamps", np.arange(12.0) / 10, chunk=5, unit="seconds")
    w.group(f"{base}/running_speed_with_rate", neurodata_type="TimeSeries", description="speed")
    w.array(f"{base}/running_speed_with_rate/data", np.arange(10.0), unit="m/s")
    w.array(f"{base}/running_speed_with_rate/starting_time", np.array(2.0), rate=4.0, unit="seconds")
    for key, values in more.items():
        w.array(key.replace("__", "/"), values)
    if consolidated:
        w.consolidate()
    return path
