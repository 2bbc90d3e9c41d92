"""Zarr containers of format version 2, read with the standard library and numpy."""

from __future__ import annotations

import base64
import bz2
import itertools
import json
import lzma
import math
import struct
import zlib
from typing import Any

import numpy as np

from . import container


def _arrow(codec: str, data: bytes, size: int | None) -> bytes:
    import pyarrow as pa

    return pa.Codec(codec).decompress(data, size, asbytes=True)


def _zstd(data: bytes, size: int | None = None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _lz4(data: bytes) -> bytes:
    (size,) = struct.unpack("<I", data[:4])
    return _arrow("lz4_raw", data[4:], size)


#: How the streams of a Blosc block are compressed, by the code in its header.
_BLOSC = {1: lambda d, n: _arrow("lz4_raw", d, n), 3: lambda d, n: zlib.decompress(d), 4: _zstd}


def blosc(data: bytes) -> bytes:
    """A Blosc frame: a header, starts of blocks, and blocks of one stream, or of
    one for each byte of an element; bytes of elements may be transposed."""
    _, _, flags, width, size, block, _ = struct.unpack("<BBBBIII", data[:16])
    if flags & 2:
        return data[16 : 16 + size]
    code = flags >> 5
    if code not in _BLOSC or flags & 4:
        raise NotImplementedError("Blosc with bit transposition" if flags & 4 else f"Blosc codec {code}")
    blocks = -(-size // block)
    out = []
    for i, at in enumerate(struct.unpack(f"<{blocks}i", data[16 : 16 + 4 * blocks])):
        here = min(block, size - i * block)
        split = not flags & 0x10 and width <= 16 and block // width >= 128 and here == block
        parts = width if split else 1
        pieces = []
        for _ in range(parts):
            (n,) = struct.unpack("<i", data[at : at + 4])
            piece = data[at + 4 : at + 4 + n]
            pieces.append(piece if n == here // parts else _BLOSC[code](piece, here // parts))
            at += 4 + n
        raw = b"".join(pieces)
        if flags & 1 and width > 1:
            whole = len(raw) // width * width
            raw = np.frombuffer(raw[:whole], np.uint8).reshape(width, -1).T.tobytes() + raw[whole:]
        out.append(raw)
    return b"".join(out)


#: Decoders of a chunk by the name in an array's metadata.
CODECS = {
    "zlib": zlib.decompress,
    "gzip": lambda d: zlib.decompress(d, 47),
    "bz2": bz2.decompress,
    "lzma": lzma.decompress,
    "zstd": _zstd,
    "lz4": _lz4,
    "blosc": blosc,
}


def _unpacked(data: bytes) -> list[bytes]:
    """Items that each follow their length; a count comes first."""
    (n,), at, out = struct.unpack("<I", data[:4]), 4, []
    for _ in range(n):
        (size,) = struct.unpack("<I", data[at : at + 4])
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


class Array(container.Array):
    def __init__(self, root: "Root", path: str, meta: dict):
        self.root, self.path, self.name = root, path, "/" + path
        self.shape, self.chunks = tuple(meta["shape"]), tuple(meta["chunks"])
        self.dtype, self.order = np.dtype(meta["dtype"]), meta.get("order", "C")
        self.separator = meta.get("dimension_separator", ".")
        self.compressor, self.filters, self.fill = meta.get("compressor"), meta.get("filters") or [], meta.get("fill_value")
        self.attrs = root.attrs_of(path)
        # batches follow each other, so the last chunk is often the next one's first
        self._last: tuple[tuple[int, ...], np.ndarray | None] | None = None

    def _fill(self) -> Any:
        if self.fill is None:
            return "" if self.dtype.kind in "OSU" else 0
        if self.dtype.kind == "S" and isinstance(self.fill, str):
            return base64.b64decode(self.fill)
        return {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(self.fill, self.fill) if self.dtype.kind == "f" else self.fill

    def _decode(self, data: bytes) -> np.ndarray:
        if self.compressor:
            name = self.compressor["id"]
            if name not in CODECS:
                raise NotImplementedError(f"{self.name}: no decoder for {name!r}")
            data = CODECS[name](data)
        values: Any = data
        for f in reversed(self.filters):
            name = f["id"]
            if name in ("vlen-utf8", "vlen-bytes"):
                items = _unpacked(values)
                values = np.array([x.decode() for x in items] if name == "vlen-utf8" else items, object)
            elif name == "json2":
                *items, _, shape = json.loads(values)
                values = np.array(items, object).reshape(shape)
            elif name == "shuffle":
                values = np.frombuffer(values, np.uint8).reshape(f["elementsize"], -1).T.tobytes()
            elif name == "delta":
                values = np.cumsum(np.frombuffer(values, f["dtype"])).astype(f["dtype"]).tobytes()
            else:
                raise NotImplementedError(f"{self.name}: no decoder for filter {name!r}")
        if not isinstance(values, np.ndarray):
            values = np.frombuffer(values, self.dtype)
        return values.reshape(self.chunks, order=self.order)

    def _chunk(self, index: tuple[int, ...]) -> np.ndarray | None:
        if self._last is None or self._last[0] != index:
            key = self.separator.join(map(str, index)) or "0"
            data = self.root.store.get(f"{self.path}/{key}")
            self._last = index, None if data is None else self._decode(data)
        return self._last[1]

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        start, stop, _ = slice(start, stop).indices(self.shape[0])
        stop = max(start, stop)
        out = np.full((stop - start, *self.shape[1:]), self._fill(), self.dtype)
        grids = [range(start // self.chunks[0], -(-stop // self.chunks[0]) if stop > start else 0)]
        grids += [range(-(-n // c)) for n, c in zip(self.shape[1:], self.chunks[1:])]
        for index in itertools.product(*grids):
            chunk = self._chunk(index)
            if chunk is None:
                continue
            first = index[0] * self.chunks[0]
            a, b = max(start, first), min(stop, first + self.chunks[0], self.shape[0])
            to, take = [slice(a - start, b - start)], [slice(a - first, b - first)]
            for i, n, c in zip(index[1:], self.shape[1:], self.chunks[1:]):
                to.append(slice(i * c, min(n, (i + 1) * c)))
                take.append(slice(0, min(n, (i + 1) * c) - i * c))
            out[tuple(to)] = chunk[tuple(take)]
        return out

    def scalar(self) -> Any:
        if self.shape:
            return self.read()
        data = self.root.store.get(f"{self.path}/0")
        return self._fill() if data is None else self._decode(data).reshape(-1)[0]


class Group(container.Group):
    def __init__(self, root: "Root", path: str):
        self.root, self.path, self.name = root, path, "/" + path
        self.attrs = root.attrs_of(path)

    def keys(self) -> list[str]:
        return self.root.keys_of(self.path)

    def get(self, path: str):
        return self.root.node(f"{self.path}/{path}".strip("/"))


class Root(Group):
    """The root group.  Consolidated metadata are read once, where they exist."""

    def __init__(self, store: container.Store, path: str):
        self.store, self.nodes = store, {}
        raw = store.get(".zmetadata")
        whole = json.loads(raw) if raw else {}
        self.meta: dict[str, dict] | None = whole["metadata"] if whole.get("zarr_consolidated_format") == 1 else None
        super().__init__(self, "")
        self.name = path

    def document(self, path: str, kind: str) -> dict | None:
        key = f"{path}/{kind}".strip("/")
        if self.meta is not None:
            return self.meta.get(key)
        raw = self.store.get(key)
        return json.loads(raw) if raw else None

    def attrs_of(self, path: str) -> dict[str, Any]:
        return self.document(path, ".zattrs") or {}

    def keys_of(self, path: str) -> list[str]:
        if self.meta is None:
            names = [n for n in self.store.children(path) if not n.startswith(".")]
            return [n for n in names if self.node(f"{path}/{n}".strip("/")) is not None]
        lead = f"{path}/" if path else ""
        below = {k[len(lead) :].split("/")[0] for k in self.meta if k.startswith(lead) and k.endswith(("/.zarray", "/.zgroup"))}
        return sorted(n for n in below if not n.startswith("."))

    def node(self, path: str):
        if path not in self.nodes:
            self.nodes[path] = self._node(path)
        return self.nodes[path]

    def _node(self, path: str):
        if (meta := self.document(path, ".zarray")) is not None:
            return Array(self, path, meta)
        if self.document(path, ".zgroup") is not None:
            return Group(self, path) if path else self
        return None


def open_root(path: str) -> Root:
    store = container.store_of(path)
    root = Root(store, path)
    if root.meta is None and store.get(".zgroup") is None:
        raise ValueError(f"{path} is no Zarr group of version 2")
    return root
