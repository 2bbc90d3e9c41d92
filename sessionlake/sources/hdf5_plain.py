"""HDF5 files read with numpy alone, where the h5py library isn't installed.

Covers what the format's classic writers make: superblocks of all versions,
both object headers, groups by symbol tables or compact links, compact,
contiguous and chunked data with the deflate, shuffle and checksum filters,
numbers, fixed and variable-length strings, enumerations and object references.
Links or attributes in fractal heaps and the newer chunk indexes aren't read,
and say so.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import Any

import numpy as np

from . import container
from .remote import open_bytes

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
REFERENCE = "<HDF5 object reference>"

#: Numbers of header messages.
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS, ATTRIBUTE_INFO = 0x1, 0x2, 0x3, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x15


@dataclass
class Kind:
    """``what`` is number, text, vtext, vlist, flag, reference or other."""

    what: str
    size: int
    dtype: np.dtype
    base: "Kind | None" = None


class File:
    def __init__(self, path: str):
        self.bytes = open_bytes(path)
        self.path, self.heaps = path, {}
        read, at = self.bytes.read, 0
        while read(at, 8) != SIGNATURE:
            at = 512 if not at else 2 * at
            if at >= self.bytes.size:
                raise OSError(f"{path} is no HDF5 file")
        version = read(at + 8, 1)[0]
        if version < 2:
            offsets, lengths = read(at + 13, 2)
            start = at + (24 if version == 0 else 28)
            self.base, _, _, _ = struct.unpack("<4Q", read(start, 32))
            self.root = struct.unpack("<Q", read(start + 40, 8))[0]
        else:
            offsets, lengths = read(at + 9, 2)
            self.base, _, _, self.root = struct.unpack("<4Q", read(at + 12, 32))
        if (offsets, lengths) != (8, 8):
            raise NotImplementedError(f"{path}: addresses of {offsets} and lengths of {lengths} bytes")

    def read(self, address: int, size: int) -> bytes:
        return self.bytes.read(self.base + address, size)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        out: list[tuple[int, bytes]] = []
        if self.read(address, 4) == b"OHDR":
            flags = self.read(address + 5, 1)[0]
            at = address + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.read(at, width), "little")
            lead = 6 if flags & 4 else 4
            blocks = [(at + width, size)]
            for start, size in blocks:
                data, i = self.read(start, size), 0
                while i + lead <= size:
                    kind, n = data[i], struct.unpack_from("<H", data, i + 1)[0]
                    body = data[i + lead : i + lead + n]
                    if kind == CONTINUATION:
                        where, length = struct.unpack("<QQ", body)
                        blocks.append((where + 4, length - 8))  # between a signature and a checksum
                    else:
                        out.append((kind, body))
                    i += lead + n
            return out
        _, _, count, _, size = struct.unpack("<BBHII", self.read(address, 12))
        blocks = [(address + 16, size)]
        for start, size in blocks:
            data, i = self.read(start, size), 0
            while i + 8 <= size and count:
                kind, n = struct.unpack_from("<HH", data, i)
                body = data[i + 8 : i + 8 + n]
                count -= 1
                if kind == CONTINUATION:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                else:
                    out.append((kind, body))
                i += 8 + n
        return out

    def heap_object(self, address: int, index: int) -> bytes:
        """An item of a global heap, where variable-length values are stored."""
        if address not in self.heaps:
            (size,) = struct.unpack("<Q", self.read(address + 8, 8))
            data, at, items = self.read(address, size), 16, {}
            while at + 16 <= size:
                number, _, _, n = struct.unpack_from("<HHIQ", data, at)
                if not number:
                    break
                items[number] = data[at + 16 : at + 16 + n]
                at += 16 + -(-n // 8) * 8
            if len(self.heaps) > 256:
                self.heaps.clear()
            self.heaps[address] = items
        return self.heaps[address].get(index, b"")


def kind_of(data: bytes) -> tuple[Kind, int]:
    """A datatype, and how many bytes its description has."""
    what, bits, (size,) = data[0] & 15, data[1] | data[2] << 8, struct.unpack_from("<I", data, 4)
    order = ">" if bits & 1 else "<"
    text = np.dtype(object)
    if what == 0:
        return Kind("number", size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")), 12
    if what == 1:
        return Kind("number", size, np.dtype(f"{order}f{size}")), 20
    if what == 3:
        return Kind("text", size, text), 8
    if what == 7:
        return Kind("reference", size, text), 8
    if what == 8:
        base, used = kind_of(data[8:])
        names, at = [], 8 + used
        for _ in range(bits):
            end = data.index(b"\0", at)
            names.append(data[at:end])
            at += end - at + 1 if data[0] >> 4 >= 3 else -(-(end - at + 1) // 8) * 8
        flag = sorted(names) == [b"FALSE", b"TRUE"]
        return Kind("flag" if flag else "number", size, np.dtype(bool) if flag else base.dtype, base), at + bits * size
    if what == 9:
        base, used = kind_of(data[8:])
        return Kind("vtext" if bits & 15 == 1 else "vlist", size, text, base), 8 + used
    return Kind("other", size, text), len(data)


def shape_of(data: bytes) -> tuple[int, ...] | None:
    version, rank = data[0], data[1]
    if version == 2 and data[3] == 2:
        return None
    return struct.unpack_from(f"<{rank}Q", data, 8 if version == 1 else 4)


def decoded(file: File, kind: Kind, raw: bytes, count: int) -> np.ndarray:
    if kind.what == "number":
        return np.frombuffer(raw, kind.dtype, count)
    if kind.what == "flag":
        return np.frombuffer(raw, kind.base.dtype, count) != 0
    out = np.empty(count, object)
    for i in range(count):
        cell = raw[i * kind.size : (i + 1) * kind.size]
        if kind.what == "text":
            out[i] = cell.split(b"\0")[0].decode("utf-8", "replace").rstrip(" ")
        elif kind.what in ("vtext", "vlist"):
            n, address, index = struct.unpack("<IQI", cell)
            data = file.heap_object(address, index) if n else b""
            out[i] = data.split(b"\0")[0].decode("utf-8", "replace") if kind.what == "vtext" else decoded(file, kind.base, data, n).tolist()
        else:
            out[i] = REFERENCE if kind.what == "reference" else cell.hex()
    return out


def attribute(file: File, data: bytes) -> tuple[str, Any]:
    version = data[0]
    n, t, s = struct.unpack_from("<HHH", data, 2)
    at = 8 if version < 3 else 9
    step = (lambda x: -(-x // 8) * 8) if version == 1 else (lambda x: x)
    name = data[at : at + n].split(b"\0")[0].decode("utf-8", "replace")
    kind, _ = kind_of(data[at + step(n) : at + step(n) + t])
    shape = shape_of(data[at + step(n) + step(t) : at + step(n) + step(t) + s])
    if shape is None:
        return name, None
    values = decoded(file, kind, data[at + step(n) + step(t) + step(s) :], int(np.prod(shape, dtype=int)))
    return name, values.reshape(shape).tolist() if shape else values.tolist()[0]


class Node:
    def __init__(self, file: File, address: int, name: str):
        self.file, self.address, self.name = file, address, name
        self.parts = file.messages(address)
        for kind, body in self.parts:
            if kind == ATTRIBUTE_INFO and self._heap(body, 2 if body[1] & 1 else 0) != NOWHERE:
                raise NotImplementedError(f"{name}: attributes in a fractal heap; install h5py")
        self.attrs = dict(attribute(file, body) for kind, body in self.parts if kind == ATTRIBUTE)

    @staticmethod
    def _heap(body: bytes, skip: int) -> int:
        return struct.unpack_from("<Q", body, 2 + skip)[0]

    def part(self, kind: int) -> bytes | None:
        return next((body for k, body in self.parts if k == kind), None)


class Array(Node, container.Array):
    def __init__(self, file: File, address: int, name: str):
        super().__init__(file, address, name)
        self.kind, _ = kind_of(self.part(DATATYPE))
        self.dtype, self.shape = self.kind.dtype, shape_of(self.part(DATASPACE)) or ()
        self.filters = self._filters(self.part(FILTERS))
        self._chunks: list | None = None
        # batches follow each other, so the last chunk is often the next one's first
        self._last: tuple[int, np.ndarray] | None = None

    @staticmethod
    def _filters(data: bytes | None) -> list[int]:
        if data is None:
            return []
        out, at = [], 8 if data[0] == 1 else 2
        for _ in range(data[1]):
            number = struct.unpack_from("<H", data, at)[0]
            named = data[0] == 1 or number >= 256
            n = struct.unpack_from("<H", data, at + 2)[0] if named else 0
            _, values = struct.unpack_from("<HH", data, at + (4 if named else 2))
            at += (8 if named else 6) + (-(-n // 8) * 8 if data[0] == 1 else n) + 4 * values
            at += 4 if data[0] == 1 and values % 2 else 0
            out.append(number)
        return out

    def _unfiltered(self, raw: bytes, mask: int) -> bytes:
        for i in reversed(range(len(self.filters))):
            if mask >> i & 1:
                continue
            number = self.filters[i]
            if number == 1:
                raw = zlib.decompress(raw)
            elif number == 2:
                n = len(raw) // self.kind.size * self.kind.size
                raw = np.frombuffer(raw[:n], np.uint8).reshape(self.kind.size, -1).T.tobytes() + raw[n:]
            elif number == 3:
                raw = raw[:-4]
            else:
                raise NotImplementedError(f"{self.name}: no decoder for filter {number}; install h5py")
        return raw

    def _tree(self, address: int, rank: int) -> list[tuple[tuple[int, ...], int, int, int]]:
        """Offsets, size, skipped filters and address of the chunks below a node."""
        head = self.file.read(address, 24)
        if head[:4] != b"TREE":
            raise OSError(f"{self.name}: no chunk index at {address}")
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        key = 8 + 8 * rank
        data, out = self.file.read(address + 24, used * (key + 8) + key), []
        for i in range(used):
            at = i * (key + 8)
            size, mask = struct.unpack_from("<II", data, at)
            child = struct.unpack_from("<Q", data, at + key)[0]
            out += self._tree(child, rank) if level else [(struct.unpack_from(f"<{rank - 1}Q", data, at + 8), size, mask, child)]
        return out

    def _all(self) -> np.ndarray | tuple[tuple[int, ...], list]:
        """The whole array, or the shape of its chunks and where they are."""
        data = self.part(LAYOUT)
        count = int(np.prod(self.shape, dtype=int))
        if data[0] not in (3, 4) or data[0] == 4 and data[1] == 2:
            raise NotImplementedError(f"{self.name}: data layout {data[0]}; install h5py")
        if data[1] == 0:
            (n,) = struct.unpack_from("<H", data, 2)
            return decoded(self.file, self.kind, data[4 : 4 + n], count).reshape(self.shape)
        if data[1] == 1:
            return struct.unpack_from("<QQ", data, 2)
        rank = data[2]
        (tree,) = struct.unpack_from("<Q", data, 3)
        if self._chunks is None:
            self._chunks = [] if tree == NOWHERE else self._tree(tree, rank)
        return struct.unpack_from(f"<{rank - 1}I", data, 11), self._chunks

    def _empty(self, shape: tuple[int, ...]) -> np.ndarray:
        return np.full(shape, "" if self.dtype == object else 0, self.dtype)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        start, stop, _ = slice(start, stop).indices(self.shape[0])
        stop, data = max(start, stop), self.part(LAYOUT)
        found = self._all()
        if data[1] == 0:
            return found[start:stop]
        shape = (stop - start, *self.shape[1:])
        row = int(np.prod(self.shape[1:], dtype=int))
        if data[1] == 1:
            if found[0] == NOWHERE:
                return self._empty(shape)
            raw = self.file.read(found[0] + start * row * self.kind.size, (stop - start) * row * self.kind.size)
            return decoded(self.file, self.kind, raw, (stop - start) * row).reshape(shape)
        chunk, places = found
        out = self._empty(shape)
        for first, size, mask, address in places:
            if first[0] + chunk[0] <= start or first[0] >= stop:
                continue
            if self._last is None or self._last[0] != address:
                raw = self._unfiltered(self.file.read(address, size), mask)
                self._last = address, decoded(self.file, self.kind, raw, int(np.prod(chunk, dtype=int))).reshape(chunk)
            values = self._last[1]
            to, take = [], []
            for d, (a, c) in enumerate(zip(first, chunk)):
                low, high = (start, stop) if d == 0 else (0, self.shape[d])
                b, e = max(a, low), min(a + c, high)
                to.append(slice(b - low, e - low))
                take.append(slice(b - a, e - a))
            out[tuple(to)] = values[tuple(take)]
        return out

    def scalar(self) -> Any:
        if self.shape:
            return self.read()
        found, data = self._all(), self.part(LAYOUT)
        if data[1] == 1:
            found = self._empty((1,)) if found[0] == NOWHERE else decoded(self.file, self.kind, self.file.read(found[0], self.kind.size), 1)
        return found.reshape(-1)[0]


class Group(Node, container.Group):
    def __init__(self, file: File, address: int, name: str):
        super().__init__(file, address, name)
        self.links = dict(self._links())
        self.nodes: dict[str, Group | Array] = {}

    def _links(self):
        if (data := self.part(SYMBOLS)) is not None:
            tree, heap = struct.unpack("<QQ", data[:16])
            size, _, where = struct.unpack("<QQQ", self.file.read(heap + 8, 24))
            names = self.file.read(where, size)
            for address in self._tables(tree):
                head = self.file.read(address, 8)
                (n,) = struct.unpack_from("<H", head, 6)
                body = self.file.read(address + 8, 40 * n)
                for i in range(n):
                    name, target, cache = struct.unpack_from("<QQI", body, 40 * i)
                    if cache != 2:  # a soft link has no object of its own
                        yield names[name : names.index(b"\0", name)].decode("utf-8", "replace"), target
        for kind, data in self.parts:
            if kind == LINK_INFO and self._heap(data, 8 if data[1] & 1 else 0) != NOWHERE:
                raise NotImplementedError(f"{self.name}: links in a fractal heap; install h5py")
            if kind == LINK:
                flags, at = data[1], 2
                link = data[at] if flags & 8 else 0
                at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = int.from_bytes(data[at : at + width], "little")
                if link == 0:
                    yield data[at + width : at + width + n].decode("utf-8", "replace"), struct.unpack_from("<Q", data, at + width + n)[0]

    def _tables(self, address: int):
        head = self.file.read(address, 24)
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        data = self.file.read(address + 24, 16 * used + 8)
        for i in range(used):
            (child,) = struct.unpack_from("<Q", data, 8 + 16 * i)
            yield from self._tables(child) if level else [child]

    def keys(self) -> list[str]:
        return list(self.links)

    def get(self, path: str):
        name, _, rest = path.strip("/").partition("/")
        if name not in self.links:
            return None
        if name not in self.nodes:
            address, inside = self.links[name], f"{self.name.rstrip('/')}/{name}"
            kinds = {k for k, _ in self.file.messages(address)}
            self.nodes[name] = (Array if DATATYPE in kinds and LAYOUT in kinds else Group)(self.file, address, inside)
        node = self.nodes[name]
        return node if not rest else node.get(rest) if node.is_group else None


def open_root(path: str) -> Group:
    file = File(path)
    return Group(file, file.root, "/")


