"""Small HDF5 files in the format's classic layout, for fixtures and round trips."""

import struct
import zlib

import numpy as np

from .remote import put

NOWHERE = (1 << 64) - 1
pad = lambda b, n=8: b + b"\0" * (-len(b) % n)


class Writer:
    """Collects groups and arrays; ``consolidate`` writes the file."""

    def __init__(self, path):
        self.root, self.nodes, self.attrs = path, {"": None}, {}

    def group(self, path, **attrs):
        parts = path.split("/") if path else []
        for i in range(1, len(parts) + 1):
            self.nodes.setdefault("/".join(parts[:i]), None)
        self.attrs.setdefault(path, {}).update(attrs)

    def array(self, path, values, chunk=None, fixed=False, **attrs):
        self.group(path.rpartition("/")[0])
        self.nodes[path], self.attrs[path] = (values, chunk, fixed), attrs

    def table(self, path, columns, **attrs):
        self.group(path, colnames=list(columns), neurodata_type="DynamicTable", **attrs)
        for name, values in columns.items():
            if isinstance(values, list) and values and isinstance(values[0], (list, np.ndarray)):  # a ragged column
                self.array(f"{path}/{name}_index", np.cumsum([len(v) for v in values]))
                values = np.concatenate([np.asarray(v) for v in values])
            self.array(f"{path}/{name}", values, chunk=max(3, len(values) // 8) if np.ndim(values) and not isinstance(values, list) else None, neurodata_type="VectorData")

    def put(self, data):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def vtext(self, items):
        """Descriptors of strings in a global heap of their own."""
        raw = [s.encode() for s in items]
        body = b"".join(struct.pack("<HHIQ", i + 1, 1, 0, len(r)) + pad(r) for i, r in enumerate(raw))
        size = 16 + len(body) + 16
        at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, size) + body + struct.pack("<HHIQ", 0, 0, 0, 16))
        return b"".join(struct.pack("<IQI", len(r), at if r else 0, i + 1 if r else 0) for i, r in enumerate(raw))

    def typed(self, values, fixed=False):
        """Datatype, shape and raw bytes of values."""
        text = isinstance(values, str) or isinstance(values, list) and values and isinstance(values[0], str)
        if text:
            items = [values] if isinstance(values, str) else values
            shape = () if isinstance(values, str) else (len(values),)
            if fixed:
                n = max(len(s.encode()) for s in items) + 1
                return struct.pack("<B3BI", 0x13, 0, 0, 0, n), shape, b"".join(s.encode().ljust(n, b"\0") for s in items)
            base = struct.pack("<B3BI", 0x13, 0, 0, 0, 1)
            return struct.pack("<B3BI", 0x19, 1, 0, 0, 16) + base, shape, self.vtext(items)
        v = np.asarray(values)
        if v.dtype == bool:
            base = struct.pack("<B3BIHH", 0x10, 8, 0, 0, 1, 0, 8)
            return struct.pack("<B3BI", 0x18, 2, 0, 0, 1) + base + pad(b"FALSE\0") + pad(b"TRUE\0") + b"\0\1", v.shape, v.astype("i1").tobytes()
        size = v.dtype.itemsize
        if v.dtype.kind == "f":
            spread = {8: (63, 52, 11, 0, 52, 1023), 4: (31, 23, 8, 0, 23, 127)}[size]
            return struct.pack("<B3BIHHBBBBI", 0x11, 0x20, spread[0], 0, size, 0, 8 * size, spread[1], spread[2], spread[3], spread[4], spread[5]), v.shape, v.tobytes()
        return struct.pack("<B3BIHH", 0x10, 8 if v.dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size), v.shape, v.tobytes()

    def header(self, messages):
        body = b"".join(struct.pack("<HHB3x", kind, len(pad(data)), 0) + pad(data) for kind, data in messages)
        if len(messages) > 3:  # the last ones follow elsewhere
            parts = [struct.pack("<HHB3x", kind, len(pad(data)), 0) + pad(data) for kind, data in messages]
            more = b"".join(parts[3:])
            at = self.put(more)
            body = b"".join(parts[:3]) + struct.pack("<HHB3xQQ", 0x10, 16, 0, at, len(more))
            return self.put(struct.pack("<BBHII4x", 1, 0, len(messages) + 1, 1, len(body)) + body)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    @staticmethod
    def space(shape):
        return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def attributes(self, path):
        out = []
        for name, value in self.attrs.get(path, {}).items():
            kind, shape, raw = self.typed(value)
            label = name.encode() + b"\0"
            space = self.space(shape)
            out.append((0xC, struct.pack("<BBHHH", 1, 0, len(label), len(kind), len(space)) + pad(label) + pad(kind) + pad(space) + raw))
        return out

    def dataset(self, path):
        values, chunk, fixed = self.nodes[path]
        kind, shape, raw = self.typed(values, fixed)
        messages = [(0x1, self.space(shape)), (0x3, kind)]
        if chunk is None or not shape:
            messages.append((0x8, struct.pack("<BBQQ", 3, 1, self.put(raw) if raw else NOWHERE, len(raw))))
        else:
            size = struct.unpack_from("<I", kind, 4)[0]
            row = len(raw) // shape[0] if shape[0] else 0
            dims, keys = (chunk, *shape[1:]), []
            for i in range(0, shape[0], chunk):
                part = raw[i * row : (i + chunk) * row].ljust(chunk * row, b"\0")
                turned = np.frombuffer(part, np.uint8).reshape(-1, size).T.tobytes()
                packed = zlib.compress(turned)
                keys.append((i, len(packed), self.put(packed)))
            rank = len(shape) + 1
            key = lambda first, n: struct.pack(f"<II{rank}Q", n, 0, first, *[0] * (rank - 1))
            leaves = [keys[i : i + 2] for i in range(0, len(keys), 2)]
            node = lambda level, items: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(items), NOWHERE, NOWHERE) + b"".join(key(f, n) + struct.pack("<Q", a) for f, n, a in items) + key(shape[0], 0))
            tree = node(1, [(leaf[0][0], leaf[0][1], node(0, leaf)) for leaf in leaves]) if keys else NOWHERE
            filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHH", 2, 0, 1, 1) + struct.pack("<II", size, 0) + struct.pack("<HHHH", 1, 8, 1, 1) + pad(b"deflate\0") + struct.pack("<II", 4, 0)
            messages += [(0xB, filters), (0x8, struct.pack(f"<BBBQ{rank}I", 3, 2, rank, tree, *dims, size))]
        return self.header(messages + self.attributes(path))

    def folder(self, path):
        lead = f"{path}/" if path else ""
        below = sorted(p for p in self.nodes if p and p.startswith(lead) and "/" not in p[len(lead) :])
        names, entries = bytearray(8), []
        for p in below:
            at = len(names)
            names += pad(p[len(lead) :].encode() + b"\0")
            entries.append((at, self.folder(p) if self.nodes[p] is None else self.dataset(p)))
        data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, data))
        tables = [entries[i : i + 4] for i in range(0, len(entries), 4)]
        nodes = [self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(t)) + b"".join(struct.pack("<QQII16x", n, a, 0, 0) for n, a in t)) for t in tables]
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NOWHERE, NOWHERE) + b"".join(struct.pack("<QQ", 0, a) for a in nodes) + struct.pack("<Q", 0))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), *self.attributes(path)])

    def consolidate(self):
        self.out = bytearray(96)
        root = self.folder("")
        head = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHI4Q", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, NOWHERE, len(self.out), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.out[: len(head)] = head
        put(self.root, bytes(self.out))

    close = consolidate
