"""HDF5 containers: by the h5py library, or by the plain reader without it."""

from __future__ import annotations

from typing import Any

import numpy as np

from . import container
from .remote import Stream, open_bytes, scheme_of


class Array(container.Array):
    def __init__(self, node):
        import h5py

        self.node, self.name, self.shape = node, node.name, tuple(node.shape or ())
        text = h5py.check_string_dtype(node.dtype)
        self.text = text is not None
        self.reference = h5py.check_ref_dtype(node.dtype) is not None
        self.dtype = np.dtype(object) if self.text or self.reference else node.dtype
        self.attrs = dict(node.attrs)

    def _clean(self, x: Any) -> Any:
        if self.reference:
            return "<HDF5 object reference>" if np.ndim(x) == 0 else np.full(np.shape(x), "<HDF5 object reference>", object)
        return x

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        node = self.node.asstr() if self.text else self.node
        return self._clean(node[start:stop])

    def scalar(self) -> Any:
        return self._clean((self.node.asstr() if self.text else self.node)[()])


class Group(container.Group):
    def __init__(self, node):
        self.node, self.name, self.attrs = node, node.name, dict(node.attrs)

    def keys(self) -> list[str]:
        return list(self.node.keys())

    def get(self, path: str):
        found = self.node.get(path)
        if found is None:
            return None
        return Group(found) if hasattr(found, "keys") else Array(found)


def open_root(path: str) -> container.Group:
    """The root group; remote files are read by ranges, a block at a time."""
    try:
        import h5py
    except ImportError:
        from . import hdf5_plain

        return hdf5_plain.open_root(path)
    return Group(h5py.File(Stream(open_bytes(path)) if scheme_of(path) else path, "r"))
