"""What a container of any format looks like: groups and arrays in a tree."""

from __future__ import annotations

import os
import urllib.parse
from abc import ABC, abstractmethod
from collections import OrderedDict
from typing import Any

import numpy as np

from ..constants import InternalPathError, normalise
from .remote import by_web, file_system, request, scheme_of, web_address


class Array(ABC):
    """A dataset.  ``read`` returns rows of its first dimension."""

    is_group = False
    name: str
    shape: tuple[int, ...]
    dtype: np.dtype
    attrs: dict[str, Any]

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @abstractmethod
    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray: ...

    @abstractmethod
    def scalar(self) -> Any: ...


class Group(ABC):
    is_group = True
    name: str
    attrs: dict[str, Any]

    @abstractmethod
    def keys(self) -> list[str]: ...

    @abstractmethod
    def get(self, path: str) -> "Group | Array | None": ...

    def __contains__(self, path: str) -> bool:
        return self.get(path) is not None

    def __getitem__(self, path: str) -> "Group | Array":
        path = normalise(path)
        found = self if path == "/" else self.get(path)
        if found is None:
            raise InternalPathError(f"no {path!r} in {self.name}")
        return found


class Store(ABC):
    """Bytes by key; a missing key is None."""

    @abstractmethod
    def get(self, key: str) -> bytes | None: ...

    @abstractmethod
    def children(self, key: str) -> list[str]: ...


class LocalStore(Store):
    def __init__(self, root: str):
        self.root = root

    def get(self, key: str) -> bytes | None:
        try:
            with open(os.path.join(self.root, key), "rb") as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def children(self, key: str) -> list[str]:
        try:
            return sorted(os.listdir(os.path.join(self.root, key)))
        except (FileNotFoundError, NotADirectoryError):
            return []


class HttpStore(Store):
    """Objects below a web address.  It can't list, so a container read through
    it needs consolidated metadata."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def get(self, key: str) -> bytes | None:
        answer = request("GET", f"{self.root}/{urllib.parse.quote(key)}")
        return None if answer is None else answer.content

    def children(self, key: str) -> list[str]:
        return []


class ArrowStore(Store):
    """Objects below a path of one of pyarrow's file systems."""

    def __init__(self, files, root: str):
        self.files, self.root = files, root.rstrip("/")

    def get(self, key: str) -> bytes | None:
        from pyarrow import fs

        path = f"{self.root}/{key}"
        if self.files.get_file_info(path).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(path) as f:
            return f.read()

    def children(self, key: str) -> list[str]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{key}".rstrip("/"), allow_not_found=True))
        return sorted(x.base_name for x in found)


def store_of(path: str) -> Store:
    if not scheme_of(path):
        return LocalStore(path)
    return HttpStore(web_address(path)) if by_web(path) else ArrowStore(*file_system(path))


def resolved(path: str) -> str:
    """The form of a session's path that results carry."""
    path = os.fspath(path)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return path
    return os.path.realpath(path)


class Opened:
    """The containers that a process used last.  They stay in their process:
    sent elsewhere, it arrives empty."""

    most = 64

    def __init__(self):
        self.roots: "OrderedDict[tuple, Group]" = OrderedDict()

    def __reduce__(self):
        return Opened, ()

    def get(self, path: str) -> Group:
        stamp = os.stat(path).st_mtime_ns if "://" not in path and os.path.exists(path) else None
        if "://" not in path and stamp is None:
            raise FileNotFoundError(path)
        if (root := self.roots.get((path, stamp))) is None:
            root = _first_that_opens(path)
            self.roots[path, stamp] = root
        self.roots.move_to_end((path, stamp))
        while len(self.roots) > self.most:
            self.roots.popitem(last=False)
        return root


def _first_that_opens(path: str) -> Group:
    """By the format that the path looks like, else by the other one; what can't
    be found or may not be read is neither."""
    from . import hdf5, zarr2

    zarr = "zarr" in path or "://" not in path and os.path.isdir(path)
    first, second = (zarr2, hdf5) if zarr else (hdf5, zarr2)
    try:
        return first.open_root(path)
    except (FileNotFoundError, PermissionError) as e:
        if "://" not in path or isinstance(e, PermissionError):
            raise
        error: Exception = e
    except NotImplementedError:  # it is of this format
        raise
    except Exception as e:
        error = e
    try:
        return second.open_root(path)
    except Exception:
        raise error from None


_opened = Opened()


def open_container(path: str | os.PathLike) -> Group:
    """The root group of a container; one that changed since is opened anew."""
    return _opened.get(resolved(path))


def clear_cache() -> None:
    _opened.roots.clear()
