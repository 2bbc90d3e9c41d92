"""Bytes of remote stores: web addresses by ranges, object stores by pyarrow.

Options such as credentials are set on the driver with ``set_storage_options``;
they travel with jobs as a local property, so tasks open stores the same way.
"""

from __future__ import annotations

import io
import json
import os
import time
import urllib.parse
from collections import OrderedDict
from typing import Any

from pyspark.sql import SparkSession

PROPERTY = "sessionlake.storage"

#: Bytes of a block that is fetched at once, and blocks that a file keeps.
BLOCK = 1 << 20
KEPT = 64
TRIES = 4

_options: dict[str, dict[str, Any]] = {}


def set_storage_options(spark: SparkSession, **options: dict[str, Any]) -> None:
    """Options by scheme: ``http={"headers": {...}}`` are sent with each request;
    ``s3={"anonymous": True}``, ``gs=...`` are those of pyarrow's file systems."""
    _options.clear()
    _options.update(options)
    spark.sparkContext.setLocalProperty(PROPERTY, json.dumps(options) if options else None)


def storage_options(scheme: str) -> dict[str, Any]:
    from pyspark import TaskContext

    context = TaskContext.get()
    found = context.getLocalProperty(PROPERTY) if context is not None else None
    every = json.loads(found) if found else _options
    alias = {"https": "http", "s3a": "s3", "s3n": "s3", "gcs": "gs"}.get(scheme, scheme)
    return dict(every.get(alias, {}))


def scheme_of(path: str) -> str:
    return path.partition("://")[0].lower() if "://" in path else ""


def web_address(path: str) -> str:
    """``s3://bucket/key`` as the bucket's public web address; others as they are."""
    if path.startswith("s3://"):
        bucket, _, key = path[5:].partition("/")
        return f"https://{bucket}.s3.amazonaws.com/{key}"
    return path


def by_web(path: str) -> bool:
    """Whether a path is read over the web: web addresses, and public buckets."""
    scheme = scheme_of(path)
    return scheme in ("http", "https") or scheme == "s3" and not storage_options("s3")


def request(method: str, url: str, **headers: str):
    """The answer, or None where there is nothing.  Busy servers are asked again;
    an address that may not be read is an error, as nothing is known of what it holds."""
    import requests

    options = storage_options("http")
    for i in range(TRIES):
        try:
            answer = requests.request(method, url, headers={**options.get("headers", {}), **headers}, timeout=60, allow_redirects=True)
        except requests.ConnectionError:
            if i == TRIES - 1:
                raise
        else:
            if answer.status_code in (404, 410):
                return None
            if answer.status_code in (401, 403):
                raise PermissionError(f"{url}: the server says {answer.status_code}")
            if answer.status_code < 500 and answer.status_code != 429 or i == TRIES - 1:
                answer.raise_for_status()
                return answer
        time.sleep(0.2 * 2**i)


def resolved_address(url: str) -> str:
    """Where an address leads to in the end."""
    answer = request("HEAD", url)
    if answer is None:
        raise FileNotFoundError(url)
    return answer.url


def file_system(path: str):
    """pyarrow's file system for a path, and the path in it."""
    from pyarrow import fs

    scheme, options = scheme_of(path), storage_options(scheme_of(path))
    inside = path.split("://", 1)[1]
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(**options), inside
    if scheme in ("gs", "gcs"):
        return fs.GcsFileSystem(**options), inside
    if scheme in ("hdfs", "viewfs"):
        host = urllib.parse.urlsplit(path)
        return fs.HadoopFileSystem(**({"host": host.hostname or "default", "port": host.port or 0} | options)), host.path
    if scheme == "local":  # a mounted store
        return fs.LocalFileSystem(**options), inside
    return fs.FileSystem.from_uri(path)


class Bytes:
    """``read(offset, size)`` of a file wherever it is."""

    size: int

    def read(self, offset: int, size: int) -> bytes:
        raise NotImplementedError


class LocalBytes(Bytes):
    def __init__(self, path: str):
        self.fd = os.open(path, os.O_RDONLY)
        self.size = os.fstat(self.fd).st_size

    def read(self, offset: int, size: int) -> bytes:
        return os.pread(self.fd, size, offset)

    def __del__(self, close=os.close):
        if hasattr(self, "fd"):
            close(self.fd)


class BlockBytes(Bytes):
    """Fetches whole blocks, of which it keeps those used last; what lies between
    missing blocks side by side comes with one request."""

    def __init__(self):
        self.blocks: "OrderedDict[int, bytes]" = OrderedDict()

    def fetch(self, start: int, stop: int) -> bytes:
        raise NotImplementedError

    def read(self, offset: int, size: int) -> bytes:
        size = max(0, min(size, self.size - offset))
        if not size:
            return b""
        first, last = offset // BLOCK, (offset + size - 1) // BLOCK
        have, missing = {}, []
        for i in range(first, last + 1):
            if i in self.blocks:
                self.blocks.move_to_end(i)
                have[i] = self.blocks[i]
            elif missing and missing[-1][1] == i:
                missing[-1][1] = i + 1
            else:
                missing.append([i, i + 1])
        for a, b in missing:
            data = self.fetch(a * BLOCK, min(b * BLOCK, self.size))
            for i in range(a, b):
                have[i] = self.blocks[i] = data[(i - a) * BLOCK : (i - a + 1) * BLOCK]
        while len(self.blocks) > KEPT:
            self.blocks.popitem(last=False)
        whole = b"".join(have[i] for i in range(first, last + 1))
        return whole[offset - first * BLOCK : offset - first * BLOCK + size]


class WebBytes(BlockBytes):
    def __init__(self, path: str):
        super().__init__()
        answer = request("HEAD", web_address(path), **{"Accept-Encoding": "identity"})
        if answer is None:
            raise FileNotFoundError(path)
        self.url = answer.url  # after redirects
        self.size = int(answer.headers["Content-Length"])

    def fetch(self, start: int, stop: int) -> bytes:
        answer = request("GET", self.url, Range=f"bytes={start}-{stop - 1}", **{"Accept-Encoding": "identity"})
        if answer is None:
            raise FileNotFoundError(self.url)
        data = answer.content if answer.status_code == 206 else answer.content[start:stop]
        if len(data) != stop - start:
            raise OSError(f"{self.url}: {len(data)} bytes of {stop - start} at {start}")
        return data


class StoreBytes(BlockBytes):
    def __init__(self, path: str):
        super().__init__()
        files, inside = file_system(path)
        self.file = files.open_input_file(inside)
        self.size = self.file.size()

    def fetch(self, start: int, stop: int) -> bytes:
        return self.file.read_at(stop - start, start)


def open_bytes(path: str) -> Bytes:
    if not scheme_of(path):
        return LocalBytes(path)
    return WebBytes(path) if by_web(path) else StoreBytes(path)


class Stream(io.RawIOBase):
    """The same as a file object, for libraries that take one."""

    def __init__(self, data: Bytes):
        self.data, self.at = data, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.at = offset + (0 if whence == os.SEEK_SET else self.at if whence == os.SEEK_CUR else self.data.size)
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        found = self.data.read(self.at, len(buffer))
        buffer[: len(found)] = found
        self.at += len(found)
        return len(found)


def put(path: str, data: bytes) -> None:
    """Stores a whole file; folders are made."""
    if not scheme_of(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        return
    files, inside = file_system(path)
    files.create_dir(inside.rpartition("/")[0], recursive=True)
    with files.open_output_stream(inside) as f:
        f.write(data)
