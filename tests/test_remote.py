"""Sessions of a local web server, and of a mounted object store."""

import http.server
import os
import threading
import urllib.parse

import numpy as np
import pytest

import sessionlake as S
from sessionlake.sources import hdf5_writer, remote
from sessionlake.sources.archive import Archive
from sessionlake.sources.container import clear_cache, open_container
from tests import sessions


class Handler(http.server.BaseHTTPRequestHandler):
    """Serves ranges; below ``/secret`` only with a header, ``/move`` leads on,
    ``/busy`` works at the second try, and ``/api`` answers as an archive does."""

    seen, busy = [], set()

    def do_HEAD(self):
        self.answer(False)

    def do_GET(self):
        self.answer(True)

    def log_message(self, *_):
        pass

    def say(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        if "Content_Length" not in headers:
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def answer(self, whole):
        path = urllib.parse.unquote(self.path.split("?")[0])
        Handler.seen.append((self.command, path, self.headers.get("Range")))
        if path.startswith("/secret/"):
            if self.headers.get("X-Key") != "k":
                return self.say(403)
            path = path.removeprefix("/secret")
        if path.startswith("/move/"):
            return self.say(302, Location=path.removeprefix("/move"))
        if path.startswith("/busy/"):
            path = path.removeprefix("/busy")
            if path not in Handler.busy:
                Handler.busy.add(path)
                return self.say(503)
        if path in self.server.pages:
            return self.say(200, self.server.pages[path])
        file = self.server.root + path
        if not os.path.isfile(file):
            return self.say(404)
        with open(file, "rb") as f:
            data = f.read()
        if not whole:
            return self.say(200, Content_Length=str(len(data)))
        if wanted := self.headers.get("Range"):
            a, b = wanted.removeprefix("bytes=").split("-")
            return self.say(206, data[int(a) : int(b) + 1])
        self.say(200, data)


@pytest.fixture(scope="module")
def web(tmp_path_factory):
    root = tmp_path_factory.mktemp("web")
    for i in range(2):
        sessions.write(str(root / f"s{i}.nwb"), i, writer=hdf5_writer.Writer)
        sessions.write(str(root / f"s{i}.zarr"), i)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.root, server.pages = str(root), {}
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def rows(df):
    return sorted(map(str, df.drop("_nwb_path").collect()))


def test_hdf5_by_ranges(spark, web):
    server, base = web
    urls = [f"{base}/s{i}.nwb" for i in range(2)]
    for table in ("units", "trials", "epochs", "processing/behavior/running_speed_with_rate"):
        assert rows(S.scan(spark, urls, table)) == rows(S.scan(spark, [f"{server.root}/s{i}.nwb" for i in range(2)], table))
    assert any(r and method == "GET" for method, _, r in Handler.seen) and not any(m == "GET" and r is None and p.endswith(".nwb") for m, p, r in Handler.seen)
    assert {r._nwb_path for r in S.scan(spark, urls, "units").collect()} == set(urls)


def test_zarr_by_web_address(spark, web):
    server, base = web
    assert rows(S.scan(spark, [f"{base}/s0.zarr", f"{base}/s1.zarr"], "trials")) == rows(S.scan(spark, [f"{server.root}/s0.zarr", f"{server.root}/s1.zarr"], "trials"))


def test_blocks_are_fetched_once_and_together(web, monkeypatch):
    server, base = web
    data = np.random.default_rng(0).bytes(10_000)
    with open(f"{server.root}/blob", "wb") as f:
        f.write(data)
    monkeypatch.setattr(remote, "BLOCK", 1000)
    monkeypatch.setattr(remote, "KEPT", 4)
    Handler.seen.clear()
    b = remote.WebBytes(f"{base}/move/blob")
    assert b.size == 10_000 and b.url.endswith("/blob") and "/move/" not in b.url
    assert b.read(1500, 3000) == data[1500:4500] and b.read(2100, 50) == data[2100:2150] and b.read(9990, 100) == data[9990:] and b.read(20_000, 5) == b""
    assert [r for _, p, r in Handler.seen if r] == ["bytes=1000-4999", "bytes=9000-9999"] and len(b.blocks) <= 4
    for _ in range(50):
        at, n = np.random.randint(0, 10_000), np.random.randint(0, 4_000)
        assert b.read(at, n) == data[at : at + n]
    s = remote.Stream(b)
    s.seek(-10, os.SEEK_END)
    assert s.read() == data[-10:] and s.tell() == 10_000


def test_refused_addresses_are_errors(spark, web):
    """What may not be read isn't taken for missing, which would give fill values."""
    _, base = web
    clear_cache()
    for path in ("s0.nwb", "s0.zarr"):
        with pytest.raises(PermissionError):
            open_container(f"{base}/secret/{path}")
    for path in ("none.nwb", "none.zarr"):
        with pytest.raises((FileNotFoundError, ValueError)):
            open_container(f"{base}/{path}")
    want = S.scan(spark, f"{base}/s0.nwb", "trials").count()
    S.set_storage_options(spark, http={"headers": {"X-Key": "k"}})
    try:
        for path in ("s0.nwb", "s0.zarr"):
            assert S.scan(spark, f"{base}/secret/{path}", "trials").count() == want
    finally:
        S.set_storage_options(spark)
    assert remote.storage_options("http") == {}


def test_busy_servers_are_asked_again(web):
    _, base = web
    clear_cache()
    assert open_container(f"{base}/busy/s1.nwb")["units"].keys()


def test_archive_scan(spark, web):
    """From the archive's interface to rows, nothing replaced."""
    import json

    server, base = web
    api = "/api/dandisets/7"
    server.pages |= {
        k: json.dumps(v).encode() for k, v in {
            f"{api}/": {"most_recent_published_version": {"version": "v1"}},
            f"{api}/versions/v1/assets/": {"results": [{"asset_id": "p", "path": "x/s0.nwb"}, {"asset_id": "n", "path": "notes.txt"}], "next": f"{base}/api/more"},
            "/api/more": {"results": [{"asset_id": "q", "path": "x/s1.nwb.zarr"}], "next": None},
            f"{api}/versions/v1/assets/p/": {"contentUrl": [f"{base}/move/s0.nwb"]},
            f"{api}/versions/v1/assets/q/": {"contentUrl": [f"{base}/s1.zarr"]},
        }.items()
    }
    a = Archive(f"{base}/api", resolve=lambda url: url if url.endswith("zarr") else remote.resolved_address(url))
    assert a.urls("7") == [f"{base}/s0.nwb", f"{base}/s1.zarr"]
    assert a.scan(spark, "7", "units").count() == 8
    assert a.scan(spark, "7", "trials", max_assets=1).count() == 6
    assert a.scan(spark, "7", "trials", asset_filter=lambda x: x["path"].endswith("zarr")).select("_nwb_path").distinct().count() == 1
    assert a.open("7", "p").identifier == "id-0"
    with pytest.raises(ValueError):
        a.scan(spark, "7", "units", asset_filter=lambda x: False)


def test_object_stores(spark, web):
    """pyarrow's file systems, here that of a mounted store."""
    server, _ = web
    clear_cache()
    paths = [f"local://{server.root}/s0.nwb", f"local://{server.root}/s1.zarr"]
    assert rows(S.scan(spark, paths, "units")) == rows(S.scan(spark, [f"{server.root}/s0.nwb", f"{server.root}/s1.zarr"], "units"))
    assert remote.by_web("s3://bucket/key")
    S.set_storage_options(spark, s3={"anonymous": True, "region": "us-east-1"})
    try:
        assert not remote.by_web("s3://bucket/key") and remote.storage_options("s3a") == {"anonymous": True, "region": "us-east-1"}
        files, inside = remote.file_system("s3://bucket/key/x")
        assert type(files).__name__ == "S3FileSystem" and inside == "bucket/key/x"
    finally:
        S.set_storage_options(spark)
    with pytest.raises(Exception):
        remote.file_system("nothing://x/y")
    remote.put(f"local://{server.root}/new/folder/x", b"abc")
    assert remote.open_bytes(f"local://{server.root}/new/folder/x").read(1, 5) == b"bc"
