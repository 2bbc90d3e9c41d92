"""Sessions of a dataset in a public archive that has a web interface."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from .remote import resolved_address, scheme_of

#: Fixed value: the interface's address.
API = "https://api.dandiarchive.org/api"

#: Endings of files that hold a session.
SESSION_ENDINGS = (".nwb", ".nwb.zarr", ".zarr")

Fetch = Callable[[str, dict[str, Any]], dict[str, Any]]


def _fetch(url: str, params: dict[str, Any]) -> dict[str, Any]:
    import requests

    answer = requests.get(url, params=params, timeout=60)
    answer.raise_for_status()
    return answer.json()


class Archive:
    """``fetch`` gets an address and parameters and returns the decoded answer;
    ``resolve`` follows an address to where it leads."""

    def __init__(self, api: str = API, fetch: Fetch = _fetch, resolve: Callable[[str], str] = resolved_address):
        self.api, self.fetch, self.resolve = api.rstrip("/"), fetch, resolve

    def newest_version(self, dataset: str) -> str:
        return self.fetch(f"{self.api}/dandisets/{dataset}/", {})["most_recent_published_version"]["version"]

    def assets(self, dataset: str, version: str | None = None, order: str = "path") -> list[dict[str, Any]]:
        """All assets, in the given order, page by page."""
        version = version or self.newest_version(dataset)
        url: str | None = f"{self.api}/dandisets/{dataset}/versions/{version}/assets/"
        params, out = {"order": order}, []
        while url:
            page = self.fetch(url, params)
            out += page["results"]
            url, params = page.get("next"), {}
        return out

    def asset_url(self, dataset: str, asset: str, version: str | None = None) -> str:
        version = version or self.newest_version(dataset)
        found = self.fetch(f"{self.api}/dandisets/{dataset}/versions/{version}/assets/{asset}/", {})["contentUrl"]
        # an address in an object store serves ranges itself; others may lead there
        found = [u for u in found if scheme_of(u) in ("s3", "http", "https")]
        stored = [u for u in found if scheme_of(u) == "s3" or any(x.startswith("s3") for x in (urlsplit(u).hostname or "").split("."))]
        for url in [*stored, *found]:
            return url if scheme_of(url) == "s3" else self.resolve(url)
        raise ValueError(f"asset {asset} has no address in a store")

    def urls(self, dataset: str, version: str | None = None, order: str = "path", keep: Callable[[dict[str, Any]], bool] | None = None, most: int | None = None) -> list[str]:
        """Addresses of the dataset's sessions, in order."""
        version = version or self.newest_version(dataset)
        sessions = [a for a in self.assets(dataset, version, order) if a["path"].endswith(SESSION_ENDINGS) and (keep is None or keep(a))]
        with ThreadPoolExecutor(16) as pool:  # small requests that wait for the network
            return list(pool.map(lambda a: self.asset_url(dataset, a["asset_id"], version), sessions[:most]))

    def scan(self, spark: SparkSession, dataset: str, table_path: str, version: str | None = None, asset_filter: Callable[[dict[str, Any]], bool] | None = None, max_assets: int | None = None, **options: Any) -> DataFrame:
        from ..operators.scan import scan

        found = self.urls(dataset, version, keep=asset_filter, most=max_assets)
        if not found:
            raise ValueError(f"dataset {dataset} has no such sessions")
        return scan(spark, found, table_path, **options)

    def open(self, dataset: str, asset: str, version: str | None = None):
        from ..facade import Session

        return Session(self.asset_url(dataset, asset, version))
