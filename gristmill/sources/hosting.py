"""A data source for the listing and metadata endpoints of a hosting service.

``spark.dataSource.register(HostingSource)``, then ``spark.read.format("hosting")`` with the options

* ``base``: address below which the service answers, as ``https://host/repos/owner/name``,
* ``kind``: ``files`` (default; every file below ``folder``, recursively, as path, type, content in base64) or ``metadata`` (one row, JSON text),
* ``folder``: where to begin, ``token``: sent as a bearer token, ``timeout``: seconds for each request.

Folders of the first level are read by a task each.  Whatever fails on the way is a RuntimeError that names the address.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetched(url: str, token: str | None = None, timeout: float = 30.0):
    """The JSON document at an address."""
    request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except (urllib.error.URLError, OSError, ValueError) as e:
        raise RuntimeError(f"could not read {url}: {e}") from e


class Place(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class HostingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = options["base"].rstrip("/")
        self.kind, self.token, self.timeout = options.get("kind", "files"), options.get("token"), float(options.get("timeout", "30"))
        self.folder = options.get("folder", "").strip("/")

    def _contents(self, path: str) -> str:
        return f"{self.base}/contents/{path}".rstrip("/")

    def partitions(self) -> list[InputPartition]:
        if self.kind == "metadata":
            return [Place(self.base)]
        first = fetched(self._contents(self.folder), self.token, self.timeout)
        entries = first if isinstance(first, list) else [first]
        return [Place(self._contents(e["path"])) for e in entries] or [Place("")]

    def read(self, partition: Place):
        if not partition.url:
            return
        if self.kind == "metadata":
            yield (json.dumps(fetched(partition.url, self.token, self.timeout)),)
            return
        todo = [partition.url]
        while todo:
            got = fetched(todo.pop(), self.token, self.timeout)
            if isinstance(got, list):  # a folder
                todo += [self._contents(e["path"]) for e in reversed(got)]
            elif got.get("type", "file") != "dir":
                yield got["path"], got.get("type"), got.get("content")


class HostingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hosting"

    def schema(self) -> str:
        return "json string" if self.options.get("kind") == "metadata" else "path string, type string, content string"

    def reader(self, schema) -> HostingReader:
        return HostingReader(dict(self.options))
