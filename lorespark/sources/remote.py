"""Items from a code host's repository and from a resource server, as Python data sources.

Both take `fetch`, the dotted name of a function (url, body or None, headers) -> parsed JSON, so that tests and closed
networks need no connection; the default uses urllib. Listing happens when the scan is planned, one partition a file.
"""

from __future__ import annotations

import base64
import importlib
import json
import urllib.request
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorespark.operators.access import EVERYONE

SCHEMA = "source string, source_id string, text string, allowed_principals array<string>, occurred_at timestamp"


def fetch_json(url: str, body: dict | None, headers: dict):
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=30) as r:
        return json.loads(r.read())


def _fetcher(options: dict):
    module, _, name = options.get("fetch", f"{__name__}.fetch_json").rpartition(".")
    return getattr(importlib.import_module(module), name)


def _principals(options: dict) -> list[str]:
    return [x for x in options.get("principals", "").split(",") if x] or [EVERYONE]


class One(InputPartition):
    def __init__(self, name: str, address: str):
        self.name, self.address = name, address


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _get(self, path: str):
        o = self.options
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {o['token']}"} if o.get("token") else {})
        return _fetcher(o)(f"{o.get('base', 'https://api.github.com')}/repos/{o['owner']}/{o['repo']}/{path}", None, headers)

    def partitions(self):
        """The ref is resolved to one commit, so all files are of one state."""
        commit = self._get(f"commits/{self.options.get('ref', 'main')}")
        self.when = commit["commit"]["committer"]["date"]
        tree = self._get(f"git/trees/{commit['sha']}?recursive=1")["tree"]
        prefix = self.options.get("path_prefix", "")
        return [One(x["path"], x["sha"]) for x in tree if x["type"] == "blob" and x["path"].startswith(prefix) and x["path"].lower().endswith((".md", ".txt"))]

    def read(self, partition):
        blob = self._get(f"git/blobs/{partition.address}")
        text = base64.b64decode(blob["content"]).decode("utf-8", errors="replace")
        o = self.options
        yield ("github", f"{o['owner']}/{o['repo']}:{partition.name}", text, _principals(o), datetime.fromisoformat(self.when.replace("Z", "+00:00")))


class RepositorySource(DataSource):
    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RepositoryReader(self.options)


class ResourceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _call(self, method: str, params: dict, number: int):
        headers = {"Content-Type": "application/json"} | json.loads(self.options.get("headers", "{}"))
        got = _fetcher(self.options)(self.options["url"], {"jsonrpc": "2.0", "id": number, "method": method, "params": params}, headers)
        if "error" in got:
            raise RuntimeError(f"{method}: {got['error']}")
        return got["result"]

    def partitions(self):
        found, cursor, page = [], None, 1
        while True:
            got = self._call("resources/list", {"cursor": cursor} if cursor else {}, page)
            found += [One(x.get("name", x["uri"]), x["uri"]) for x in got.get("resources", [])]
            cursor, page = got.get("nextCursor"), page + 1
            if not cursor:
                return found

    def read(self, partition):
        got = self._call("resources/read", {"uri": partition.address}, 1)
        text = "\n".join(x["text"] for x in got.get("contents", []) if x.get("text"))
        if text:
            yield ("mcp", partition.address, text, _principals(self.options), datetime.now().astimezone())


class ResourceSource(DataSource):
    @classmethod
    def name(cls):
        return "resources"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ResourceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositorySource)
    spark.dataSource.register(ResourceSource)
