"""Collectors as a Python data source: URLs in, responses out, read by the executors.

    spark.dataSource.register(CollectorSource)
    spark.read.format("collector").option("urls", json.dumps(urls)).load()

Options: ``urls``, a JSON array of URLs, or ``path``, a mounted text file with
one a line; ``collector``, "module:function" of
(url, headers, timeout) -> Response, by default the HTTP one here; ``agents``, a
JSON array of user agents that take turns; ``timeout`` in seconds; ``attempts``;
``backoff`` in seconds; ``partitions``.  All URLs of a host are in one partition
and are fetched one after the other, so a host is asked by one task at a time.

A response that fails is a row with its error, never a failed task.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "requested_url string, final_url string, status int, content binary, headers map<string,string>, elapsed_ms double, redirect_chain array<string>, not_modified boolean, filtered_reason string, error string, attempts int"
#: Statuses that are worth another try.
AGAIN = (408, 429, 500, 502, 503, 504)


class Response(NamedTuple):
    final_url: str
    status: int
    content: bytes
    headers: dict
    redirects: tuple = ()


def http(url: str, headers: dict, timeout: float) -> Response:
    """By the standard library. Redirects are followed and told; a status is an answer and no exception."""
    chain: list[str] = []

    class Told(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, found, newurl):
            chain.append(newurl)
            return super().redirect_request(req, fp, code, msg, found, newurl)

    lower = lambda h: {k.lower(): v for k, v in h.items()}
    try:
        with urllib.request.build_opener(Told).open(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return Response(answer.geturl(), answer.status, answer.read(), lower(answer.headers), tuple(chain))
    except urllib.error.HTTPError as e:
        with e:
            return Response(e.geturl(), e.code, e.read(), lower(e.headers), tuple(chain))


class Hosts(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class CollectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        if "urls" in self.options:
            urls = json.loads(self.options["urls"])
        else:
            with open(self.options["path"].removeprefix("file://"), encoding="utf-8") as lines:
                urls = [x.strip() for x in lines if x.strip()]
        n = max(1, int(self.options.get("partitions", "8")))
        parts: list[list[str]] = [[] for _ in range(n)]
        for url in urls:
            parts[zlib.crc32((urlsplit(url).hostname or "").encode()) % n].append(url)
        return [Hosts(p) for p in parts if p] or [Hosts([])]

    def read(self, partition: Hosts) -> Iterator[tuple]:
        module, _, name = self.options.get("collector", f"{__name__}:http").partition(":")
        collect = getattr(importlib.import_module(module), name)
        agents = json.loads(self.options.get("agents", "[]"))
        timeout, attempts, wait = float(self.options.get("timeout", "20")), int(self.options.get("attempts", "3")), float(self.options.get("backoff", "1"))
        for k, url in enumerate(partition.urls):
            headers = {"User-Agent": agents[k % len(agents)]} if agents else {}
            began, answer, error = time.monotonic(), None, None
            for attempt in range(1, max(1, attempts) + 1):
                if attempt > 1:
                    time.sleep(wait * 2 ** (attempt - 2))
                try:
                    answer, error = collect(url, headers, timeout), None
                except Exception as e:  # of any collector: the row tells
                    answer, error = None, f"{type(e).__name__}: {e}"
                    continue
                if answer.status not in AGAIN:
                    break
            took = (time.monotonic() - began) * 1000
            if answer is None:
                yield (url, url, None, None, {}, took, [], False, None, error, attempt)
                continue
            bad = f"http status {answer.status}" if answer.status >= 400 else None
            yield (url, answer.final_url, answer.status, answer.content, dict(answer.headers), took, list(answer.redirects), answer.status == 304, None, bad, attempt)


class CollectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collector"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CollectorReader(self.options)
