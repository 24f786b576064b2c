"""Paged REST endpoints as a Python data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmere.session import written

SCHEMA = "endpoint string, data string, page int, error string"

FetchPage = Callable[[str, int, int], object]


def http_fetcher(base_url: str, headers: dict | None = None, params: dict | None = None) -> FetchPage:
    """Page fetcher over HTTP with the standard library."""

    def fetch(endpoint: str, page: int, limit: int) -> object:
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        query = urlencode({"page": page, "limit": limit, **(params or {})})
        url = f"{base_url.rstrip('/')}/{endpoint.lstrip('/')}?{query}"
        with urlopen(Request(url, headers=headers or {}), timeout=60) as response:
            return json.loads(response.read())

    return fetch


def page_records(body: object) -> list:
    """Records of one response: a list, or the list under ``data`` or
    ``results``, or the body itself."""
    if isinstance(body, dict):
        body = body.get("data", body.get("results", [body]))
    elif not isinstance(body, list):
        body = [body]
    return body or []


class _Stripe(InputPartition):
    """Every ``step``-th page of an endpoint, from ``first`` on."""

    def __init__(self, endpoint: str, first: int, step: int):
        self.endpoint, self.first, self.step = endpoint, first, step


class _PagesReader(DataSourceReader):
    def __init__(self, options):
        self.endpoints = json.loads(options["endpoints"])
        self.page_size = int(options.get("page_size", 100))
        self.stripes = int(options.get("stripes", 1))
        self.fetch = cloudpickle.loads(bytes.fromhex(options["fetch"]))

    def partitions(self):
        return [
            _Stripe(endpoint, first, self.stripes)
            for endpoint in self.endpoints
            for first in range(1, self.stripes + 1)
        ]

    def read(self, partition: _Stripe) -> Iterator[tuple]:
        page = partition.first
        while True:
            try:
                records = page_records(self.fetch(partition.endpoint, page, self.page_size))
            except Exception as problem:  # one endpoint's failure stops that endpoint only
                yield partition.endpoint, None, page, str(problem)
                return
            for record in records:
                yield partition.endpoint, json.dumps(record, ensure_ascii=False), page, None
            if len(records) < self.page_size:
                return
            page += partition.step


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmere_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options)


def scan_endpoints(
    spark: SparkSession, endpoints: list[str], fetch: FetchPage, page_size: int = 100, stripes: int = 1,
    extracted_at: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records and errors of paged endpoints.  Every page is fetched once: what
    came is written, and both results are read from there.

    ``stripes`` tasks share one endpoint, each taking every n-th page until
    it meets a short one.  Records past an endpoint's first failed page are
    dropped, as if the pages had been read one after the other.
    """
    spark.dataSource.register(PagesSource)
    rows = (
        spark.read.format("quillmere_pages")
        .option("endpoints", json.dumps(endpoints))
        .option("page_size", page_size)
        .option("stripes", stripes)
        .option("fetch", cloudpickle.dumps(fetch).hex())
        .load()
    )
    rows = written(rows, "pages")
    if extracted_at is not None:
        rows = rows.withColumn("extracted_at", F.lit(extracted_at))
    errors = rows.filter(F.col("error").isNotNull())
    records = rows.filter(F.col("error").isNull()).drop("error")
    if stripes > 1:
        failed = errors.groupBy("endpoint").agg(F.min("page").alias("_failed"))
        # failed has at most one row per configured endpoint
        records = (
            records.join(F.broadcast(failed), "endpoint", "left")
            .filter(F.col("_failed").isNull() | (F.col("page") < F.col("_failed")))
            .drop("_failed")
        )
    return records, errors.select("endpoint", "page", "error")
