"""Paged REST listings as a Python data source (off unless registered), and work by keys that can be stopped and resumed."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import kmers
from . import readers


def page(url: str, timeout: float) -> dict:
    with urlopen(url, timeout=timeout) as response:
        return json.load(response)


class PagedJson(DataSource):
    """Entries of ``results`` of a JSON listing, a row of text each.

    Options: url (first page); pages, if their number is known, with {page} in url for numbers from 1 on: then each page is a
    partition; else the ``next`` links are followed by one task. timeout in seconds. Register with
    ``spark.dataSource.register(PagedJson)``."""

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.pages, self.timeout = options["url"], int(options.get("pages", 0)), float(options.get("timeout", 30))

    def partitions(self):
        return [InputPartition(self.url.replace("{page}", str(i + 1))) for i in range(max(1, self.pages))]

    def read(self, partition):
        url = partition.value
        while url:
            found = page(url, self.timeout)
            for entry in found.get("results", []):
                yield (json.dumps(entry),)
            url = None if self.pages else found.get("next")


#: Writes of a run at most.
WRITES = 16


def resume(wanted: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], batch: int = 100, most: int | None = None) -> DataFrame:
    """The rows of work for the wanted keys, kept in a table at path: (key, ..., error) without those that failed.

    wanted: (key, ord, ...); of a key, the row that came first. work gives each row of its input one row, with the reason in
    error if it failed. About ``batch`` keys are worked at a time and appended as one write of Spark's, or more where that would
    be over WRITES writes, so that what a write costs beside its work doesn't grow with the keys. A run that is
    stopped loses one batch at most: the next one takes what has no row without an error. Failures are set aside as rows with
    the error and tried once a run. most: rows without an error that the table may come to, the first by ord."""
    spark = wanted.sparkSession
    named = wanted.where(F.col(key).isNotNull())
    schema = work(named.limit(0)).schema
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    kept = lambda: spark.read.schema(schema).parquet(path).where("error is null")
    done = kept().select(key).distinct()  # of the files that are there now
    # Keys are chosen before the other columns come, which only the chosen ones need.
    todo = readers.pending(named.select(key, "ord"), done, key)
    if most is not None:
        todo = todo.limit(max(0, most - done.count()))
    todo = kmers.settled(todo.select(key))
    first = named.join(todo, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*[c for c in wanted.columns if c != key]), "ord").alias("_r")).select(key, "_r.*")
    left = kmers.settled(first)
    parts = min(WRITES, -(-todo.count() // batch))
    for i in range(parts):
        work(left.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)).write.mode("append").parquet(path)
    return kept().dropDuplicates([key])


def fetched(urls: DataFrame, key: str = "url", timeout: float = 30) -> DataFrame:
    """(url, value, error) of the addressed JSON, as text; work for :func:`resume`. An address that fails has its error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for url in pdf[key]:
                try:
                    rows.append((url, json.dumps(page(url, timeout)), None))
                except (OSError, ValueError) as error:  # no answer, or no JSON
                    rows.append((url, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[key, "value", "error"])

    return urls.select(key).mapInPandas(run, f"{key} string, value string, error string")
