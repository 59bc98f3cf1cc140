"""A paged HTTP feed as a Spark data source, read on the executors: pages of every category and span of dates until one is short.

Options: endpoint; categories and spans (start/end), by commas; pagesize; pause, the seconds between two requests of all
tasks together; tasks, over which the spans are dealt (each then waits ``tasks`` times as long, so the service sees one
rate); maxresults, the most rows of a span (none: all); dated=false leaves the dates out of the query (filter afterwards);
skipfailed=true goes on with the next page where one fails for good, and leaves a row for it in the folder ``failures``, which it
needs (``failed_pages`` reads them); after three such pages in a row a span ends, and its last row says so. A refusal with
status 429 waits as long as the service asks.
``fetch`` is a module-level function of (url) -> bytes given by dotted name, so tests and sites without a network can
put their own in its place.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import re
import time
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .lookups import waiting

SCHEMA = "arxiv_id string, title string, abstract string, author_list array<string>, published string, category_list array<string>, primary_category string"
FAILED = "category string, start string, end string, at long, error string, span_ended boolean"
NS = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}


def urlopen(url: str) -> bytes:
    import urllib.request

    with urllib.request.urlopen(url, timeout=60) as r:
        return r.read()


class Spans(InputPartition):
    """Some (category, start, end), read one after the other."""

    def __init__(self, spans: list[tuple[str, str, str]]):
        self.spans = spans


class PaperReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        if self.options.get("skipfailed") == "true" and not self.options.get("failures"):
            raise ValueError("skipfailed needs a folder for failures")

    def partitions(self) -> list[Spans]:
        cats = self.options["categories"].split(",")
        spans = [s.split("/") for s in self.options["spans"].split(",")]
        every = [(c, a, b) for c in cats for a, b in spans]
        tasks = int(self.options.get("tasks", 1))
        return [Spans(every[i::tasks]) for i in range(tasks) if every[i::tasks]]

    def read(self, partition: Spans) -> Iterator[tuple]:
        for span in partition.spans:
            yield from self._span(*span)

    def _span(self, category: str, start: str, end: str) -> Iterator[tuple]:
        o = self.options
        module, name = o.get("fetch", f"{__name__}.urlopen").rsplit(".", 1)
        fetch = getattr(importlib.import_module(module), name)
        size, pause = int(o.get("pagesize", 100)), float(o.get("pause", 3)) * int(o.get("tasks", 1))
        most = int(o["maxresults"]) if o.get("maxresults") else None
        query = f"cat:{category}" + (f" AND submittedDate:[{start} TO {end}]" if o.get("dated", "true") == "true" else "")
        at = failed = 0
        while most is None or at < most:
            ask = size if most is None else min(size, most - at)
            url = o["endpoint"] + "?" + urllib.parse.urlencode({"search_query": query, "start": at, "max_results": ask, "sortBy": "submittedDate", "sortOrder": "descending"})
            at += size
            try:
                rows = list(parse(self._tries(fetch, url, pause), category))
            except OSError as e:
                if o.get("skipfailed", "false") != "true":
                    raise
                failed += 1
                ended = failed >= 3  # the service is gone, not one page
                _note(o["failures"], {"category": category, "start": start, "end": end, "at": at - size, "error": f"{type(e).__name__}: {e}", "span_ended": ended})
                if ended:
                    return
                continue
            yield from rows
            failed = 0
            if len(rows) < ask:
                return
            time.sleep(pause)

    def _tries(self, fetch, url: str, pause: float, most: int = 5) -> bytes:
        for i in range(most):
            try:
                return fetch(url)
            except OSError as e:
                if i == most - 1:
                    raise
                time.sleep(waiting(e, pause, i))
        raise AssertionError


def _note(folder: str, row: dict) -> None:
    """One failed page as a file of its own; a repeated task writes the same name again."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    files.create_dir(path, recursive=True)
    name = hashlib.sha256("/".join(str(row[k]) for k in ("category", "start", "end", "at")).encode()).hexdigest()[:32]
    with files.open_output_stream(f"{path}/{name}.json") as out:
        out.write(json.dumps(row).encode())


def failed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that a read with skipfailed left out; none where the folder isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FAILED)
    return spark.read.schema(FAILED).json(folder)


def parse(feed: bytes, category: str) -> Iterator[tuple]:
    """Rows of a feed's entries."""
    text = lambda e, p: " ".join((e.findtext(p, "", NS) or "").split())
    for e in ET.fromstring(feed).findall("a:entry", NS):
        cats = [c.get("term") for c in e.findall("a:category", NS)]
        primary = e.find("x:primary_category", NS)
        yield (re.sub(r"v\d+$", "", text(e, "a:id").rsplit("/abs/", 1)[-1]), text(e, "a:title"), text(e, "a:summary"), [text(a, "a:name") for a in e.findall("a:author", NS)], text(e, "a:published"), cats, primary.get("term") if primary is not None else category)


class PaperSource(DataSource):
    """spark.dataSource.register(PaperSource); spark.read.format("papers").option("endpoint", ...)"""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PaperReader:
        return PaperReader(self.options)
