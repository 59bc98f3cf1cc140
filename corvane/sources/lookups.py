"""Look-ups of keys at a service, with a cache table: batches of keys are asked for on the executors and kept round by round.

Keys that the cache answers, also with "not known", aren't asked again until their answer is too old. The rest go in rounds;
a round's answers are appended to the cache before the next one starts, so a run that breaks off, or loses executors, goes on
where it was. In a round keys are dealt over ``tasks`` tasks, each of which waits ``tasks`` times the pause between two
requests, so that the service sees one rate. A refusal with status 429 waits as long as the service says. Where a batch
fails for good its keys are asked one by one; a key whose own request fails gets its error in its row, and is asked again
in the next run. Null keys are left out, repeated keys are asked once; no keys: no request, an empty result.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.macros import cut

CACHE = "key string, answer string, found boolean, error string, fetched_at timestamp"
#: What is asked of a paper; the type that its answer is read with.
PAPER = "citationCount long, influentialCitationCount long, referenceCount long, fieldsOfStudy array<string>, venue string, year int, tldr struct<text:string>"
AUTHOR = "authorId string, name string, paperCount long, citationCount long, hIndex long"


def urlopen(url: str, body: bytes | None, headers: dict[str, str]) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=60) as r:
        return r.read()


def waiting(error: OSError, pause: float, attempt: int) -> float:
    """Seconds before the next attempt: what a refusal asks for, else twice as long each time."""
    asked = error.headers.get("Retry-After") if isinstance(error, urllib.error.HTTPError) and error.code == 429 and error.headers else None
    return float(asked) if asked and asked.isdigit() else pause * 2**attempt


@dataclass(frozen=True)
class Service:
    """A service that answers POST endpoint/batch {"ids": [...]} with a list in the same order, null for ids it doesn't know,
    and GET endpoint/id with one object or status 404. ``fetch`` is the dotted name of a function (url, body, headers) -> bytes.
    """

    endpoint: str
    fields: str
    prefix: str = ""
    size: int = 100
    pause: float = 1.0
    tries: int = 3
    headers: dict[str, str] = field(default_factory=dict)
    fetch: str = f"{__name__}.urlopen"

    def ask(self, url: str, body: bytes | None, pause: float):
        module, name = self.fetch.rsplit(".", 1)
        fetch = getattr(importlib.import_module(module), name)
        for i in range(self.tries):
            time.sleep(pause)
            try:
                return json.loads(fetch(url, body, {"Content-Type": "application/json", **self.headers}))
            except OSError as e:
                if i == self.tries - 1 or isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429:
                    raise
                time.sleep(waiting(e, pause, i))
        raise AssertionError

    def batch(self, keys: list[str], pause: float) -> list[tuple]:
        """(key, answer, found, error) of some keys."""
        query = urllib.parse.urlencode({"fields": self.fields})
        try:
            got = self.ask(f"{self.endpoint}/batch?{query}", json.dumps({"ids": [self.prefix + k for k in keys]}).encode(), pause)
            if len(got) != len(keys):
                raise OSError(f"{len(got)} answers to {len(keys)} ids")
            return [(k, None if a is None else json.dumps(a, ensure_ascii=False), a is not None, None) for k, a in zip(keys, got, strict=True)]
        except (OSError, ValueError):
            return [self.single(k, query, pause) for k in keys]

    def single(self, key: str, query: str, pause: float) -> tuple:
        try:
            return (key, json.dumps(self.ask(f"{self.endpoint}/{urllib.parse.quote(self.prefix + key, safe=':')}?{query}", None, pause), ensure_ascii=False), True, None)
        except (OSError, ValueError) as e:
            gone = isinstance(e, urllib.error.HTTPError) and e.code == 404
            return (key, None, False if gone else None, None if gone else f"{type(e).__name__}: {e}"[:500])


def look_up(keys: DataFrame, key: str, service: Service, cache: str, tasks: int = 1, per_round: int = 10_000, max_age_hours: float = 24.0) -> DataFrame:
    """(key, answer, found, error, fetched_at) of every distinct key; answer is JSON. The cache is a folder of Parquet by day."""
    spark = keys.sparkSession
    since = spark.range(1).select((F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600.0))).alias("t")).first()["t"]
    asked = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    young = lambda: cached(spark, cache).where(F.col("fetched_at") >= F.lit(since))
    left = cut(asked.join(young().where("error is null").select("key"), "key", "left_anti"))
    rounds = -(-left.count() // per_round)

    def ask(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        pause = service.pause * tasks
        time.sleep(service.pause * (TaskContext.get().partitionId() % tasks))
        held: list[str] = []

        def rows(some):
            got = pd.DataFrame(service.batch(some, pause), columns=["key", "answer", "found", "error"])
            return got.assign(found=got["found"].astype("boolean"))

        for f in frames:
            held += f["key"].tolist()
            while len(held) >= service.size:
                yield rows(held[: service.size])
                held = held[service.size :]
        if held:
            yield rows(held)

    for i in range(rounds):
        part = left.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == i).repartition(tasks)
        got = part.mapInPandas(ask, CACHE.rsplit(",", 1)[0]).withColumn("fetched_at", F.current_timestamp()).withColumn("day", F.to_date("fetched_at"))
        got.write.mode("append").partitionBy("day").parquet(cache)
    best = F.struct(F.col("error").isNull(), "fetched_at")
    newest = young().groupBy("key").agg(F.max_by(F.struct("answer", "found", "error", "fetched_at"), best).alias("r"))
    return asked.join(newest, "key").select("key", "r.*")


def _there(spark, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, path, fs.exists(path)


def cached(spark, cache: str) -> DataFrame:
    """All rows of a cache; none where it isn't there yet."""
    if not _there(spark, cache)[2]:
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE + ", day date").parquet(cache).drop("day")


def purge(spark, cache: str, older_than_days: int | None = None) -> int:
    """Delete a cache's days before so many days ago, or all; returns how many days went."""
    import datetime

    fs, path, there = _there(spark, cache)
    gone = 0
    today = datetime.datetime.now(datetime.UTC).date()
    for entry in fs.listStatus(path) if there else []:
        name = entry.getPath().getName()
        if name.startswith("day=") and (older_than_days is None or (today - datetime.date.fromisoformat(name[4:])).days > older_than_days):
            gone += bool(fs.delete(entry.getPath(), True))
    return gone


def enriched(papers: DataFrame, answers: DataFrame, id_column: str | Column = "arxiv_id") -> DataFrame:
    """Papers with what a look-up says of them; papers it doesn't know have no citations and nulls else."""
    a = answers.where("found").select(F.col("key").alias("__key"), F.from_json("answer", PAPER).alias("a"))
    new = {
        "citations": F.coalesce("a.citationCount", F.lit(0)), "influential_citations": F.col("a.influentialCitationCount"), "reference_count": F.col("a.referenceCount"),
        "fields_of_study": F.col("a.fieldsOfStudy"), "venue": F.nullif(F.col("a.venue"), F.lit("")), "tldr": F.col("a.tldr.text"),
    }
    own = F.col(id_column) if isinstance(id_column, str) else id_column
    return papers.drop(*new).withColumn("__key", own.cast("string")).join(a, "__key", "left").withColumns(new).drop("__key", "a")
