"""Look-ups against a canned service: refusals, unknown keys, failing batches, the cache, runs that broke off."""

import io
import json
import os
import urllib.error
import urllib.parse
import uuid
from email.message import Message

import pytest

from corvane.sources import lookups, service


def refused(url, code, wait=None):
    headers = Message()
    if wait is not None:
        headers["Retry-After"] = wait
    return urllib.error.HTTPError(url, code, "no", headers, io.BytesIO())


def asked(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("log-"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                out.append(f.read())
    return out


def serve(url, body, headers):
    """The endpoint is a folder: files in it say how the service behaves, and every request leaves one."""
    path, _, _ = url.partition("?")
    folder, _, last = path.rpartition("/")
    ids = json.loads(body)["ids"] if body else [urllib.parse.unquote(last)]
    assert headers["x-api-key"] == "k"
    with open(f"{folder}/log-{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
        f.write(("batch " if body else "single ") + ",".join(ids))
    if os.path.exists(f"{folder}/busy"):
        os.remove(f"{folder}/busy")
        raise refused(url, 429, "0")
    if os.path.exists(f"{folder}/broken") and len(asked(folder)) > 8:
        raise RuntimeError("gone")
    if body and os.path.exists(f"{folder}/nobatch"):
        raise refused(url, 500)
    known = {i: {"citationCount": len(i), "venue": "v", "tldr": {"text": "é"}} for i in ids if "u" not in i}
    if body:
        return json.dumps([known.get(i) for i in ids]).encode()
    if ids[0].endswith("bad"):
        raise refused(url, 503)
    if ids[0] not in known:
        raise refused(url, 404)
    return json.dumps(known[ids[0]]).encode()


def of(folder, **more):
    return lookups.Service(str(folder), "citationCount", "A:", size=2, pause=0, headers={"x-api-key": "k"}, fetch="tests.test_lookups.serve", **more)


def test_batches_refusals_and_the_cache(spark, tmp_path):
    svc, cache = tmp_path / "svc", f"{tmp_path}/cache"
    svc.mkdir()
    (svc / "busy").touch()
    keys = spark.createDataFrame([("1",), ("22",), ("u3",), ("1",), (None,)], "id string")
    got = {r["key"]: (r["answer"] and json.loads(r["answer"])["citationCount"], r["found"], r["error"]) for r in lookups.look_up(keys, "id", of(svc), cache, tasks=2).collect()}
    assert got == {"1": (3, True, None), "22": (4, True, None), "u3": (None, False, None)}
    n = len(asked(svc))
    assert not any(x.startswith("single") for x in asked(svc))
    more = spark.createDataFrame([("1",), ("u3",), ("new",)], "id string")
    assert lookups.look_up(more, "id", of(svc), cache).count() == 3
    assert asked(svc).count("batch A:new") == 1 and len(asked(svc)) == n + 1
    assert lookups.look_up(more, "id", of(svc), cache, max_age_hours=0).count() == 3 and len(asked(svc)) == n + 3
    papers = spark.createDataFrame([("1", 7), ("u3", 7), (None, 7)], "arxiv_id string, citations int")
    rows = {r["arxiv_id"]: (r["citations"], r["tldr"]) for r in lookups.enriched(papers, lookups.look_up(papers, "arxiv_id", of(svc), cache)).collect()}
    assert rows == {"1": (3, "é"), "u3": (0, None), None: (0, None)}
    assert lookups.purge(spark, cache, 1) == 0 and lookups.purge(spark, cache) == 1 and lookups.cached(spark, cache).count() == 0
    assert lookups.look_up(papers.limit(0), "arxiv_id", of(svc), f"{tmp_path}/none").count() == 0


def test_keys_of_a_failing_batch_are_asked_one_by_one(spark, tmp_path):
    (tmp_path / "nobatch").touch()
    keys = spark.createDataFrame([("1",), ("u2",), ("bad",)], "id string")
    got = {r["key"]: (r["found"], r["error"]) for r in lookups.look_up(keys, "id", of(tmp_path), f"{tmp_path}/cache").collect()}
    assert got["1"] == (True, None) and got["u2"] == (False, None) and got["bad"][0] is None and "503" in got["bad"][1]
    before = len(asked(tmp_path))
    os.remove(tmp_path / "nobatch")  # only the key with an error is asked again
    assert {r["key"]: r["found"] for r in lookups.look_up(keys, "id", of(tmp_path), f"{tmp_path}/cache").collect()} == {"1": True, "u2": False, "bad": True}
    assert len(asked(tmp_path)) == before + 1


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    (tmp_path / "broken").touch()
    keys = spark.createDataFrame([(str(i),) for i in range(40)], "id string")
    with pytest.raises(Exception, match="gone"):
        lookups.look_up(keys, "id", of(tmp_path), f"{tmp_path}/cache", per_round=10)
    kept = {r["key"] for r in lookups.cached(spark, f"{tmp_path}/cache").collect()}
    os.remove(tmp_path / "broken")
    assert kept and lookups.look_up(keys, "id", of(tmp_path), f"{tmp_path}/cache", per_round=10).count() == 40
    counts = [i for x in asked(tmp_path) for i in x.split(" ")[1].split(",")]
    assert all(counts.count(f"A:{k}") == 1 for k in kept)


FEED = "<feed xmlns='http://www.w3.org/2005/Atom'>{}</feed>"


def pages(url):
    q = urllib.parse.parse_qs(urllib.parse.urlparse(url).query)
    at = int(q["start"][0])
    if at == 2 or "gone" in q["search_query"][0]:
        raise OSError("page lost")
    rows = "".join(f"<entry><id>http://arxiv.org/abs/p{k}</id><published>2020-01-01T00:00:00Z</published></entry>" for k in range(at, min(at + 2, 5)))
    return FEED.format(rows).encode()


def test_pages_left_out_are_told(spark, tmp_path):
    spark.dataSource.register(service.PaperSource)
    ask = {"endpoint": "http://feed", "categories": "a,gone", "spans": "1/2", "pagesize": "2", "pause": "0", "fetch": "tests.test_lookups.pages"}
    lost = spark.read.format("papers").options(**ask, skipfailed="true", failures=f"{tmp_path}/failed").load()
    assert sorted(r["arxiv_id"] for r in lost.collect()) == ["p0", "p1", "p4"]
    rows = {(r["category"], r["at"]): r["span_ended"] for r in service.failed_pages(spark, f"{tmp_path}/failed").collect()}
    assert rows == {("a", 2): False, ("gone", 0): False, ("gone", 2): False, ("gone", 4): True}
    assert service.failed_pages(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="needs a folder"):
        spark.read.format("papers").options(**ask, skipfailed="true").load().count()
