"""WARC fixity: Merkle trees over records and ordered offset ranges, compared from the root down.

``records`` renders pages as WARC/1.1 response records and digests each. ``tree`` hashes the records of each offset
range, then each group of ``fan`` neighbouring ranges, up to one root for each archive. ``audit`` compares two replicas'
roots and, level by level, only the children of nodes that differ, so equal branches are never compared further down.

A record is known by its archive and offset, so ids may repeat. Offsets follow the order of id, then digest; they are
made of sums over (archive, id, first digits of the digest), so a hot archive, id or null id is never one task's window,
and equal records are counted before they get their offsets one after another.

Null url or html: as empty. Null id: archive null, one tree of its own, however large: trees are as high as they need be.
Very long pages: a range holds one record at least. Repeated ids: in order of their digests; repeated rows: one record each.
Empty tables: no rows. Other columns: never read. A record in one replica alone is ``missing`` (from the second) or ``extra``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import save

#: Ids in one archive file; equal records laid out by one task at a time; bytes in the lowest offset range; ranges under one node.
PER_ARCHIVE = 1_000
RUN = 1_000
RANGE_BYTES = 1 << 16
FAN = 8


def record(url: Column, html: Column) -> Column:
    """A page as a response record, payload and trailer included."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", per_archive: int = PER_ARCHIVE, also: dict[str, Column] | None = None) -> DataFrame:
    """archive, id, length and sha256 of each page's record; contents are digested in the scan and not shuffled.

    also: names of digests of the same pages' records with other contents in html's place.
    """
    also = also or {}
    out = pages.select(F.col(id_column).alias("id"), record(F.col(url), F.col(html)).alias("r"), *[record(F.col(url), c).alias(k) for k, c in also.items()])
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select(F.expr(f"id div {per_archive}").alias("archive"), "id", F.octet_length("r").cast("long").alias("length"), digest("r").alias("digest"), *[digest(k).alias(k) for k in also])


def with_offsets(recs: DataFrame) -> DataFrame:
    """Where each record begins in its archive, records standing in order of id, then digest; the other columns stay."""
    others = [c for c in recs.columns if c not in ("archive", "id", "digest", "length")]
    # Equal records are one row with a count; a third of all rows may be such copies.
    groups = recs.groupBy("archive", "id", "digest", "length", *others).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.substring("digest", 1, 3))
    groups = save(groups, "records")
    sums = groups.groupBy("archive", "id", "part").agg(F.sum(F.col("n") * F.col("length")).alias("bytes"))
    ids = sums.groupBy("archive", "id").agg(F.sum("bytes").alias("bytes"))
    before = lambda *by: F.coalesce(F.sum("bytes").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ids.select(F.col("archive").alias("ia"), F.col("id").alias("ii"), before("archive", "id").alias("id_at"))
    parts = sums.select(F.col("archive").alias("pa"), F.col("id").alias("pi"), F.col("part").alias("pp"), before("archive", "id", "part").alias("part_at"))
    parts = parts.join(starts, F.col("pa").eqNullSafe(F.col("ia")) & F.col("pi").eqNullSafe(F.col("ii"))).select("pa", "pi", "pp", (F.col("id_at") + F.col("part_at")).alias("base"))
    at = F.coalesce(F.sum(F.col("n") * F.col("length")).over(W.partitionBy("archive", "id", "part").orderBy("digest", *others).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = groups.withColumn("within", at).join(parts, F.col("archive").eqNullSafe(F.col("pa")) & F.col("id").eqNullSafe(F.col("pi")) & (F.col("part") == F.col("pp")))
    runs = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    rows = runs.repartition("archive", "id", "digest", "from").withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN, F.col("n")) - 1)))
    return rows.select("archive", "id", "length", "digest", *others, (F.col("base") + F.col("within") + F.col("k") * F.col("length")).alias("offset"))


def height(most: int, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> int:
    """Levels above the lowest that bring offsets up to ``most`` under one root."""
    nodes, levels = most // range_bytes, 1
    while nodes >= fan:
        nodes, levels = nodes // fan, levels + 1
    return levels


def tree(recs: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Saved levels of nodes (archive, node, hash), lowest first; node numbers are offset // (range_bytes * fan**level).

    The last level is the root: one node for each archive.
    """
    leaf = recs.withColumn("node", F.expr(f"offset div {range_bytes}"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "id", "digest"))), lambda x: F.concat_ws(":", x["offset"].cast("string"), x["digest"])), "\n")
    out = [save(leaf.groupBy("archive", "node").agg(F.sha2(ordered.cast("binary"), 256).alias("hash")), "leaves")]
    for level in range(1, levels + 1):
        up = F.expr(f"node div {fan}") if level < levels else F.lit(0).cast("long")
        inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), "\n")
        out.append(save(out[-1].groupBy("archive", up.alias("up")).agg(F.sha2(inner.cast("binary"), 256).alias("hash")).withColumnRenamed("up", "node"), "nodes"))
    return out


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Records that differ between replicas: archive, id, offset, digest, replica_digest, status.

    first, second: rows (archive, id, offset, length, digest), saved tables; offsets are those of the manifest.
    """
    most = first.select("offset").unionByName(second.select("offset")).agg(F.max("offset")).first()[0]
    levels = height(most or 0, range_bytes, fan)
    a, b = tree(first, levels, range_bytes, fan), tree(second, levels, range_bytes, fan)
    frontier = None
    for level in range(levels, -1, -1):
        x, y = a[level].withColumnRenamed("hash", "hash_a"), b[level].withColumnRenamed("hash", "hash_b")
        if frontier is not None:
            up = F.expr(f"node div {fan}") if level + 1 < levels else F.lit(0).cast("long")
            parents = frontier.select(F.col("archive").alias("pa"), F.col("node").alias("pn"))
            x, y = (t.withColumn("pn_", up).join(parents, F.col("archive").eqNullSafe(F.col("pa")) & (F.col("pn_") == F.col("pn")), "left_semi").drop("pn_") for t in (x, y))
        y = y.select(F.col("archive").alias("archive_b"), F.col("node").alias("node_b"), "hash_b")
        both = x.join(y, F.col("archive").eqNullSafe(F.col("archive_b")) & (F.col("node") == F.col("node_b")), "full_outer")
        both = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        # A node of one replica alone has nulls on the other side, archive among them: take what is there.
        there = F.col("hash_a").isNotNull()
        frontier = save(both.select(F.when(there, F.col("archive")).otherwise(F.col("archive_b")).alias("archive"), F.coalesce("node", "node_b").alias("node")), f"differ-{level}")
    at = frontier.select(F.col("archive").alias("pa"), F.col("node").alias("pn"))
    inside = [t.join(at, F.col("archive").eqNullSafe(F.col("pa")) & (F.expr(f"offset div {range_bytes}") == F.col("pn")), "left_semi") for t in (first, second)]
    y = inside[1].select(F.col("archive").alias("archive_b"), F.col("id").alias("id_b"), F.col("offset").alias("offset_b"), F.col("digest").alias("replica_digest"))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in ("archive", "id", "offset")])
    found = inside[0].select("archive", "id", "offset", "digest").join(y, same, "full_outer").where(~F.col("digest").eqNullSafe(F.col("replica_digest")))
    here, there = F.col("digest").isNotNull(), F.col("replica_digest").isNotNull()
    return found.select(
        *(F.when(here, F.col(c)).otherwise(F.col(f"{c}_b")).alias(c) for c in ("archive", "id", "offset")),
        "digest",
        "replica_digest",
        F.when(here & there, "corrupt").when(here, "missing").otherwise("extra").alias("status"),
    )
