"""Graphs as edge tables: co-authors, degrees, components, PageRank, lineage, betweenness, triangles and cliques.

Iterations keep edges and labels as tables; lineage is cut with checkpoint() in the cluster's shared folder.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import cut as _cut
from ..functions.macros import explode_pairs, small_batches, top, written


#: Papers whose pairs one task makes and counts.
TASK_PAPERS = 50_000


def coauthor_edges(papers: DataFrame, least: int = 1, array: str = "author_list") -> DataFrame:
    """(a, b, w): pairs of authors, a < b, by shared papers.

    The lists are written first, so that the tasks that make and count the pairs are as many as the papers ask for: a task's
    pairs stay as many however large the table is, and adaptive execution does not put them together.
    """
    lists = written(papers.where(F.size(array) > 1).select(array))
    tasks = max(papers.sparkSession.sparkContext.defaultParallelism, lists.count() // TASK_PAPERS + 1)
    pairs = explode_pairs(lists.repartition(tasks, F.xxhash64(array)), array)
    return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= least)


def strongest(edges: DataFrame, per_vertex: float) -> DataFrame:
    """The heaviest edges (a, b, w): all from the least weight on that leaves at most per_vertex * vertices edges.

    Where even the heaviest weight has more, all edges of that weight. The weight comes from a histogram, not from a sort.
    """
    edges = written(edges)
    nodes = edges.select("a").union(edges.select("b")).distinct().count()
    least = most = None
    total = 0
    for r in edges.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("w")).toLocalIterator():  # ends at the weight
        most, total = r["w"] if most is None else most, total + r["n"]
        if total > per_vertex * nodes:
            break
        least = r["w"]
    return edges.where(F.col("w") >= F.lit(most if least is None else least))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest reachable id of each vertex.

    Rounds of contraction: each vertex goes into that one of itself and its neighbours that a hash, another one each round, puts
    first; edges are led over and what became a loop or a copy goes. At most three quarters of the vertices are left on average,
    whatever the graph and the order of its ids, so that all rounds together move a few times the edges. Who went where is read backwards at the end.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not left.isEmpty():
        first = lambda c: F.xxhash64(c, F.lit(len(levels)))  # noqa: E731, B023  equal hashes are no harm: either is a neighbour
        near = both_ways(left).groupBy(F.col("a").alias("id")).agg(F.min_by("b", first("b")).alias("m"))
        went = written(near.select("id", F.when(first("m") < first("id"), F.col("m")).otherwise(F.col("id")).alias("m")))
        led = left.join(went.select(F.col("id").alias("a"), F.col("m").alias("x")), "a").join(went.select(F.col("id").alias("b"), F.col("m").alias("y")), "b")
        left = written(led.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        levels.append(went)
    if not levels:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    ends = levels.pop()
    for went in reversed(levels):
        ends = went.join(ends.select(F.col("id").alias("m"), F.col("m").alias("end")), "m", "left").select("id", F.coalesce("end", "m").alias("m"))
    ends = written(ends)
    return ends.join(ends.groupBy("m").agg(F.min("id").alias("component")), "m").select("id", "component")


def component_sizes(edges: DataFrame) -> DataFrame:
    """One row for the weak components of (src, dst): how many, the largest, how many vertices in all."""
    size = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return size.agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.sum("size").alias("nodes"))


def degree_spread(edges: DataFrame) -> DataFrame:
    """Least, greatest, mean and upper median of the in- and out-degrees of (src, dst), and whether it has no cycle."""
    d = degrees_both(edges)
    n = d.count()
    exact = lambda c: F.percentile(c, F.lit((n // 2) / max(1, n - 1)))  # noqa: E731  a histogram of degrees, not a sort
    parts = [f(c).alias(f"{k}_{c}") for c in ("in", "out") for k, f in (("min", F.min), ("max", F.max), ("avg", lambda c: F.round(F.avg(c), 4)), ("median", lambda c: F.round(exact(c)).cast("long")))]
    return d.agg(*parts).withColumn("is_dag", F.lit(is_acyclic(edges)))


def degrees_both(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))


def export(edges: DataFrame, papers: DataFrame) -> dict[str, DataFrame]:
    """Nodes with their degrees, and edges, as tables to write."""
    nodes = degrees_both(edges).join(papers.select(F.col("arxiv_id").alias("id"), "primary_category", "citations"), "id", "left")
    return {"nodes": nodes, "edges": edges}


def citation_bridges(edges: DataFrame, papers: DataFrame, n: int = 50, sources: int | None = 500, separator: str = ".") -> DataFrame:
    """Papers on many shortest paths: betweenness times 1 + 0.1 for each top-level category among the neighbours."""
    label = papers.select(F.col("arxiv_id").alias("far"), F.explode(F.transform("category_list", lambda x: F.substring_index(x, separator, 1))).alias("top"))
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("far")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("far")))
    kinds = near.join(label, "far").groupBy("id").agg(F.count_distinct("top").alias("diversity"))
    out = directed_betweenness(edges, sources).where("betweenness > 0").join(kinds, "id", "left").na.fill(0, ["diversity"])
    out = out.select(F.col("id").alias("arxiv_id"), F.round("betweenness", 6).alias("betweenness"), "diversity", F.round(F.col("betweenness") * (1 + 0.1 * F.col("diversity")), 6).alias("score"))
    return top(out, n, F.desc("score"), F.asc("arxiv_id"))


def network_stats(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    n, total = F.count(F.lit(1)), F.sum("degree")
    return d.agg(n.alias("nodes"), (total / 2).cast("long").alias("edges"), F.round(F.avg("degree"), 4).alias("avg_degree"), F.max("degree").alias("max_degree"), F.round(total / (n * (n - 1)), 6).alias("density"))


def clusters(edges: DataFrame, papers: DataFrame, least: int = 3) -> DataFrame:
    """Components of at least ``least`` authors: size, internal edges, cohesion."""
    comp = components(edges)
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    inside = edges.join(comp.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("internal"))
    out = size.join(inside, "component").where(F.col("size") >= least)
    return out.select("component", "size", "internal", F.round(2 * F.col("internal") / (F.col("size") * (F.col("size") - 1)), 4).alias("cohesion"))


def team_metrics(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Team size of each paper and how connected its authors are."""
    rows = papers.select("arxiv_id", F.explode(F.array_distinct("author_list")).alias("id")).join(degrees(edges), "id", "left").na.fill(0, ["degree"])
    return rows.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("team_size"), F.sum("degree").alias("team_connections"))


def collaboration(papers: DataFrame, key: str = "primary_category") -> DataFrame:
    """Mean team size and share of solo papers by category and year."""
    team = F.size(F.array_distinct("author_list"))
    rows = papers.where(F.col("author_list").isNotNull()).select(key, "year", team.alias("t"))
    return rows.groupBy(key, "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("t"), 4).alias("avg_team"), F.round(F.avg((F.col("t") == 1).cast("double")), 4).alias("solo_rate"))


def category_bridges(papers: DataFrame, n: int = 50, array: str = "category_list", separator: str = ".") -> DataFrame:
    """Papers over many categories: twice the prefixes, the labels, and one more if there are several prefixes."""
    k = F.size(F.array_distinct(F.transform(array, lambda x: F.substring_index(x, separator, 1))))
    m = F.size(array)
    rows = papers.where(F.col(array).isNotNull()).select("arxiv_id", (2 * k + m + (k > 1).cast("int")).alias("score"))
    return top(rows, n, F.desc("score"), F.asc("arxiv_id"))


def citation_edges(papers: DataFrame, references: str = "references", citing: str | None = None) -> DataFrame:
    """Distinct (src cites dst) inside the corpus, from lists of references and of citing papers."""
    out = papers.select(F.col("arxiv_id").alias("src"), F.explode(references).alias("dst"))
    if citing:
        out = out.unionByName(papers.select(F.explode(citing).alias("src"), F.col("arxiv_id").alias("dst")))
    inside = papers.select("arxiv_id").distinct()
    out = out.join(inside.withColumnRenamed("arxiv_id", "src"), "src", "left_semi").join(inside.withColumnRenamed("arxiv_id", "dst"), "dst", "left_semi")
    return out.where("src <> dst").select("src", "dst").distinct()


def foundational(edges: DataFrame, papers: DataFrame, n: int = 50) -> DataFrame:
    """Papers most cited inside the corpus, with the ratio to all their citations."""
    inner = edges.groupBy(F.col("dst").alias("arxiv_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = inner.join(papers.select("arxiv_id", "citations"), "arxiv_id", "left")
    out = out.select("arxiv_id", "in_degree", F.round(F.col("in_degree") / F.greatest(F.coalesce("citations", F.lit(0)), F.lit(1)), 3).alias("ratio"))
    return top(out, n, F.desc("in_degree"), F.asc("arxiv_id"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, tol: float | None = None) -> DataFrame:
    """PageRank with the rank of sinks spread evenly; a fixed number of rounds, or until the change is below tol * n.

    Ranks keep their vertex's number of edges and are written each round: a round reads them twice, for the shares along the
    edges and for the sinks, and its plan would else hold all rounds before it twice.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    nodes = _cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(out, "id", "left"))
    n = max(nodes.count(), 1)
    ranks = nodes.withColumn("r", F.lit(1.0 / n))
    for _ in range(rounds):
        sinks = ranks.where("k is null").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("s"))
        shares = ranks.where("k is not null").select(F.col("id").alias("src"), (F.col("r") / F.col("k")).alias("share"))
        got = edges.join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("g"))
        spread = nodes.join(got, "id", "left").crossJoin(F.broadcast(sinks))  # one row
        new = written(spread.select("id", "k", (alpha * (F.coalesce("g", F.lit(0.0)) + F.col("s") / n) + (1 - alpha) / n).alias("r")))
        change = new.join(ranks.select("id", F.col("r").alias("old")), "id").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] if tol is not None else None
        ranks = new
        if tol is not None and (change is None or change < tol * n):
            break
    return ranks.select("id", F.col("r").alias("pagerank"))


def lineage(edges: DataFrame, start, depth: int = 5, forward: bool = True) -> DataFrame:
    """Vertices reachable from one within a depth, each at its least depth (forward: what it cites)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    spark = edges.sparkSession
    seen = frontier = spark.range(1).select(F.lit(start).cast(dict(edges.dtypes)[a]).alias("id"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        step = edges.join(F.broadcast(frontier.select(F.col("id").alias(a))) if d == 1 else frontier.select(F.col("id").alias(a)), a).select(F.col(b).alias("id")).distinct()
        frontier = _cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def lineage_roots(edges: DataFrame, start) -> DataFrame:
    """What a vertex leads back to at any depth: reachable vertices that are cited and cite nothing."""
    ends = edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    return lineage(edges, start, depth=2**31 - 1).select("id").join(ends, "id", "left_semi")


def direct(edges: DataFrame, vertex, n: int = 20) -> DataFrame:
    """(direction, id): the first references and citations of a vertex, by id."""
    own = F.lit(vertex)
    refs = top(edges.where(F.col("src") == own).select(F.lit("references").alias("direction"), F.col("dst").alias("id")).distinct(), n, F.asc("id"))
    return refs.unionByName(top(edges.where(F.col("dst") == own).select(F.lit("citations").alias("direction"), F.col("src").alias("id")).distinct(), n, F.asc("id")))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Vertices, edges, density, mean and largest in-degree, sinks and sources."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("id").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))
    n = F.count(F.lit(1))
    return d.agg(n.alias("nodes"), F.sum("out").alias("edges"), F.round(F.sum("out") / (n * (n - 1)), 8).alias("density"), F.max("in").alias("max_in"), F.max("out").alias("max_out"), F.count_if(F.col("in") == 0).alias("sources"), F.count_if(F.col("out") == 0).alias("sinks"))


def is_acyclic(edges: DataFrame) -> bool:
    """Peel vertices that nothing points to, or that point to nothing, until none or only cycles are left."""
    left, n = edges, edges.count()
    while n:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = _cut(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, left.count()
        if n == before:
            return False
    return True


def _upward(edges: DataFrame, d: DataFrame | None = None) -> DataFrame:
    """(u, v): each edge from its vertex of lower degree (ties: id), so that no vertex has over sqrt(2 m) edges out, hubs least."""
    d = degrees(edges) if d is None else d
    e = edges.select("a", "b").join(d.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))


def _closed(o: DataFrame) -> DataFrame:
    """(u, v, w): triangles, in the order of the edges (u, v)."""
    wedge = o.join(o.withColumnRenamed("v", "w"), "u").where("v <> w").select("u", "v", "w")
    return wedge.join(o.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"]).select("u", "v", "w")


#: Edges that one task of the triangles holds, about; colours that are taken even where fewer would do, for tasks enough; vertices
#: whose degrees are broadcast; edges that are packed at once.
TASK_EDGES, LEAST_COLOURS, KNOWN_VERTICES, PACKED_EDGES = 4_000_000, 6, 200_000, 1_000_000


def triangles(edges: DataFrame) -> DataFrame:
    """Cliques of three (a < b < c).

    Vertices have colours by hash; a task holds the edges among three colours and finds the triangles of just these, so that no
    wedge is shuffled and each triangle is found once. An edge is sent to as many tasks as there are colours, which grow with the
    root of the edges, so edges are packed first, some bytes each, where they lie. Ids that are no whole numbers go by joins.
    """
    e = written(edges.where("a <> b").select("a", "b"))
    if {t for _, t in e.dtypes} - {"tinyint", "smallint", "int", "bigint"}:
        s = F.array_sort(F.array("u", "v", "w"))
        return _closed(written(_upward(e).distinct())).select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c")).distinct()
    m, kind = e.count(), e.schema["a"].dataType
    colours = max(1, math.ceil(math.sqrt(9 * m / TASK_EDGES)), min(LEAST_COLOURS, m // 10_000))
    colour = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(colours)).cast("int")
    known = written(degrees(e))
    o = _upward(e, F.broadcast(known) if known.count() <= KNOWN_VERTICES else known)
    small_batches(e.sparkSession, 16_000_000)
    packed = o.select(F.col("u").cast("long"), F.col("v").cast("long"), colour("u").alias("i"), colour("v").alias("j")).mapInArrow(_packed, "i int, j int, data binary")
    key = F.array_sort(F.array("i", "j", "k"))
    sent = packed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))).select(((key[0] * colours + key[1]) * colours + key[2]).alias("key"), "i", "j", "data")
    tasks = min(colours * (colours + 1) * (colours + 2) // 6, 4_096)
    found = sent.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _triangles_by_key(batches, colours), "a long, b long, c long")
    return found.select(*[F.col(c).cast(kind) for c in "abc"])


def _packed(batches):
    """Arrow batches of (i, j, data), the edges of two colours packed, for batches of (u, v, i, j)."""
    import numpy as np
    import pyarrow as pa

    def rows(held):
        u, v, i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((v, u, j, i))
        u, v, i, j = (c[order] for c in (u, v, i, j))
        cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1), len(u)]
        data = [_pack(u[s:e]) + _pack(v[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.record_batch([pa.array(i[cuts[:-1]], pa.int32()), pa.array(j[cuts[:-1]], pa.int32()), pa.array(data, pa.binary())], names=["i", "j", "data"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(x).to_numpy().copy() for x in range(4)])
            n += batch.num_rows
        if n >= PACKED_EDGES:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def _pack(ids) -> bytes:
    """Steps from number to number, their bytes by place, deflated; before them how many bytes that is."""
    import zlib

    import numpy as np

    steps = np.diff(ids, prepend=np.int64(0))  # wraps around at the ends of the range, and back when summed
    steps = ((steps << 1) ^ (steps >> 63)).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(steps.max()) < 1 << 8 * w)
    data = zlib.compress(np.ascontiguousarray(steps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 1)
    return len(data).to_bytes(4, "little") + bytes([width]) + data


def _unpack(data: bytes) -> list:
    """The arrays that were packed one after the other."""
    import zlib

    import numpy as np

    out, at = [], 0
    while at < len(data):
        size, width = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
        steps = np.frombuffer(zlib.decompress(data[at + 5 : at + 5 + size]), np.uint8).reshape(width, -1)
        steps = np.ascontiguousarray(steps.T).view(f"<u{width}").ravel().astype(np.uint64)
        out.append(np.cumsum((steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64)))
        at += 5 + size
    return out


def _triangles_by_key(batches, colours: int):
    """Arrow batches of (a, b, c) for batches of (key, i, j, data) in the order of key."""
    now, held = None, []
    for batch in batches:
        for key, i, j, data in zip(*[batch.column(x).to_pylist() for x in range(4)], strict=True):
            if now is not None and key != now:
                yield from _triangles_of(now, held, colours)
                held = []
            now = key
            held.append((i, j, data))
    if held:
        yield from _triangles_of(now, held, colours)


def _triangles_of(key: int, packed: list, colours: int, rows: int = 500_000):
    """The triangles of three colours: for each vertex, the later neighbours of its later neighbours that are its own too."""
    import numpy as np
    import pyarrow as pa

    edges = [_unpack(data) for _, _, data in packed]
    u, v = (np.concatenate([e[k] for e in edges]) for k in range(2))
    names = np.unique(np.concatenate([u, v]))
    place = lambda ids: np.searchsorted(names, ids).astype(np.int32)
    shade = np.empty(len(names), np.int32)
    for (i, j, _), (x, y) in zip(packed, edges, strict=True):
        shade[place(x)], shade[place(y)] = i, j
    pair = np.unique(place(u).astype(np.int64) * len(names) + place(v))  # each edge once, in the order of u
    del edges, u, v
    first, second = (pair // len(names)).astype(np.int32), (pair % len(names)).astype(np.int32)
    del pair
    begin = np.searchsorted(first, np.arange(len(names) + 1))
    size = np.diff(begin)
    # Of three colours x, x, z edges inside x make triangles of x alone too, which belong to another task.
    x, y, z = int(key) // (colours * colours), int(key) // colours % colours, int(key) % colours
    odd = (z if x == y else x) if (x == y) != (y == z) else None
    mark = np.zeros(len(names), bool)
    bits = len(names).bit_length()
    out, n = [], 0

    def batch():
        lo, mid, hi = (np.concatenate([o[k] for o in out]) for k in range(3))
        if 3 * bits < 64:  # in order they take less room in a file
            whole = np.sort(lo << 2 * bits | mid << bits | hi)
            lo, mid, hi = whole >> 2 * bits, whole >> bits & (1 << bits) - 1, whole & (1 << bits) - 1
        return pa.record_batch([pa.array(names[p]) for p in (lo, mid, hi)], names=["a", "b", "c"])

    for s in np.flatnonzero(size > 1):
        own = second[begin[s] : begin[s + 1]]
        n_far = size[own]
        total = int(n_far.sum())
        if not total:
            continue
        mark[own] = True
        starts = np.repeat(begin[own] - (np.cumsum(n_far) - n_far), n_far)
        w = second[starts + np.arange(total)]
        hit = np.flatnonzero(mark[w])
        mark[own] = False
        if not len(hit):
            continue
        w, b = w[hit], np.repeat(own, n_far)[hit]
        if odd is not None:
            keep = (shade[s] == odd) | (shade[b] == odd) | (shade[w] == odd)
            w, b = w[keep], b[keep]
        # Places in names are in the order of ids.
        least, most = np.minimum(b, w).astype(np.int64), np.maximum(b, w).astype(np.int64)
        out.append((np.minimum(least, s), np.maximum(least, np.minimum(most, s)), np.maximum(most, s)))
        n += len(w)
        if n >= rows:
            yield batch()
            out, n = [], 0
    if n:
        yield batch()


def maximal_cliques(edges: DataFrame, least: int = 3, schema: str = "clique array<long>") -> DataFrame:
    """Maximal cliques of at least ``least`` (three or more) vertices.

    Vertices are ordered by degree. A task holds a vertex's later neighbours and the edges among them, which are its
    triangles; a hub's many small neighbours come before it and aren't sent. What is maximal there may still have an earlier
    vertex next to all of it: candidates are those in a triangle with its first two vertices, kept if joined to the rest.
    """
    import pandas as pd

    if least < 3:
        raise ValueError("least must be 3 or more")
    o = written(_upward(edges).distinct())
    tri = written(_closed(o))

    def search(key, pdf):
        first, order = key[0], set(zip(pdf["v"], pdf["w"], strict=True))
        adj: dict = {}
        for v, w in order:
            adj.setdefault(v, set()).add(w)
            adj.setdefault(w, set()).add(v)
        found, stack = [], [(set(), set(adj), set())]
        while stack:
            r, p, x = stack.pop()
            if not p and not x and len(r) + 1 >= least:
                found.append([first, *sorted(r, key=lambda m: sum((k, m) in order for k in r))])
            elif p:
                pivot = max(p | x, key=lambda m: len(adj[m] & p))
                for m in list(p - adj[pivot]):
                    stack.append((r | {m}, p & adj[m], x & adj[m]))
                    p = p - {m}
                    x = x | {m}
        return pd.DataFrame({"clique": pd.Series(found, dtype=object)})

    found = written(tri.groupBy("u").applyInPandas(search, schema))
    near = found.join(tri.select(F.col("u").alias("x"), "v", "w"), (F.col("clique")[0] == F.col("v")) & (F.col("clique")[1] == F.col("w"))).select("clique", "x")
    rest = near.select("clique", F.col("x").alias("u"), F.explode(F.expr("slice(clique, 3, size(clique) - 2)")).alias("v"))
    covered = rest.join(o, ["u", "v"]).groupBy("clique", "u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("clique") - 2)
    return found.join(covered.select("clique").distinct(), "clique", "left_anti").select(F.array_sort("clique").alias("clique"))


#: A component is searched inside a task if it has at most so many steps, or else at most so many vertices and is dense; so many
#: numbers of a search (sources times vertices) are held at once, and so many (sources times steps) are one task's work.
HELD_STEPS, HELD_VERTICES, HELD_NUMBERS, TASK_WORK = 8_000_000, 32_768, 2_000_000, 20_000_000_000
#: Times a step read from a list costs what a place of a dense matrix does.
DENSE = 32


def betweenness(edges: DataFrame, sources: int | None = None, seed: int = 42) -> DataFrame:
    """Betweenness of an undirected graph (a, b): from all sources, or a seeded sample.

    A shortest path stays in its component. One that a task can hold is searched there from blocks of sources by array operations;
    each of its tasks gets the component's edges, and they are as many as its work asks for. Larger components, and ids that are no
    whole numbers, go by tables; see ``paths_through``.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if {t for _, t in edges.dtypes} - {"tinyint", "smallint", "int", "bigint"}:
        return paths_through(_cut(both_ways(edges)), sources, seed)
    comp = components(edges)
    place = F.row_number().over(W.partitionBy("component").orderBy("id")) - 1
    nodes = written(comp.select("id", "component", place.alias("place")))
    n = nodes.count()
    src = nodes if sources is None or sources >= n else written(nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sources))
    led = edges.join(nodes.select(F.col("id").alias("a"), "component", F.col("place").alias("i")), "a").join(nodes.select(F.col("id").alias("b"), F.col("place").alias("j")), "b")
    led = written(led)
    size = led.groupBy("component").agg((2 * F.count(F.lit(1))).alias("steps")).join(nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    size = size.join(src.groupBy("component").agg(F.count(F.lit(1)).alias("asked")), "component").where("n > 2")
    dense = (F.col("n") <= HELD_VERTICES) & (F.col("n") * F.col("n") <= DENSE * F.col("steps"))
    parts = F.ceil(F.least(F.col("steps"), F.when(dense, F.col("n") * F.col("n") / DENSE).otherwise(F.col("steps"))) * F.col("asked") / TASK_WORK)
    size = written(size.select("component", "n", dense.alias("dense"), (dense | (F.col("steps") <= HELD_STEPS)).alias("held"), F.least(parts, F.col("asked")).cast("int").alias("parts")))
    held, large = size.where("held"), size.where("not held").select("component")
    tasks = held.agg(F.sum("parts")).first()[0] or 0
    found = []
    if tasks:
        row = ["component", "part", "n", "dense", "i", "j"]
        steps = led.join(held, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "n", "dense", "i", "j")
        start = src.join(held, "component").select("component", F.pmod("place", "parts").alias("part"), "n", "dense", F.col("place").alias("i"), F.lit(-1).alias("j"))
        small_batches(edges.sparkSession, 16_000_000)
        tasks = min(4_096, max(edges.sparkSession.sparkContext.defaultParallelism, tasks))
        dealt = steps.select(row).unionByName(start.select(row)).repartition(tasks, "component", "part").sortWithinPartitions("component", "part")
        through = dealt.mapInArrow(_searched, "component long, place int, t double").groupBy("component", "place").agg(F.sum("t").alias("t"))
        kind = nodes.schema["component"].dataType
        found.append(nodes.join(through.withColumn("component", F.col("component").cast(kind)), ["component", "place"]).select("id", "t"))
    if not large.isEmpty():
        part = _through(_cut(both_ways(led.join(large, "component", "left_semi").select("a", "b"))), src.join(large, "component", "left_semi").select("id"))
        found += [] if part is None else [part]
    return _scaled(nodes.select("id"), n, reduce(DataFrame.unionByName, found) if found else None)


def _searched(batches):
    """Arrow batches of (component, place, t) for batches of (component, part, n, dense, i, j) in the order of the first two."""
    import numpy as np

    now = held = None
    for batch in batches:
        component, part, n, dense, i, j = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(6))
        cuts = [0, *(np.flatnonzero((np.diff(component) != 0) | (np.diff(part) != 0)) + 1), len(part)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if now != (component[s], part[s]):
                if held is not None:
                    yield held.through(now[0])
                now, held = (component[s], part[s]), _Held(int(n[s]), bool(dense[s]))
            held.take(i[s:e], j[s:e])
    if held is not None:
        yield held.through(now[0])


class _Held:
    """A connected graph over 0 to n - 1, as bits of a matrix or as lists of neighbours, and some sources in it."""

    def __init__(self, n: int, dense: bool):
        import numpy as np

        self.n, self.sources, self.pairs = n, [], []
        self.bits = np.zeros((n, -(-n // 8)), np.uint8) if dense else None

    def take(self, i, j) -> None:
        """Edges, and sources (j below 0)."""
        import numpy as np

        self.sources.append(i[j < 0].copy())
        i, j = i[j >= 0], j[j >= 0]
        if self.bits is None:
            self.pairs.append((i.copy(), j.copy()))
            return
        for x, y in ((i, j), (j, i)):
            np.bitwise_or.at(self.bits, (x, y >> 3), (128 >> (y & 7)).astype(np.uint8))

    def _listed(self) -> None:
        import numpy as np

        i, j = (np.concatenate([p[k] for p in self.pairs]) for k in range(2))
        self.pairs = []
        start = np.concatenate([i, j])
        order = np.argsort(start, kind="stable")
        self.near = np.concatenate([j, i])[order]
        self.begin = np.searchsorted(start[order], np.arange(self.n + 1))

    def summed(self, x, most: int = 2_000_000):
        """For each vertex the sum of its neighbours' rows of x."""
        import numpy as np

        out = np.zeros_like(x)
        if self.bits is not None:
            step = max(1, most // self.n)
            for s in range(0, self.n, step):
                out[s : s + step] = np.unpackbits(self.bits[s : s + step], axis=1, count=self.n).astype(float) @ x
            return out
        active = np.flatnonzero(x.any(axis=1))
        size = self.begin[active + 1] - self.begin[active]
        mark = np.zeros(self.n, bool)
        mark[self.near[np.repeat(self.begin[active] - (np.cumsum(size) - size), size) + np.arange(size.sum())]] = True
        want = np.flatnonzero(mark)
        size = self.begin[want + 1] - self.begin[want]
        ends, most = np.cumsum(size), max(1, most // x.shape[1])
        s = 0
        while s < len(want):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, side="right")))
            first = self.begin[want[s:e]]
            offset = np.cumsum(size[s:e]) - size[s:e]
            if e - s == 1:  # a hub may have more neighbours than are read at once
                for k in range(int(first[0]), int(first[0] + size[s]), most):
                    out[want[s]] += x[self.near[k : min(k + most, first[0] + size[s])]].sum(axis=0)
            else:
                out[want[s:e]] = np.add.reduceat(x[self.near[np.repeat(first - offset, size[s:e]) + np.arange(size[s:e].sum())]], offset, axis=0)
            s = e
        return out

    def through(self, component: int):
        """What leads through each vertex, from all sources, as an Arrow batch."""
        import numpy as np
        import pyarrow as pa

        if self.bits is None:
            self._listed()
        sources, total = np.concatenate(self.sources), np.zeros(self.n)
        step = max(1, HELD_NUMBERS // self.n)
        for s in range(0, len(sources), step):
            total += self._from(sources[s : s + step])
        places = np.arange(self.n, dtype=np.int32)
        return pa.record_batch([pa.array(np.full(self.n, component, np.int64)), pa.array(places), pa.array(total)], names=["component", "place", "t"])

    def _from(self, sources):
        import numpy as np

        own = (sources, np.arange(len(sources)))
        far = np.full((self.n, len(sources)), -1, np.int32)
        paths = np.zeros(far.shape)
        far[own], paths[own] = 0, 1
        front, d = paths, 0
        while (new := far < 0).any():
            front = np.where(new, self.summed(front), 0)
            d += 1
            far[front > 0] = d
            paths += front
        leads = np.zeros(far.shape)
        for k in range(d, 1, -1):  # at 1 it would be the sources' own
            share = np.zeros(far.shape)
            np.divide(1 + leads, paths, out=share, where=far == k)
            leads += np.where(far == k - 1, paths * self.summed(share), 0)
        return leads.sum(axis=1)


def directed_betweenness(edges: DataFrame, sources: int | None = None, seed: int = 42) -> DataFrame:
    """Betweenness along the edges (src, dst); see ``paths_through``."""
    return paths_through(_cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()), sources, seed)


#: Pairs of source and reached vertex that one batch of sources may hold.
LIVE_PAIRS = 2_000_000_000


def paths_through(sym: DataFrame, sources: int | None, seed: int) -> DataFrame:
    """Share of the shortest paths along steps (a, b) that lead through each vertex, by search from each source (all, or a seeded sample).

    Level by level over tables keyed by source: distances and path counts forwards, dependencies backwards. Sources go in
    batches, so that no table holds over about LIVE_PAIRS rows; each batch leaves one row a vertex.
    """
    nodes = _cut(sym.select(F.col("a").alias("id")).union(sym.select("b")).distinct())
    n = nodes.count()
    asked = n if sources is None else min(sources, n)
    src = nodes if asked == n else _cut(nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(asked))
    return _scaled(nodes, n, _through(sym, src))


def _scaled(nodes: DataFrame, n: int, total: DataFrame | None) -> DataFrame:
    """(id, betweenness) of all nodes from rows of (id, t)."""
    if total is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    scale = 1.0 / max(1, (n - 1) * (n - 2))
    return nodes.join(total.groupBy("id").agg(F.sum("t").alias("t")), "id", "left").select("id", (F.coalesce("t", F.lit(0.0)) * scale).alias("betweenness"))


def _through(sym: DataFrame, src: DataFrame) -> DataFrame | None:
    """(id, t), a vertex once for each batch of sources; None if they reach nothing."""
    n = sym.select(F.col("a").alias("id")).union(sym.select("b")).distinct().count()
    batches = max(1, -(-src.count() * n // LIVE_PAIRS))
    total = None
    for i in range(batches):
        part = _dependencies(sym, src.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i) if batches > 1 else src)
        if part is not None:
            total = part if total is None else total.unionByName(part)
    return total


def _dependencies(sym: DataFrame, src: DataFrame) -> DataFrame | None:
    """(id, t): the dependencies of some sources on each vertex, summed; None if they reach nothing."""
    seen = _cut(src.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    frontier, levels = seen, 0
    while True:
        step = frontier.join(sym.withColumnRenamed("a", "id"), "id").groupBy("s", F.col("b").alias("id")).agg(F.sum("sigma").alias("sigma"))
        frontier = _cut(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(levels + 1).alias("d"), "sigma"))
        if frontier.isEmpty():
            break
        levels += 1
        seen = _cut(seen.unionByName(frontier))
    dep = seen.select("s", "id", F.lit(0.0).alias("dep")).limit(0)
    total = None
    for d in range(levels, 0, -1):
        here = seen.where(F.col("d") == d).join(dep, ["s", "id"], "left").select("s", "id", "sigma", F.coalesce("dep", F.lit(0.0)).alias("dep"))
        total = here.select("id", "dep") if total is None else total.unionByName(here.select("id", "dep"))
        up = here.join(sym.withColumnRenamed("b", "id"), "id").select("s", F.col("a").alias("id"), ((1 + F.col("dep")) / F.col("sigma")).alias("part"))
        before = seen.where(F.col("d") == d - 1).select("s", "id", F.col("sigma").alias("own"))
        dep = _cut(up.join(before, ["s", "id"]).groupBy("s", "id").agg(F.sum(F.col("part") * F.col("own")).alias("dep")))
    return None if total is None else _cut(total.groupBy("id").agg(F.sum("dep").alias("t")))
