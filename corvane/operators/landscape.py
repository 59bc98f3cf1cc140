"""A two-dimensional picture that keeps neighbours together: a fuzzy neighbour graph, a spectral start, epochs of attraction and repulsion.

Everything is an edge or vertex table. The graph's weights fall with the distance beyond a vertex's nearest neighbour, at a rate that gives each
vertex the same sum; both directions join as fuzzy sets. The start is a smoothing of the principal components by the graph's
random walk, without its constant part. In each epoch a vertex moves by the mean pull of its edges and the mean push of ``PUSHES``
vertices that a seeded hash of vertex and epoch names, so a run can be repeated.

Up to ``HELD_POINTS`` vertices the graph is packed once, in blocks of vertices with all their edges; a round sends the positions to the
tasks and gets the new ones back, and no edge is shuffled again. Beyond, a table of positions is written for each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.macros import small_batches, written
from .impact import global_rank
from .neighbours import neighbours

#: Neighbours, rounds of smoothing, epochs, pushes for each vertex and epoch, longest step in each direction.
NEAR, ROUNDS, EPOCHS, PUSHES, LONGEST = 15, 8, 24, 5, 4.0
#: The curve 1 / (1 + a d^2b) of closeness in the picture, for a least distance of 0.1.
CURVE_A, CURVE_B = 1.577, 0.895
#: Vertices whose positions the driver and the tasks hold (16 bytes each), and vertices of a packed block.
HELD_POINTS, BLOCK = 2_000_000, 4_096


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w) in both directions from (id, other, distance); w is between 0 and 1."""

    def rates(frames):
        for f in frames:
            d = [np.sort(np.asarray(x, float)) for x in f["d"]]
            rho = np.array([x[0] for x in d])
            beyond = np.full((len(d), max(map(len, d), default=1)), np.inf)
            for i, x in enumerate(d):
                beyond[i, : len(x)] = x - x[0]
            low, high, want = np.zeros(len(d)), np.full(len(d), 1e3), np.log2(k)
            for _ in range(60):
                sigma = (low + high) / 2
                over = np.exp(-beyond / np.maximum(sigma, 1e-12)[:, None]).sum(axis=1) > want
                low, high = np.where(over, low, sigma), np.where(over, sigma, high)
            yield pd.DataFrame({"id": f["id"], "rho": rho, "sigma": np.maximum(sigma, 1e-9)})

    lists = near.groupBy("id").agg(F.collect_list("distance").alias("d"))  # at most k distances
    of = lists.mapInPandas(rates, "id long, rho double, sigma double")
    one = near.join(of, "id").select(F.col("id").alias("a"), F.col("other").alias("b"), F.exp(-F.greatest(F.lit(0.0), F.col("distance") - F.col("rho")) / F.col("sigma")).alias("w"))
    both = one.select("a", "b", F.col("w").alias("p"), F.lit(0.0).alias("q")).unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("p"), F.col("w").alias("q")))
    both = both.groupBy("a", "b").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    return both.select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("w"))


def packed(graph: DataFrame, n: int) -> DataFrame:
    """Written rows (a, b, w) of binaries: the edges of a block of vertices, in the order of a."""

    def pack(batches):
        import pyarrow as pa

        def row(held):
            a, b, w = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((b, a))
            return pa.record_batch([pa.array([c[order].astype(t).tobytes()], pa.binary()) for c, t in ((a, "<i8"), (b, "<i8"), (w, "<f8"))], names=["a", "b", "w"])

        now, held = None, []
        for batch in batches:
            block, *rest = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and block[s] != now:
                    yield row(held)
                    held = []
                now = block[s]
                held.append([c[s:e].copy() for c in rest])
        if held:
            yield row(held)

    small_batches(graph.sparkSession, 16_000_000)
    block = F.floor(F.col("a") / BLOCK).alias("block")
    dealt = graph.select(block, F.col("a").cast("long"), F.col("b").cast("long"), "w").repartition(max(1, min(-(-n // BLOCK), 1_024)), "block").sortWithinPartitions("block")
    return written(dealt.mapInArrow(pack, "a binary, b binary, w binary"))


def swept(blocks: DataFrame, of, state: np.ndarray, n: int, width: int) -> np.ndarray:
    """n rows of so many numbers: of(ids, begin, a, b, w, state) for each block, NaN where there is no vertex.

    ids: its vertices in order; begin: where their edges begin; a, b, w: the edges.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(state)  # at most HELD_POINTS rows

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b, w = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(w, "<f8")
                ids, begin = np.unique(a, return_index=True)
                out = np.ascontiguousarray(of(ids, begin, a, b, w, sent.value), "<f8")
                yield pa.record_batch([pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["ids", "out"])

    found = np.full((n, width), np.nan)
    for r in blocks.mapInArrow(work, "ids binary, out binary").collect():  # a row for each block
        found[np.frombuffer(r["ids"], "<i8")] = np.frombuffer(r["out"], "<f8").reshape(-1, width)
    sent.destroy()
    return found


def spectral_held(blocks: DataFrame, now: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """What ``spectral`` gives, from rows of (x, y) by vertex; NaN where there is no vertex."""
    n = len(now)
    root = np.sqrt(swept(blocks, lambda ids, begin, a, b, w, _: np.add.reduceat(w, begin), np.zeros(0), n, 1)[:, 0])
    x, y = np.where(np.isnan(root), np.nan, now[:, 0]), np.where(np.isnan(root), np.nan, now[:, 1])

    def step(ids, begin, a, b, w, state):
        c = w / (state[a, 2] * state[b, 2])
        return np.stack([np.add.reduceat(c * state[b, k], begin) for k in range(2)], axis=1)

    dot = lambda u, v: float(np.nansum(u * v))
    for _ in range(rounds):
        got = swept(blocks, step, np.stack([x, y, root], axis=1), n, 2)
        x, y = (x + got[:, 0]) / 2, (y + got[:, 1]) / 2
        tt, xt, yt, xy = dot(root, root), dot(x, root), dot(y, root), dot(x, y)
        if not tt:
            return np.stack([x, y], axis=1)
        cx, cy = xt / tt, yt / tt
        xx, yy, xy = dot(x, x) - cx * xt, dot(y, y) - cy * yt, xy - cx * yt
        turn = xy / xx if xx > 1e-30 else 0.0
        flat = x - cx * root
        x, y = flat / max(xx, 1e-30) ** 0.5, (y - cy * root - turn * flat) / max(yy - turn * xy, 1e-30) ** 0.5
    out = np.stack([x / root, y / root], axis=1)
    return out * (10 / np.array([np.nanmax(np.abs(out[:, k]), initial=0.0) or 1.0 for k in range(2)]))


def named(ids: np.ndarray, epoch: int, j: int, seed: int, n: int) -> np.ndarray:
    """The vertex that pmod(xxhash64(id, epoch, j, seed), n) names."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda h, k: h << np.uint64(k) | h >> np.uint64(64 - k)

    def mixed(h):
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)

    h = np.full(len(ids), 42, np.uint64) + p5 + np.uint64(8)
    h = mixed(turn(h ^ turn(ids.astype(np.uint64) * p2, 31) * p1, 27) * p1 + p4)
    for x in (epoch, j, seed):
        h = mixed(turn((h + p5 + np.uint64(4)) ^ np.array([x & 0xFFFFFFFF], np.uint64) * p1, 23) * p2 + p3)
    return h.view(np.int64) % n


def _force(x, y, bx, by, attract: bool):
    dx, dy = x - bx, y - by
    far = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        bent = 1 + CURVE_A * far**CURVE_B
        f = np.where(far > 0, -2 * CURVE_A * CURVE_B * far ** (CURVE_B - 1) / bent, 0.0) if attract else 2 * CURVE_B / ((0.001 + far) * bent)
        return np.clip(f * dx, -LONGEST, LONGEST), np.clip(f * dy, -LONGEST, LONGEST)


def epochs_held(blocks: DataFrame, now: np.ndarray, rounds: int = EPOCHS, seed: int = 42) -> np.ndarray:
    """What ``epochs`` gives, from rows of (x, y) by vertex."""
    n = len(now)
    for e in range(rounds):

        def step(ids, begin, a, b, w, at, e=e):
            x, y = at[:, 0], at[:, 1]
            moved, weight = at[ids].copy(), np.add.reduceat(w, begin)
            rate = 1 - e / rounds
            for k, f in enumerate(_force(x[a], y[a], x[b], y[b], True)):
                moved[:, k] += rate * np.add.reduceat(w * f, begin) / weight
            other = np.stack([named(ids, e, j, seed, n) for j in range(PUSHES)], axis=1)
            there = ~np.isnan(x[other])
            for k, f in enumerate(_force(x[ids, None], y[ids, None], x[other], y[other], False)):
                moved[:, k] += rate * np.where(there, f, 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
            return moved

        now = swept(blocks, step, now, n, 2)
    return now


def spectral(graph: DataFrame, start: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, x, y), at most 10 from the middle: power iteration of the lazy walk from a start, orthogonal to its constant vector."""
    degree = graph.groupBy("a").agg(F.sum("w").alias("d"))
    sides = graph.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    steps = written(sides.select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("c")))
    now = written(start.join(degree.withColumnRenamed("a", "id"), "id").select("id", "x", "y", F.sqrt("d").alias("t")))
    for _ in range(rounds):
        got = steps.join(now.select(F.col("id").alias("b"), "x", "y"), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("c") * F.col("x")).alias("gx"), F.sum(F.col("c") * F.col("y")).alias("gy"))
        new = written(now.join(got, "id").select("id", ((F.col("x") + F.col("gx")) / 2).alias("x"), ((F.col("y") + F.col("gy")) / 2).alias("y"), "t"))
        dot = lambda u, v: F.sum(F.col(u) * F.col(v)).alias(u + v)
        one = new.agg(dot("x", "x"), dot("y", "y"), dot("x", "y"), dot("x", "t"), dot("y", "t"), dot("t", "t")).first()  # six numbers
        if not one["tt"]:
            return new.select("id", "x", "y")
        cx, cy = one["xt"] / one["tt"], one["yt"] / one["tt"]
        xx, yy, xy = one["xx"] - cx * one["xt"], one["yy"] - cy * one["yt"], one["xy"] - cx * one["yt"]
        turn = xy / xx if xx > 1e-30 else 0.0
        nx, ny = max(xx, 1e-30) ** 0.5, max(yy - turn * xy, 1e-30) ** 0.5
        x = F.col("x") - cx * F.col("t")
        now = new.select("id", (x / nx).alias("x"), ((F.col("y") - cy * F.col("t") - turn * x) / ny).alias("y"), "t")
    now = written(now.select("id", (F.col("x") / F.col("t")).alias("x"), (F.col("y") / F.col("t")).alias("y")))
    most = now.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).first()  # two numbers
    return now.select("id", (F.col("x") * (10 / (most["x"] or 1.0))).alias("x"), (F.col("y") * (10 / (most["y"] or 1.0))).alias("y"))


def _clipped(c: Column) -> Column:
    return F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), c))


def epochs(graph: DataFrame, start: DataFrame, n: int, rounds: int = EPOCHS, seed: int = 42) -> DataFrame:
    """(id, x, y) after the epochs; ids are 0 to n - 1."""
    now = written(start)
    other = now.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    far = dx * dx + dy * dy
    for e in range(rounds):
        other = now.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        pull = F.when(far > 0, -2 * CURVE_A * CURVE_B * F.pow(far, F.lit(CURVE_B - 1)) / (1 + CURVE_A * F.pow(far, F.lit(CURVE_B)))).otherwise(0.0)
        push = 2 * CURVE_B / ((0.001 + far) * (1 + CURVE_A * F.pow(far, F.lit(CURVE_B))))
        force = lambda rows, by, w: rows.join(other, "b").groupBy("id", "x", "y").agg((F.sum(w * _clipped(by * dx)) / F.sum(w)).alias("fx"), (F.sum(w * _clipped(by * dy)) / F.sum(w)).alias("fy"))  # noqa: E731, B023
        pulled = force(graph.select(F.col("a").alias("id"), "b", "w").join(now, "id"), pull, F.col("w"))
        named = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(e), F.lit(j), F.lit(seed)), F.lit(n)) for j in range(PUSHES)]))
        pushed = force(now.select("id", "x", "y", named.alias("b")), push, F.lit(1.0))
        rate = 1 - e / rounds
        moves = pulled.unionByName(pushed).groupBy("id", "x", "y").agg((F.col("x") + rate * F.sum("fx")).alias("nx"), (F.col("y") + rate * F.sum("fy")).alias("ny"))
        now = written(moves.select("id", F.col("nx").alias("x"), F.col("ny").alias("y")))
    return now


def landscape(vectors: DataFrame, near: int = NEAR, rounds: int = EPOCHS, seed: int = 42, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x, y) of every row with a direction, all vectors being of one length; fewer than five rows: none."""
    from . import vectors as V

    norm = F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.where(F.col(id_column).isNotNull() & (norm > 0) & (norm < float("inf"))).select(id_column, vector)
    ranked = written(global_rank(rows, [F.asc(id_column)], "place"))
    n = ranked.count()
    if n < 5:
        return ranked.select(id_column, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    k = min(near, n - 1)
    close = neighbours(ranked.select(F.col("place").alias("id"), vector), k, "id", vector).where(F.col("distance").isNotNull())
    graph = written(fuzzy_graph(written(close), k))
    start = V.landscape(ranked.select("place", vector), "place", vector).withColumnRenamed("place", "id")
    found = _pictured(graph, start, n, rounds, seed) if n <= HELD_POINTS else epochs(graph, spectral(graph, start), n, rounds, seed)
    return ranked.select(id_column, F.col("place").alias("id")).join(found, "id").select(id_column, "x", "y")


def _pictured(graph: DataFrame, start: DataFrame, n: int, rounds: int, seed: int) -> DataFrame:
    blocks = packed(graph, n)
    first = start.select(F.col("id").cast("long").alias("id"), "x", "y").toArrow()  # at most HELD_POINTS rows
    now = np.full((n, 2), np.nan)
    now[first.column("id").to_numpy()] = np.stack([first.column("x").to_numpy(), first.column("y").to_numpy()], axis=1)
    now = epochs_held(blocks, spectral_held(blocks, now), rounds, seed)
    sent = graph.sparkSession.sparkContext.broadcast(now)

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            for a in batch.column(0).to_pylist():
                ids = np.unique(np.frombuffer(a, "<i8"))
                ids = ids[~np.isnan(sent.value[ids, 0])]
                yield pa.record_batch([pa.array(ids), pa.array(sent.value[ids, 0]), pa.array(sent.value[ids, 1])], names=["id", "x", "y"])

    return blocks.select("a").mapInArrow(places, "id long, x double, y double")


def bounds(picture: DataFrame) -> DataFrame:
    """One row: how many points, and the edges of the picture."""
    return picture.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
