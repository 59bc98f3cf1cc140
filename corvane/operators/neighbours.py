"""Exact nearest neighbours by cosine, on the executors: a cell index, whole cells pruned by the triangle inequality.

Rows with equal vectors form one class, known by its smallest id, so copies are compared once, however many there are. Classes are
dealt to cells around centres (fitted on a bounded sample, ``SAMPLE_ROWS``); a cell's count and radius are what the driver holds
(at most ``MOST_CELLS`` of them). Cells are packed into blocks of vectors, written once. For a block of queries an upper bound of
the distance of the k-th neighbour follows from the block itself and from the cells' counts, centres and radii; a cell whose
nearest possible member is farther away than that for all queries of the block is left out, which loses nothing. The rest meets
the queries block by block, with a running top k. Distances on the unit sphere are chords, for which the triangle inequality
holds; what is returned is the cosine distance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import cut, small_batches

#: Bytes of vectors in a block; vectors for each cell, while there are few of them; most cells; rows that centres are fitted on.
BLOCK_BYTES, CELL_ROWS, MOST_CELLS, SAMPLE_ROWS = 2_000_000, 4_096, 1_024, 16_384
#: Rows of a cell that one task packs, and blocks that one task compares with a block of queries.
PACK_ROWS, BLOCKS_A_TASK = 65_536, 64
#: Groups of query blocks while they are small, and most blocks of a group.
GROUPS, GROUP_BLOCKS = 16, 32
#: Bytes of blocks handed to Python at once: Spark's 256 MB would be held several times by each worker.
ARROW_BYTES = 16_000_000
#: Similarities that differ by less are equal: they are rounded to 12 digits.
DIGITS, SLACK = 12, 2e-12

_PACKED = "cell int, block long, classes array<long>, m binary"


@dataclass
class Index:
    """The written blocks of one dimension, and what is known of the cells."""

    dim: int
    blocks: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors of two matrices."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n > 0, n, 1)


def fitted(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Centres on the unit sphere: a few rounds of means over the sample."""
    if not len(sample):
        return np.zeros((cells, sample.shape[1]))
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where((np.abs(sums).sum(axis=1) > 0)[:, None], _unit(sums), centres)
    return centres


def build(classes: DataFrame, dim: int) -> Index:
    """Index of (class, v), v an array of doubles with a direction, all of one length."""
    spark, n = classes.sparkSession, classes.count()
    small_batches(spark, ARROW_BYTES)
    cells = max(1, min(MOST_CELLS, -(-n // CELL_ROWS)))
    first = classes.orderBy(F.xxhash64("class"), "class").limit(min(n, SAMPLE_ROWS, 16 * cells)).select("v").collect()
    centres = fitted(_unit(np.array([r["v"] for r in first], "f8").reshape(-1, dim)), cells)
    held = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors

    def place(frames):
        for f in frames:
            m = _unit(np.array(f["v"].tolist(), "f8").reshape(-1, dim))
            near = m @ held.value.T
            cell = near.argmax(axis=1)
            yield pd.DataFrame({"class": f["class"], "cell": cell.astype(np.int32), "far": np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(m)), cell])), "u": [x.tobytes() for x in m]})

    placed = cut(classes.select("class", "v").mapInPandas(place, "class long, cell int, far double, u binary"))
    known = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row for each cell
    radius, count = np.zeros(cells), np.zeros(cells, np.int64)
    for r in known:
        radius[r["cell"]], count[r["cell"]] = r["far"] + 1e-9, r["n"]
    salts = F.create_map(*[F.lit(int(x)) for c in range(cells) for x in (c, -(-int(count[c]) // PACK_ROWS) or 1)])
    rows = max(1, BLOCK_BYTES // (8 * dim))

    def pack(frames):
        from pyspark import TaskContext

        block, cell, ids, vectors = TaskContext.get().partitionId() << 33, None, [], []
        for f in frames:
            for c, k, u in zip(f["cell"], f["class"], f["u"], strict=True):
                if ids and (c != cell or len(ids) >= rows):
                    yield pd.DataFrame({"cell": [cell], "block": [block], "classes": [ids], "m": [b"".join(vectors)]})
                    block, ids, vectors = block + 1, [], []
                cell = c
                ids.append(k)
                vectors.append(u)
        if ids:
            yield pd.DataFrame({"cell": [cell], "block": [block], "classes": [ids], "m": [b"".join(vectors)]})

    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("class"), salts[F.col("cell")]))
    blocks = dealt.repartition(F.col("cell"), F.col("salt")).sortWithinPartitions("cell", "salt").select("cell", "class", "u").mapInPandas(pack, _PACKED)
    return Index(dim, cut(blocks), centres, radius, count)


class Running:
    """The best k so far for each row of a block of queries: similarity falling, then class rising."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.best = np.full((len(queries), k), -np.inf)
        self.at = np.full((len(queries), k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        """Chord of each query's k-th neighbour so far; infinite while there are fewer."""
        return np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isinf(self.best[:, -1]), -np.inf, self.best[:, -1] - SLACK)))

    def take(self, base: np.ndarray, classes: np.ndarray, allowed=None, step: int = 2_048) -> None:
        """Similarities in single precision leave out what its error bound rules out; the rest is computed in double."""
        q = self.q.astype("f4")
        slack = (self.q.shape[1] + 4) * 2.0**-22  # twice what rounding can do to a product of unit vectors
        for s in range(0, len(base), step):
            near = q @ base[s : s + step].astype("f4").T
            if allowed is not None:
                near[~allowed(slice(s, s + step))] = -np.inf
            least = self.best[:, -1] - SLACK
            hit = near >= (least - slack).astype("f4")[:, None]
            if near.shape[1] > self.k and np.count_nonzero(hit) > len(q) * self.k:
                least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k].astype("f8") - slack - SLACK)
                hit = near >= (least - slack).astype("f4")[:, None]
            row, col = np.divmod(np.flatnonzero(hit), near.shape[1])
            there = near[row, col] > -np.inf
            row, col = row[there], col[there]
            if not len(row):
                continue
            exact = np.concatenate([np.einsum("ij,ij->i", self.q[row[x : x + 65_536]], base[s + col[x : x + 65_536]]) for x in range(0, len(row), 65_536)])
            there = exact >= least[row]
            row, col, exact = row[there], col[there], exact[there]
            changed = np.unique(row)
            held_row, held_col = np.nonzero(self.best[changed] > -np.inf)
            held_row = changed[held_row]
            rows = np.concatenate([held_row, row])
            sims = np.concatenate([self.best[held_row, held_col], np.round(exact, DIGITS)])
            ids = np.concatenate([self.at[held_row, held_col], classes[s + col]])
            order = np.lexsort((ids, -sims, rows))
            rows, sims, ids = rows[order], sims[order], ids[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = rank < self.k
            self.best[rows[keep], rank[keep]], self.at[rows[keep], rank[keep]] = sims[keep], ids[keep]


def needed_cells(index: Index, queries: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Cells that may hold a member within its bound for one of the queries."""
    nearest = chord(queries, index.centres) - index.radius
    return np.flatnonzero((index.count > 0) & (nearest <= bound[:, None] + 1e-9).any(axis=0))


def bound_by_cells(index: Index, queries: np.ndarray, k: int) -> np.ndarray:
    """Chord within which the cells' counts, centres and radii alone put k members."""
    farthest = np.where(index.count > 0, chord(queries, index.centres) + index.radius, np.inf)
    order = np.argsort(farthest, axis=1, kind="stable")
    enough = (np.cumsum(index.count[order], axis=1) >= k).argmax(axis=1)
    out = np.take_along_axis(farthest, order, axis=1)[np.arange(len(queries)), enough]
    return np.where(index.count.sum() >= k, out, np.inf)


def candidates(index: Index, k: int) -> DataFrame:
    """(block, cell): the cells that each block of queries must meet."""
    of = index.blocks.sparkSession.sparkContext.broadcast((index.dim, index.centres, index.radius, index.count))  # at most MOST_CELLS cells

    def work(frames):
        known = Index(of.value[0], None, *of.value[1:])
        for f in frames:
            for block, classes, m in zip(f["block"], f["classes"], f["m"], strict=True):
                q = _matrix(m, known.dim)
                own = Running(q, k)
                own.take(q, np.asarray(classes, np.int64))
                cells = needed_cells(known, q, np.minimum(own.bound(), bound_by_cells(known, q, k)))
                yield pd.DataFrame({"query": block, "cell": cells.astype(np.int32)})

    return index.blocks.select("block", "classes", "m").mapInPandas(work, "query long, cell int")


def nearest(index: Index, k: int) -> DataFrame:
    """(class, other, similarity): the k nearest classes of each, itself among them; equal similarities by class.

    Blocks of queries go in groups, which meet the blocks that one of them needs together: as many groups as GROUPS while a group has at
    most GROUP_BLOCKS, so that what is sent grows with the vectors and not with their square.
    """
    own = index.blocks.select("cell", "block")
    size = max(1, min(GROUP_BLOCKS, own.count() // GROUPS))
    meta = cut(own.withColumn("query", F.floor((F.row_number().over(W.orderBy("cell", "block")) - 1) / size)))  # a row for each block: few beside the vectors
    asking = candidates(index, k).select(F.col("query").alias("block"), F.col("cell").alias("met")).join(meta, "block").select("query", "met").distinct()
    pairs = cut(asking).join(own.withColumnRenamed("cell", "met"), "met")
    order = W.partitionBy("query").orderBy("block")
    pairs = cut(pairs.withColumn("part", F.floor((F.row_number().over(order) - 1) / BLOCKS_A_TASK).cast("int")).drop("met"))
    base = pairs.join(index.blocks.drop("cell"), "block").select("query", "part", F.lit(1).alias("kind"), "classes", "m")
    asked = pairs.select("query", "part").distinct().join(meta.drop("cell"), "query").join(index.blocks.drop("cell"), "block").select("query", "part", F.lit(0).alias("kind"), "classes", "m")
    rows = asked.unionByName(base)
    dim = index.dim

    def work(frames):
        now, runs = None, []
        for f in frames:
            for query, part, kind, classes, m in zip(f["query"], f["part"], f["kind"], f["classes"], f["m"], strict=True):
                if kind == 0:
                    if now != (query, part):
                        for run, ids in runs:
                            yield _found(run, ids)
                        now, runs = (query, part), []
                    runs.append((Running(_matrix(m, dim).copy(), k), np.array(classes, np.int64)))
                    continue
                if now != (query, part):
                    raise RuntimeError("a block of vectors came without its queries")
                b, there = _matrix(m, dim), np.asarray(classes, np.int64)
                middle = _unit(b.mean(axis=0, keepdims=True))
                far = chord(b, middle).max()
                for run, _ in runs:
                    if ((chord(run.q, middle)[:, 0] - far) <= run.bound() + 1e-9).any():
                        run.take(b, there)
        for run, ids in runs:
            yield _found(run, ids)

    ordered = rows.repartition("query", "part").sortWithinPartitions("query", "part", "kind")
    found = ordered.mapInPandas(work, "class long, other long, similarity double")
    best = W.partitionBy("class").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")


def _found(run: Running, ids: np.ndarray) -> pd.DataFrame:
    row, col = np.nonzero(run.best > -np.inf)
    return pd.DataFrame({"class": ids[row], "other": run.at[row, col], "similarity": run.best[row, col]})


def neighbours(vectors: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, other, distance): the k nearest of each by cosine distance, exact at every size; equal distances by id.

    A pair without a distance (a zero, null or infinite vector, or other lengths) comes last, with a null. Rows without an id are
    left out; ids are taken to be unique, and a row is never its own neighbour. Empty table: no rows.
    """
    from .impact import global_rank

    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    whole = rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    # Ids that are no whole numbers are compared by their place in order.
    rows = rows.withColumn("place", F.col("id").cast("long")) if whole else global_rank(rows, [F.asc("id")], "place")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    good = F.coalesce((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))
    rows = cut(rows.withColumn("dim", F.when(good, F.size("v")).otherwise(-1)))
    valid = rows.where("dim > 0")
    # The k + 1 smallest ids of each vector: as many as can be among anyone's neighbours. Spark limits the groups before the shuffle.
    first = valid.withColumn("rn", F.row_number().over(W.partitionBy("v").orderBy("place"))).where(F.col("rn") <= k + 1)
    classes = cut(first.groupBy("dim", "v").agg(F.min("place").alias("class"), F.array_sort(F.collect_list("place")).alias("places")))
    found = [nearest(build(classes.where(F.col("dim") == d["dim"]), d["dim"]), k + 1) for d in classes.select("dim").distinct().orderBy("dim").collect()]
    members = valid.join(classes.select("v", "class"), "v").select("class", "place")
    if found:
        pairs = reduce(DataFrame.unionByName, found)
        many = classes.where(F.size("places") > 1).select(F.col("class").alias("other"), "places")
        pairs = pairs.join(many, "other", "left").select("class", F.explode(F.coalesce("places", F.array("other"))).alias("other"), "similarity")
        listed = pairs.groupBy("class").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("o")))).alias("near"))  # at most (k + 1) squared
        near = members.join(listed, "class").select("place", F.posexplode(F.slice(F.filter("near", lambda x: x["o"] != F.col("place")), 1, k)).alias("rn", "x")).select("place", F.col("x.o").alias("other"), (1 + F.col("x.s")).alias("distance"))
    else:
        near = rows.sparkSession.createDataFrame([], "place long, other long, distance double")
    out = near.unionByName(_fillers(rows, near, k))
    if whole:
        kind = vectors.schema[id_column].dataType
        return out.select(F.col("place").cast(kind).alias("id"), F.col("other").cast(kind).alias("other"), "distance")
    names = rows.select("place", "id")
    return out.join(names, "place").join(names.select(F.col("place").alias("other"), F.col("id").alias("__other")), "other").select("id", F.col("__other").alias("other"), "distance")


def _fillers(rows: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """For rows with fewer than k neighbours: the smallest ids that they have no distance to. Only small dimensions have such rows."""
    size = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    short = rows.join(size.where((F.col("dim") < 0) | (F.col("n") <= k)).select("dim"), "dim").select("place", "dim")
    least = rows.orderBy("place").limit(2 * k + 2).agg(F.array_sort(F.collect_list(F.struct("place", "dim"))).alias("least"))  # one row
    has = near.groupBy("place").agg(F.count(F.lit(1)).alias("has"))
    other = lambda x: (x["place"] != F.col("place")) & ((F.col("dim") < 0) | (x["dim"] != F.col("dim")))
    want = short.join(has, "place", "left").crossJoin(F.broadcast(least)).select("place", F.slice(F.filter("least", other), 1, F.greatest(F.lit(0), k - F.coalesce("has", F.lit(0))).cast("int")).alias("more"))
    return want.select("place", F.explode("more").alias("x")).select("place", F.col("x.place").alias("other"), F.lit(None).cast("double").alias("distance"))
