"""Vectors: similar items, isolation, clusters, emerging clusters, a two-dimensional landscape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import cut, top, top_per
from ..functions.ranks import percentile, runs
from .neighbours import neighbours


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similar(vectors: DataFrame, query: list[float], n: int = 10, exclude=None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The vectors closest to one by cosine: a scan with the query as a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if exclude is None else vectors.where(F.col(id_column) != exclude)
    return top(rows.select(id_column, F.round(cosine(F.col(vector), q), 6).alias("similarity")), n, F.desc("similarity"), F.asc(id_column))


def isolation(vectors: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mean distance to the k nearest."""
    return neighbours(vectors, k, id_column, vector).groupBy(F.col("id").alias(id_column)).agg(F.round(F.avg("distance"), 4).alias("isolation"))


def embedding_gaps(vectors: DataFrame, k: int = 10, share: float = 0.25, least: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Sparse regions and boundaries: of each row with neighbours the mean and variance of its distances to the k nearest, its isolation
    between 0 and 1, and whether it is in the most isolated ``share`` or has a variance in the upper quarter. Fewer than ``least`` rows: none.

    The thresholds are percentiles with linear interpolation, found by rank over ranges of values. Rows without a direction have no distance and are left out.
    """
    own = neighbours(vectors, k, id_column, vector).groupBy(F.col("id").alias(id_column)).agg(F.avg("distance").alias("avg_distance"), F.var_pop("distance").alias("variance"))
    own = cut(own.where(F.col("avg_distance").isNotNull()))
    place = lambda value, at: runs(own.select(F.lit(1).alias("all"), value), ["all"], value).agg(percentile(value, at).alias(f"{value}_limit"))
    one = own.agg(F.count(F.lit(1)).alias("n"), F.min("avg_distance").alias("lo"), F.max("avg_distance").alias("hi")).crossJoin(place("avg_distance", 1 - share)).crossJoin(place("variance", 0.75))  # one row each
    rows = own.crossJoin(F.broadcast(one)).where(F.col("n") >= least)
    isolation = F.when(F.col("hi") > F.col("lo"), (F.col("avg_distance") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return rows.select(id_column, "avg_distance", isolation.alias("isolation"), (1 - isolation).alias("density"), "variance", (F.col("avg_distance") >= F.col("avg_distance_limit")).alias("sparse"), (F.col("variance") >= F.col("variance_limit")).alias("boundary"))


def coverage(gaps: DataFrame) -> DataFrame:
    """One row over the gaps: how many, how many are sparse and at boundaries, and one less the mean isolation (1 if there are none)."""
    return gaps.agg(F.count(F.lit(1)).alias("n"), F.count_if("sparse").alias("sparse"), F.count_if("boundary").alias("boundary"), F.round(1 - F.coalesce(F.avg("isolation"), F.lit(0.0)), 6).alias("coverage"))


def cluster_shift(rows: DataFrame, cluster: str = "label", order: str = "vec_id", share: float = 0.75, up: float = 1.5, down: float = 0.7) -> DataFrame:
    """Clusters whose rate changed between the first part (by time) and the rest."""
    from .impact import global_rank

    n = rows.agg(F.count(F.lit(1)).alias("total"))
    r = global_rank(rows.select(F.col(cluster).alias("cluster"), F.col(order).alias("o")), [F.asc("o")]).crossJoin(F.broadcast(n))
    late = F.col("rank") >= F.floor(F.col("total") * share)
    c = r.groupBy("cluster").agg(F.count_if(~late).alias("early"), F.count_if(late).alias("late"), F.first("total").alias("total"))
    cut = F.floor(F.col("total") * share)
    ratio = (F.col("late") / (F.col("total") - cut)) / F.nullif(F.col("early") / cut, F.lit(0.0))
    state = F.when(F.col("early") == 0, "new").when(ratio > up, "emerging").when(ratio < down, "declining").otherwise("stable")
    return c.select("cluster", "early", "late", F.round(ratio, 4).alias("ratio"), state.alias("state"))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector and size of each label, one row for each coordinate."""
    flat = vectors.select(label, F.posexplode(vector).alias("dim", "x"))
    return flat.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def kmeans(vectors: DataFrame, k: int = 20, seeds: tuple[int, ...] = (42, 43, 44), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The cheapest of several k-means runs; k at most half the rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.select(id_column, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")).cache()
    k = min(k, max(2, feats.count() // 2))
    models = [KMeans(k=k, seed=s).fit(feats) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(feats).select(id_column, F.col("prediction").alias("cluster"))


def landscape(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Two principal components of each vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    feats = vectors.select(id_column, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="p").fit(feats).transform(feats).withColumn("p", vector_to_array("p"))
    return out.select(id_column, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def embed(docs: DataFrame, text: str, id_column: str = "arxiv_id", dims: int = 384) -> DataFrame:
    """Offline embedding: hashed words, scaled to unit length; a model's column can stand in its place."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    rows = docs.select(F.col(id_column), F.explode_outer(words).alias("w")).select(id_column, F.pmod(F.xxhash64("w"), F.lit(dims)).alias("dim"), F.col("w").isNotNull().cast("int").alias("one"))
    counts = rows.groupBy(id_column, "dim").agg(F.sum("one").cast("double").alias("c"))
    held = counts.groupBy(id_column).agg(F.map_from_entries(F.collect_list(F.struct("dim", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return held.select(id_column, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)) / F.greatest("n", F.lit(1e-12))).cast("float")).alias("embedding"))


def silhouette(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(cluster, n, silhouette): mean silhouette of each cluster with squared distances, from the clusters' sums alone.

    The mean squared distance of a vector to a cluster is |x|^2 + mean |y|^2 - 2 x . mean(y), so no pairs are made. A cluster
    of one vector has 0, and so has everything if there is one cluster. Vectors without a label are left out.
    """
    size = len(vectors.where(F.col(vector).isNotNull()).select(vector).first()[0]) if not vectors.isEmpty() else 0
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("cluster"), F.col(vector).alias("x"), dot(vector, vector).alias("xx"))
    sums = [F.avg(F.col("x")[i].cast("double")).alias(f"m{i}") for i in range(size)]
    own = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("xx").alias("yy"), *sums).select("cluster", "n", "yy", F.array(*[F.col(f"m{i}") for i in range(size)]).alias("mean"))
    own = own.agg(F.collect_list(F.struct("cluster", "n", "yy", "mean")).alias("own"))  # a row for each cluster: few
    rows = rows.crossJoin(F.broadcast(own))
    far = F.transform("own", lambda c: F.struct(c["cluster"].alias("cluster"), c["n"].alias("n"), F.greatest(F.lit(0.0), F.col("xx") + c["yy"] - 2 * F.aggregate(F.zip_with("x", c["mean"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)).alias("d")))
    rows = rows.select("cluster", far.alias("far"))
    mine = F.filter("far", lambda c: c["cluster"] == F.col("cluster"))[0]
    rows = rows.select("cluster", mine.alias("mine"), F.array_min(F.transform(F.filter("far", lambda c: c["cluster"] != F.col("cluster")), lambda c: c["d"])).alias("b"))
    a = F.col("mine.d") * F.col("mine.n") / F.greatest(F.col("mine.n") - 1, F.lit(1))
    s = F.when((F.col("mine.n") == 1) | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - a) / F.nullif(F.greatest("b", a), F.lit(0.0)), F.lit(0.0)))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 4).alias("silhouette"))


def title_words(rows: DataFrame, group: str | None, title: str, longer_than: int, n: int, stop: list[str] = ()) -> DataFrame:
    """The most frequent words of titles, of letters alone, in each group or over all rows: labels of clusters, topics of gaps."""
    words = rows.select(*([group] if group else []), F.explode(F.split(F.lower(title), r"\s+")).alias("word"))
    words = words.where((F.length("word") > longer_than) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(list(stop)))
    keys = [group] if group else []
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_per(counts, keys, n, F.desc("n"), F.asc("word")) if group else top(counts, n, F.desc("n"), F.asc("word"))
    if not group:
        return ranked
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "word"))), lambda x: x["word"])
    return ranked.groupBy(group).agg(F.array_join(parts, ", ").alias("words"))
