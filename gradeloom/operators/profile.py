"""Profiles of features by slice and cluster: means, percentiles, scaling, clusters and their quality (survey A0 to A7, M1 to M3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.ranking import long_form, percentiles, present, shuffled


@dataclass(frozen=True)
class Aggregator:
    """A named aggregate of a feature: ``make`` turns the feature's column into an aggregate column.

    For aggregates that no built-in expresses, ``make`` may apply a grouped-aggregate Pandas UDF.
    """

    name: str
    make: Callable[[Column], Column] = field(compare=False)

    def over(self, rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        """by..., and <feature>_<name> for each feature."""
        return rows.groupBy(*by).agg(*(self.make(F.col(f"`{c}`")).alias(f"{c}_{self.name}") for c in columns))


#: Mean; without values 0, as a mean of nothing is given by the profiles.
MEAN = Aggregator("mean", lambda x: F.coalesce(F.avg(x), F.lit(0.0)))
#: Standard deviation of the whole population.
STD = Aggregator("std", lambda x: F.coalesce(F.stddev_pop(x), F.lit(0.0)))

SLICES = {"all": None, "0": 0, "1": 1, "2": 2}


def slices(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with their ``slice``: each stands in 'all' and in the slice of its label; a null label only in 'all'."""
    name = F.col(label).cast("string")
    return rows.withColumn("slice", F.explode(F.when(name.isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), name))))


def profile(rows: DataFrame, columns: list[str], cluster: str | None = None, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """slice, (cluster,) feature, n, mean, p: profile of each feature by slice and cluster.

    Nulls and NaN don't count; a feature without values in a slice gives no row, an empty table none at all.
    """
    keep = ["label"] + ([cluster] if cluster else [])
    by = ["slice", *([cluster] if cluster else []), "feature"]
    long = slices(long_form(rows, keep, columns)).select(*by, "x")
    means = long.groupBy(*by).agg(F.avg("x").alias("mean"))
    return percentiles(long, by, list(probs)).join(means, by).select(*by, "n", "mean", "p")


def percentile_matrix(rows: DataFrame, by: list[str], x: str, y: str, probs: list[float]) -> DataFrame:
    """by..., px, py, v: percentile py of y among the rows of which x is at most its percentile px.

    Rows without x take no part; among those with it, nulls of y don't count. Without rows there is no matrix.
    """
    clean = rows.select(*by, F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias("x"), F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double")).alias("y")).where("x IS NOT NULL")
    cuts = percentiles(clean.select(*by, "x"), by, sorted(probs)).select(*by, F.posexplode("p").alias("i", "cut"))
    below = clean.join(cuts if by else F.broadcast(cuts), by or None).where("x <= cut").select(*by, "i", F.col("y"))  # a row for each group and percentile
    got = percentiles(below, [*by, "i"], sorted(probs), value="y").select(*by, "i", F.posexplode("p").alias("j", "v"))
    name = lambda c: F.element_at(F.array(*(F.lit(p) for p in sorted(probs))), F.col(c) + 1)
    return got.select(*by, name("i").alias("px"), name("j").alias("py"), "v")


def minmax(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows with each column scaled to 0..1 by its range in the group; a constant column gives 0, null stays null."""
    by = by or []
    ranges = rows.groupBy(*by).agg(*(f(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double"))).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    both = rows.join(ranges, by) if by else rows.join(F.broadcast(ranges))  # without groups one row
    scaled = {c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(f"`{c}`") - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).when(F.col(f"`{c}`").isNotNull(), 0.0) for c in columns}
    return both.withColumns(scaled).drop(*(f"__{n}_{c}" for c in columns for n in ("lo", "hi")))


def sample(rows: DataFrame, n: int = 5000, key: str = "qa_id", seed: int = 42) -> DataFrame:
    """``n`` rows in a reproducible random order: a sample of fixed size by definition (all rows, if there are fewer)."""
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def squared(a: Column, b: Column) -> Column:
    """Squared distance of two number arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def assign_clusters(rows: DataFrame, vector: str, centres: DataFrame) -> DataFrame:
    """Rows with ``cluster``, the nearest of ``centres`` (cluster, centre), equal distances to the smaller number, and ``distance`` squared.

    The centres are one small table (as many rows as clusters) and held in one array.
    """
    one = centres.agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("__all"))
    best = F.array_min(F.transform("__all", lambda c: F.struct(squared(F.col(vector), c["centre"]).alias("d"), c["cluster"].alias("c"))))
    return rows.join(F.broadcast(one)).withColumn("__best", best).withColumns({"cluster": F.col("__best.c"), "distance": F.col("__best.d")}).drop("__all", "__best")


def lloyd_step(rows: DataFrame, vector: str, centres: DataFrame) -> DataFrame:
    """cluster, n, centre: the means of the rows nearest to each given centre; an empty cluster gives no row."""
    placed = assign_clusters(rows, vector, centres)
    long = placed.select("cluster", F.posexplode(vector).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return long.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def kmeans(rows: DataFrame, columns: list[str], k: int = 10, restarts: int = 50, seed: int = 42) -> DataFrame:
    """Rows with their ``cluster``: the best of several k-means fits by cost. Rows lacking a feature are left out.

    Fits run on what is given: scale it first, and give a :func:`sample` where the profile calls for one.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = present(rows, columns)
    vectors = data.withColumn("__v", array_to_vector(F.array(*(F.col(f"`{c}`").cast("double") for c in columns)))).persist()
    try:
        if vectors.isEmpty():
            return data.withColumn("cluster", F.lit(0))
        fits = (KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(vectors) for i in range(restarts))
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return best.transform(data.withColumn("__v", array_to_vector(F.array(*(F.col(f"`{c}`").cast("double") for c in columns))))).drop("__v")
    finally:
        vectors.unpersist()


def silhouette(rows: DataFrame, key: str, vector: str, cluster: str, limit: int = 5000) -> DataFrame:
    """key, silhouette: (b - a) / max(a, b) with a the mean distance to a row's own cluster and b to the nearest other.

    A row alone in its cluster has 0, and so have all rows of a single cluster. It compares a stated sample of at
    most ``limit`` rows with itself in blocks; more rows raise ValueError, so take a :func:`sample` first.
    """
    got = rows.select(cluster, vector).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a silhouette takes at most {limit} rows")
    names = sorted({r[0] for r in got})
    if len(names) < 2:
        return rows.select(key, F.lit(0.0).alias("silhouette"))
    x, of = np.array([r[1] for r in got], float), np.array([names.index(r[0]) for r in got])
    shared = rows.sparkSession.sparkContext.broadcast((x, of, np.bincount(of, minlength=len(names)), names))  # at most ``limit`` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, of, size, names = shared.value
        for batch in batches:
            mine = np.array([names.index(c) for c in batch["cluster"].to_pylist()], int)
            q = np.array(batch["v"].to_pylist(), float).reshape(len(mine), -1)
            out = np.zeros(len(mine))
            for i in range(0, len(mine), 256):
                d = np.sqrt(((q[i : i + 256, None] - x[None]) ** 2).sum(axis=2))
                sums = np.stack([d[:, of == c].sum(axis=1) for c in range(len(size))], axis=1)
                at, own = np.arange(len(d)), mine[i : i + 256]
                alone = size[own] <= 1
                a = sums[at, own] / np.maximum(size[own] - 1, 1)
                other = sums / size
                other[at, own] = np.inf
                b = other.min(axis=1)
                top = np.maximum(a, b)
                out[i : i + 256] = np.where(alone | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top))
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(out)], ["k", "silhouette"])

    kind = dict(rows.dtypes)[key]
    data = rows.select(F.col(key).alias("k"), F.col(cluster).alias("cluster"), F.col(vector).cast("array<double>").alias("v"))
    return data.mapInArrow(run, f"k {kind}, silhouette double").withColumnRenamed("k", key)


def random_labels(key: str, count: int = 8, seed: int = 42) -> Column:
    """A reproducible random label from 0, the baseline that a silhouette is held against."""
    return F.pmod(F.conv(F.substring(shuffled(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(count)).cast("int")
