"""Evaluation of predictions and of accuracy runs (survey M6 to M10, A10 to A12, J8, W12, W13, N3)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.ranking import running, shuffled
from gradeloom.operators.relevance import balanced


def confusion(rows: DataFrame) -> DataFrame:
    """y_true, y_pred, n. Rows that lack one of both are left out."""
    return rows.where("y_true IS NOT NULL AND y_pred IS NOT NULL").groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def totals(matrix: DataFrame) -> DataFrame:
    """hits, n: the trace of a confusion matrix and its sum, 0 for an empty one."""
    return matrix.agg(F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)), F.lit(0)).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def expand(matrix: DataFrame, block: int = 65_536) -> DataFrame:
    """y_true, y_pred, i: a row for each counted prediction, i from 0; made in blocks, so that no count becomes one huge array."""
    blocks = matrix.where("n > 0").select("y_true", "y_pred", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("b"))
    return blocks.select("y_true", "y_pred", F.explode(F.sequence(F.col("b") * block, F.least(F.col("n"), (F.col("b") + 1) * block) - 1)).alias("i"))


def balanced_classes(rows: DataFrame, classes=(0, 1, 2), seed: int = 42) -> DataFrame:
    """As many rows of each class of y_true as the rarest of them has: W12. Without rows of one class there are none left of the others."""
    kept = rows.where(F.col("y_true").isin(*classes))
    all_there = kept.agg((F.countDistinct("y_true") == len(classes)).alias("__all"))
    return balanced(kept, "y_true", "qa_id", seed).join(F.broadcast(all_there)).where("__all").drop("__all")  # one row


def kappa(matrix: DataFrame) -> DataFrame:
    """kappa: Cohen's, with quadratic weights over the labels present, in order; null for an empty matrix or one without expected disagreement."""
    labels = matrix.select(F.col("y_true").alias("y")).union(matrix.select("y_pred")).distinct()
    order = labels.agg(F.sort_array(F.collect_set("y")).alias("__o"))  # as many entries as labels
    m = matrix.join(F.broadcast(order)).select(F.array_position("__o", F.col("y_true").cast(matrix.schema["y_true"].dataType)).alias("t"), F.array_position("__o", F.col("y_pred")).alias("p"), F.col("n").cast("double").alias("n"))
    s = lambda c: F.sum(c * F.col("n"))
    t, p = F.col("t").cast("double"), F.col("p").cast("double")
    got = m.agg(F.sum("n").alias("n"), s((t - p) * (t - p)).alias("d"), s(t).alias("t"), s(p).alias("p"), s(t * t).alias("tt"), s(p * p).alias("pp"))
    seen, expected = F.col("d") / F.col("n"), (F.col("tt") + F.col("pp") - 2 * F.col("t") * F.col("p") / F.col("n")) / F.col("n")
    return got.select(F.when((F.col("n") > 0) & (expected > 0), 1 - seen / expected).alias("kappa"))


def metrics(rows: DataFrame, seed: int = 42) -> DataFrame:
    """accuracy, precision, recall, kappa: accuracy and kappa over balanced classes 0, 1, 2; the others over balanced 0 and 2, where a prediction 1 counts as 0.

    A ratio of nothing is 0 for precision and recall, null for the others.
    """
    three = confusion(balanced_classes(rows, (0, 1, 2), seed))
    two = confusion(balanced_classes(rows, (0, 2), seed)).select(F.expr("y_true div 2").alias("t"), F.expr("CASE WHEN y_pred = 2 THEN 1 ELSE 0 END").alias("p"), "n")
    hit, said, true = (F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (F.expr("t = 1 AND p = 1"), F.expr("p = 1"), F.expr("t = 1")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr = two.agg(ratio(hit, said).alias("precision"), ratio(hit, true).alias("recall"))
    acc = totals(three).select(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("accuracy"))
    return acc.join(pr).join(kappa(three))  # one row each


def truncated(runs: DataFrame) -> DataFrame:
    """(arm, run, pos, acc) cut to the positions that the shortest run has: A12."""
    least = runs.groupBy("run").agg((F.max("pos") + 1).alias("m")).agg(F.min("m").alias("__m"))
    return runs.join(F.broadcast(least)).where("pos < __m").drop("__m")  # one row


def numbered(runs: DataFrame) -> DataFrame:
    """Runs with ``i``, the place of a run in its arm; a table of as many rows as runs numbers them."""
    names = runs.select("arm", "run").distinct().withColumn("i", F.expr("row_number() OVER (PARTITION BY arm ORDER BY run) - 1"))
    return runs.join(names, ["arm", "run"])


def paired(runs: DataFrame, sub: str = "sub", non: str = "non", shuffle: bool = False, seed: int = 43) -> DataFrame:
    """i, pos, x, y: the accuracies of both arms side by side, runs in order, or with ``shuffle`` in another random order at each position: J8."""
    cut = truncated(runs)
    if shuffle:
        key = F.concat_ws("-", F.col("arm"), F.col("run").cast("string"), F.col("pos").cast("string"))
        cut = cut.withColumn("__o", shuffled(key, seed)).withColumn("i", F.expr("row_number() OVER (PARTITION BY arm, pos ORDER BY __o) - 1"))  # of as many rows as runs
    else:
        cut = numbered(cut)
    one, two = (cut.where(F.col("arm") == a).select("i", "pos", F.col("acc").alias(c)) for a, c in ((sub, "x"), (non, "y")))
    return one.join(two, ["i", "pos"])


def curve(runs: DataFrame) -> DataFrame:
    """i, pos, diff: the differences of the paired runs: M10, S8."""
    return paired(runs).select("i", "pos", (F.col("x") - F.col("y")).alias("diff"))


def best_worst(runs: DataFrame, sub: str = "sub", non: str = "non") -> DataFrame:
    """pos, a1, a2: at each position the best run of one arm against the worst of the other, and the worst against the best: A11."""
    arm = lambda a, f: f(F.when(F.col("arm") == a, F.col("acc")))
    return truncated(runs).groupBy("pos").agg((arm(sub, F.max) - arm(non, F.min)).alias("a1"), (arm(sub, F.min) - arm(non, F.max)).alias("a2"))


def wilcoxon(pairs: DataFrame, decimals: int = 9) -> DataFrame:
    """n, w_plus, ties, z: signed ranks of the differences x - y, for the alternative that x is greater.

    Zero differences are dropped and equal ones (to ``decimals``) share their mean rank; z is the normal
    deviate with the tie correction and without one for continuity, null for n = 0 or no variance. ties is the number
    of groups of equal sizes. The sizes are counted before they are ranked.
    """
    d = pairs.select(F.round(F.col("x") - F.col("y"), decimals).alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("c"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("plus"))
    ranked = running(sizes, [], [F.col("a")], F.col("c")).withColumn("rank", F.col("before") + (F.col("c") + 1) / 2)
    got = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("plus")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)), F.lit(0)).alias("ties"), F.coalesce(F.sum(F.pow("c", F.lit(3)) - F.col("c")), F.lit(0.0)).alias("t"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48
    return got.select("n", "w_plus", "ties", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))


def p_greater(n: int, w_plus: float, ties: int, z: float | None) -> float:
    """The one-sided p-value: exact up to 50 differences without ties, else by the normal deviate; 1 where there is nothing to rank."""
    if not n or z is None:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return sum(ways[int(w_plus) :]) / 2**n
    return 0.5 * math.erfc(z / math.sqrt(2))


def with_p(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The result of :func:`wilcoxon` with p and whether it is below ``alpha``."""

    @F.udf("double")
    def p(n, w, ties, z):  # runs once for each test, not for each pair
        return p_greater(n, w, ties, z)

    return tested.withColumn("p", p("n", "w_plus", "ties", "z")).withColumn("significant", F.col("p") < alpha)


