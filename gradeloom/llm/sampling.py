"""Problem 5: a sample whose categories follow target shares, by raking and weighted exponential keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.paths import domain_of
from gradeloom.storage import written

#: A key has this many bits at each of the two levels at which a category is cut.
BITS = 10


def rake(available: np.ndarray, target: np.ndarray, margins: list[np.ndarray], rounds: int = 500, close: float = 1e-9) -> tuple[np.ndarray, bool]:
    """Expected draws of each cell, and whether they settled: iterative proportional fitting of the targets to each margin in turn.

    ``margins`` give each cell's group in one margin; a group's total is the sum of its targets. Cells
    without rows get nothing and no cell more than it has, so a margin is met as far as its rows allow.
    """
    q = np.minimum(target, available).astype(float)
    for _ in range(rounds):
        before = q.copy()
        for group in margins:
            want = np.bincount(group, weights=target)
            have = np.bincount(group, weights=q)
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            q = np.minimum(q * factor[group], available)
        if np.abs(q - before).max(initial=0.0) <= close * max(1.0, q.sum()):
            return q, True
    return q, False


def repair(drawn: np.ndarray, need: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Rows to take from each cell: at least its need where it has the rows, then as near to ``size`` as that allows."""
    least = np.minimum(need, available)
    take = np.clip(drawn, least, available)
    spare = take - least if take.sum() > size else available - take
    gap = min(abs(int(take.sum()) - size), int(spare.sum()))
    if gap:
        exact = spare * (gap / spare.sum())
        part = np.floor(exact).astype(int)
        order = np.argsort(-(exact - part), kind="stable")
        part[order[: gap - part.sum()]] += 1
        take = take - part if take.sum() > size else take + part
    return take


def draw(rows: DataFrame, shares: DataFrame, every: int = 5, seed: int = 42, key: str = "qa_id") -> tuple[DataFrame, DataFrame]:
    """(sample, report) over the categories (label, domain) of ``shares``.

    n is the number of distinct ids with label 0, 1 or 2 and a fileid, the sample size s is floor(n / every),
    and a category needs max(min_rows, ceil(share_bp * s / 10000)) rows. Each row has the key -ln(u) / w with
    u from a hash of its id and w its category's raked draws over its rows; the s smallest keys of all
    are drawn. Categories below their need are then filled with their next keys, and those above give up
    their last, so minimums come before the size. Ties are broken by id; null labels, ids or fileids and
    other categories are never drawn; null targets count as 0.

    sample: (key, label, domain_name). report: (label, domain_name, available, needed, target, raked, converged, drawn, gap),
    one row for each category of ``shares``: target is its share of the sample, raked what the fitting to the
    margins of label and domain makes of it, converged whether that settled. :func:`residuals` sums it up by
    margin. ``shares`` is the table of targets and read to the driver; of the
    rows only counts by category and key prefix are (2^BITS for each category).
    """
    spark = rows.sparkSession
    listed = shares.where("label IS NOT NULL AND domain_name IS NOT NULL").groupBy("label", "domain_name").agg(F.sum(F.coalesce("share_bp", F.lit(0))).alias("share_bp"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows")).orderBy("label", "domain_name").collect()
    m = len(listed)
    cells = spark.createDataFrame([(i, r.label, r.domain_name) for i, r in enumerate(listed)], "cell int, label int, domain_name string")
    usable = rows.where(F.col(key).isNotNull() & F.col("label").isin(0, 1, 2) & F.col("fileid").isNotNull()).select(F.col(key).alias("id"), F.col("label").cast("int").alias("label"), domain_of("fileid").alias("domain_name"))
    placed = usable.join(F.broadcast(cells), ["label", "domain_name"], "left").select("id", F.coalesce("cell", F.lit(-1)).alias("cell"))
    placed, _ = written(placed.groupBy("id").agg(F.max("cell").alias("cell")).withColumn("h", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1)))

    level1 = F.shiftright("h", 63 - BITS).cast("int")
    level2 = F.shiftright("h", 63 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    total, counts = 0, np.zeros((m, 1 << BITS), np.int64)
    for r in placed.groupBy("cell", level1.alias("b")).count().toLocalIterator():
        total += r["count"]
        if r.cell >= 0:
            counts[r.cell, r.b] = r["count"]
    available, size = counts.sum(axis=1), total // every
    bp = np.array([r.share_bp for r in listed], np.int64)
    need = np.maximum(np.array([r.min_rows for r in listed], np.int64), -(-bp * size // 10_000))
    groups = [np.unique([str(x) for x in values], return_inverse=True)[1] for values in ([r.label for r in listed], [r.domain_name for r in listed])] if m else []
    target = bp * size / 10_000
    quota, converged = rake(available, target, groups) if m else (np.zeros(0), True)
    weight = np.divide(quota, available, out=np.zeros(m), where=available > 0)
    limit = (-np.expm1(-_threshold(counts, weight, size) * weight) * 2.0**63).clip(0, 2.0**63 - 1024)
    # The prefixes only find the threshold; what lies below it is counted row by row.
    limits = spark.createDataFrame([(i, int(x)) for i, x in enumerate(limit)], "cell int, lim bigint")
    below = {r.cell: r["count"] for r in placed.join(F.broadcast(limits), "cell").where("h < lim").groupBy("cell").count().collect()}
    drawn = np.array([below.get(i, 0) for i in range(m)], np.int64)
    take = repair(drawn, need, available, size) if m else drawn

    # A category's smallest keys are its smallest hashes: u falls as the hash rises. Cut it at two levels of prefix, then rank the few rows left.
    cum = counts.cumsum(axis=1)
    first = [int(np.searchsorted(cum[i], take[i], "left")) if take[i] < available[i] else 1 << BITS for i in range(m)]
    rest = [int(take[i] - (cum[i, first[i] - 1] if first[i] else 0)) if first[i] < 1 << BITS else 0 for i in range(m)]
    cut1 = spark.createDataFrame([(i, first[i], rest[i]) for i in range(m)], "cell int, first int, rest int")
    held = placed.where("cell >= 0").join(F.broadcast(cut1), "cell")
    counts2 = np.zeros((m, 1 << BITS), np.int64)
    for r in held.where(level1 == F.col("first")).groupBy("cell", level2.alias("b")).count().toLocalIterator():
        counts2[r.cell, r.b] = r["count"]
    cum2 = counts2.cumsum(axis=1)
    second = [int(np.searchsorted(cum2[i], rest[i], "left")) for i in range(m)]
    last = [int(rest[i] - (cum2[i, min(second[i], (1 << BITS)) - 1] if second[i] else 0)) for i in range(m)]
    cut2 = spark.createDataFrame([(i, first[i], second[i], last[i]) for i in range(m)], "cell int, first int, second int, last int")
    held = placed.where("cell >= 0").join(F.broadcast(cut2), "cell").withColumn("a", level1).withColumn("b", level2)
    sure = held.where("a < first OR (a = first AND b < second)").select("id", "cell")
    edge = held.where("a = first AND b = second")
    rank = F.expr("row_number() OVER (PARTITION BY cell ORDER BY h, id)")
    chosen = sure.unionByName(edge.select("id", "cell", "last", rank.alias("r")).where("r <= last").select("id", "cell"))
    sample = chosen.join(F.broadcast(cells), "cell").select(F.col("id").alias(key), "label", "domain_name")
    got = chosen.groupBy("cell").count()
    wanted = spark.createDataFrame([(i, r.label, r.domain_name, int(available[i]), int(need[i]), float(target[i]), float(quota[i]), converged) for i, r in enumerate(listed)], "cell int, label int, domain_name string, available bigint, needed bigint, target double, raked double, converged boolean")
    report = wanted.join(got, "cell", "left").select("label", "domain_name", "available", "needed", "target", "raked", "converged", F.coalesce("count", F.lit(0)).alias("drawn"))
    return sample, report.withColumn("gap", F.greatest(F.col("needed") - F.col("drawn"), F.lit(0)))


def _threshold(counts: np.ndarray, weight: np.ndarray, size: int) -> float:
    """The threshold t that about ``size`` keys -ln(u) / w are below, by the counts of hash prefixes.

    u runs from 1 down to 0 as the hash rises, so a threshold t keeps the hashes below 1 - exp(-t w).
    """
    if not weight.sum():
        return 0.0
    cum = np.concatenate([np.zeros((len(counts), 1), np.int64), counts.cumsum(axis=1)], axis=1)
    steps, rows = counts.shape[1], np.arange(len(counts))

    def kept(t: float) -> float:
        at = -np.expm1(-t * weight) * steps
        low = np.minimum(at.astype(int), steps - 1)
        return (cum[rows, low] + (at - low) * counts[rows, low]).sum()

    lo, hi = 0.0, 1.0
    while kept(hi) < min(size, counts[weight > 0].sum()) and hi < 1e6:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) < size else (lo, mid)
    return hi


def residuals(report: DataFrame) -> DataFrame:
    """margin, value, target, drawn, residual (drawn less target), short: the gaps left in each margin, for every label and domain."""
    each = [report.groupBy(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")).agg(F.round(F.sum("target"), 6).alias("target"), F.sum("drawn").alias("drawn"), F.sum("gap").alias("short")) for m in ("label", "domain_name")]
    return each[0].unionByName(each[1]).select("margin", "value", "target", "drawn", F.round(F.col("drawn") - F.col("target"), 6).alias("residual"), "short")


def short_categories(report: DataFrame) -> DataFrame:
    """label, domain_name of each category with fewer rows than it needs."""
    return report.where("gap > 0").select("label", "domain_name")
