"""Row numbers, running sums and exact percentiles of groups of any size.

A window over a group sorts the whole group in one task. Here rows are range-partitioned by group and
order together, so a group that holds a third of all rows is spread over many tasks; each partition then
only needs the sum of what lies before it, a table with a row for each partition and group in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.storage import task_count, written


def running(df: DataFrame, by: list[str], order: list[Column], weight: Column | None = None) -> DataFrame:
    """``df`` with ``before`` (sum of the weights of the rows of the group that come earlier) and ``total``.

    Without ``weight`` each row counts 1, so before is the row number from 0 and total the group's size.
    ``order`` must be total within a group for the numbers to be the same in each run. A null in ``by`` is
    a group of its own; an empty frame gives an empty frame. The columns __part, __w, __at are used.
    """
    n = task_count(df.sparkSession)
    keys = [F.col(f"`{c}`") for c in by]
    ranged = df.withColumn("__w", (F.lit(1) if weight is None else weight).cast("bigint")).repartitionByRange(n, *keys, *order)
    pinned, _ = written(ranged.withColumn("__part", F.spark_partition_id()))
    sums = pinned.groupBy(*keys, "__part").agg(F.sum("__w").alias("__s"))
    group = Window.partitionBy(*keys)  # of one row for each partition that has the group
    sums = sums.select(*keys, "__part", (F.sum("__s").over(group.orderBy("__part")) - F.col("__s")).alias("__at"), F.sum("__s").over(group).alias("total"))
    names = [f"__k{i}" for i in range(len(by))]
    sums = sums.select("__part", "__at", "total", *(k.alias(a) for k, a in zip(keys, names, strict=True)))
    same = F.col("a.__part") == F.col("b.__part")
    for k, a in zip(by, names, strict=True):
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.{a}"))
    local = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = pinned.withColumn("__in", F.sum("__w").over(local) - F.col("__w"))
    joined = inside.alias("a").join(sums.alias("b"), same)
    return joined.select("a.*", (F.col("b.__at") + F.col("a.__in")).alias("before"), F.col("b.total")).drop("__part", "__w", "__in")


def top_share(df: DataFrame, by: list[str], order: list[Column], keep: Column) -> DataFrame:
    """Rows of each group whose place satisfies ``keep``, an expression over ``before`` and ``total``."""
    return running(df, by, order).where(keep).drop("before", "total")


def shuffled(key: str | Column, seed: int = 42) -> Column:
    """A reproducible pseudo-random order of rows by their key, the same in any SQL engine that has md5."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def present(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have each of the columns, neither null nor NaN.

    One condition for each column: a single one over all of them, as ``dropna`` gives, makes the optimizer
    derive a constraint for each subset of columns that are renamed later.
    """
    for c in columns:
        rows = rows.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")))
    return rows


def long_form(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """(keep..., feature, x): one row for each listed column; NaN becomes null, and nulls give no row."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias("x")) for c in columns)))
    return df.select(*(F.col(f"`{k}`") for k in keep), each.alias("f")).select(*keep, "f.feature", "f.x").where("x IS NOT NULL")


def percentiles(long: DataFrame, by: list[str], probs: list[float], value: str = "x") -> DataFrame:
    """by..., n, p (array in order of ``probs``): exact percentiles with linear interpolation.

    Equal values are counted before they are ordered, and groups are spread over tasks, so neither a
    large group nor a frequent value is gathered in one place. Null values don't count; a group without
    values gives no row.
    """
    counted = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    placed = running(counted, by, [F.col(value)], F.col("__c"))
    pos = [(F.col("total") - 1) * F.lit(p) for p in probs]
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("__c"))
    lows, highs = [F.max(F.when(holds(F.floor(q)), F.col(value))) for q in pos], [F.max(F.when(holds(F.ceil(q)), F.col(value))) for q in pos]
    got = placed.groupBy(*by).agg(F.max("total").alias("n"), F.array(*lows).alias("__lo"), F.array(*highs).alias("__hi"))
    at = F.array(*((F.col("n") - 1) * F.lit(p) for p in probs))
    mixed = F.transform(F.arrays_zip("__lo", "__hi", at.alias("__q")), lambda s: s["__lo"] + (s["__hi"] - s["__lo"]) * (s["__q"] - F.floor(s["__q"])))
    return got.select(*by, "n", mixed.alias("p"))
