"""Relevance of rows to a reference set, balanced samples, top thirds and few-shot sets (survey J2 to J7, W3 to W11, M4, M5)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.profile import squared
from gradeloom.operators.ranking import running, shuffled, top_share

#: Rows compared at once: queries of a block, and rows they are held against.
QUERY_BLOCK, DATA_BLOCK = 2_048, 65_536
DECIMALS = 9


def balanced(rows: DataFrame, label: str = "label", key: str = "qa_id", seed: int = 42) -> DataFrame:
    """As many rows of each label present as the rarest has, taken in a reproducible random order: W3. Keys must be distinct."""
    least = rows.groupBy(label).count().agg(F.min("count").alias("__least"))
    ranked = running(rows, [label], [shuffled(key, seed), F.col(key)]).join(F.broadcast(least))  # one row
    return ranked.where(F.col("before") < F.col("__least")).drop("before", "total", "__least")


def top_third(rows: DataFrame, by: list[str], order: list, parts: int = 3) -> DataFrame:
    """The first total // parts rows of each group in the order given: W4."""
    return top_share(rows, by, order, F.col("before") < F.floor(F.col("total") / parts))


def standardised(rows: DataFrame, columns: list[str], stds: dict[str, float], name: str = "v") -> DataFrame:
    """Rows with a vector: each feature over its deviation (0: taken as 1), and these over their sum (0: left as they are)."""
    scaled = F.array(*(F.col(f"`{c}`") / F.lit(float(stds[c] or 1.0)) for c in columns))
    total = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("__s", scaled).withColumn("__t", total).withColumn(name, F.when(F.col("__t") == 0, F.col("__s")).otherwise(F.transform("__s", lambda x: x / F.col("__t")))).drop("__s", "__t")


def neighbour_rank(train: DataFrame, reference: DataFrame, weights: Iterable[float], first: int = 5, queries: DataFrame | None = None, reduce: str = "sum") -> DataFrame:
    """qa_id, refs, score: minus the mean place (from 0) of a row's ``first`` nearest reference rows among all rows of its label.

    ``train`` and ``reference`` are (qa_id, label, v); the row itself counts as one of its label, equal
    distances (to 9 decimals) put training rows before reference rows and these in order of id. The distance is the weighted sum of squared
    differences, or with ``reduce='first'`` only its first term. Fewer reference rows than ``first``: the mean of
    those there are; none: null. ``queries`` (default: all of ``train``) are held against all rows, block by
    block: first for their nearest reference rows, then to count the training rows before each of these. No
    pair of rows leaves a block. Ids must be distinct.
    """
    if reduce not in ("sum", "first"):
        raise ValueError("reduce must be 'sum' or 'first'")
    w = np.asarray(list(weights), float)
    if reduce == "first":
        w = np.where(np.arange(len(w)) == 0, w, 0.0)
    queries = train if queries is None else queries
    root = np.sqrt(w)

    def vectors(t: pa.Table, c: str = "v") -> np.ndarray:
        return t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(x)))
        for j in np.flatnonzero(w):
            d = (q[:, j] * root[j])[:, None] - (x[:, j] * root[j])[None]
            out += d * d
        return np.round(out, DECIMALS)

    sizes = lambda df: {r.label: r["count"] for r in df.groupBy("label").count().collect()}  # a row for each label
    n_q = sizes(queries)

    def cogrouped(asked: DataFrame, data: DataFrame, run, schema: str) -> DataFrame:
        """Every query block meets every data block of its label once; both numbers come from hashes of ids."""
        n_d = sizes(data)
        table = lambda counts, block, of="label": F.coalesce(F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(-(-v // block)).cast("bigint"))))[F.col(of)], F.lit(1).cast("bigint")) if counts else F.lit(1).cast("bigint")
        qs, ds = table(n_q, QUERY_BLOCK), table(n_d, DATA_BLOCK)
        left = asked.select(F.col("qa_id").alias("q_id"), F.col("label").alias("q_label"), F.col("v").alias("q_v"), *(F.col(c).alias(c) for c in asked.columns if c == "cuts"), F.pmod(F.xxhash64("qa_id"), qs).alias("q_b")).withColumn("q_d", F.explode(F.sequence(F.lit(0).cast("bigint"), table(n_d, DATA_BLOCK, "q_label") - 1)))
        right = data.withColumn("db", F.pmod(F.xxhash64("qa_id"), ds)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), qs - 1)))
        return left.groupBy("q_label", "q_b", "q_d").cogroup(right.groupBy("label", "qb", "db")).applyInArrow(run, schema)

    def nearest(q: pa.Table, x: pa.Table) -> pa.Table:
        out = {"qa_id": [], "d": [], "ref": []}
        if q.num_rows and x.num_rows:
            qv, xv, qi, xi = vectors(q, "q_v"), vectors(x), q["q_id"].to_numpy(), x["qa_id"].to_numpy()
            for i in range(0, len(qv), 64):
                d = distances(qv[i : i + 64], xv)
                for row, line in enumerate(d):
                    cut = np.partition(line, min(first, len(line)) - 1)[min(first, len(line)) - 1]
                    at = np.flatnonzero(line <= cut)
                    at = at[np.lexsort((xi[at], line[at]))][:first]
                    out["qa_id"] += [int(qi[i + row])] * len(at)
                    out["d"] += line[at].tolist()
                    out["ref"] += xi[at].tolist()
        return pa.table({"qa_id": pa.array(out["qa_id"], pa.int64()), "d": pa.array(out["d"], pa.float64()), "ref": pa.array(out["ref"], pa.int64())})

    close = cogrouped(queries, reference, nearest, "qa_id bigint, d double, ref bigint").withColumn("r", F.expr("row_number() OVER (PARTITION BY qa_id ORDER BY d, ref)")).where(F.col("r") <= first)
    cuts = close.groupBy("qa_id").agg(F.array_sort(F.collect_list("d")).alias("cuts"))  # at most ``first`` for each query
    asked = queries.join(cuts, "qa_id")

    def before(q: pa.Table, x: pa.Table) -> pa.Table:
        ids, at, n = [], [], []
        if q.num_rows and x.num_rows:
            qv, xv, qi, limits = vectors(q, "q_v"), vectors(x), q["q_id"].to_pylist(), q["cuts"].to_pylist()
            for i in range(0, len(qv), 64):
                for row, line in enumerate(distances(qv[i : i + 64], xv)):
                    for k, cut in enumerate(limits[i + row]):
                        ids.append(qi[i + row])
                        at.append(k)
                        n.append(int((line <= cut).sum()))
        return pa.table({"qa_id": pa.array(ids, pa.int64()), "k": pa.array(at, pa.int32()), "n": pa.array(n, pa.int64())})

    places = cogrouped(asked, train, before, "qa_id bigint, k int, n bigint").groupBy("qa_id", "k").agg(F.sum("n").alias("n"))
    score = places.groupBy("qa_id").agg(F.count("*").alias("refs"), (-F.avg(F.col("n") + F.col("k"))).alias("score"))
    return queries.select("qa_id").join(score, "qa_id", "left").select("qa_id", F.coalesce("refs", F.lit(0)).alias("refs"), "score")


def match_clusters(rows: DataFrame, centres: DataFrame, columns: list[str], weights: dict[str, float], stds: dict[str, float]) -> DataFrame:
    """Rows with ``matched_cluster``, the nearest centre of their label (equal distances: the smaller number), and ``score``, minus its distance.

    The distance is the sum of w ((x - y) / std)² over the sum of the weights. ``centres`` is (label, cluster,
    centre), a table of as many rows as clusters, and held in one array for each label; a label without any gives null.
    """
    total = sum(weights[c] for c in columns)
    factor = [np.sqrt(weights[c] / total) / (stds[c] or 1.0) for c in columns]
    scaled = lambda v: F.zip_with(v, F.array(*(F.lit(float(f)) for f in factor)), lambda x, f: x * f)
    of_label = centres.select("label", F.struct("cluster", scaled(F.col("centre")).alias("c")).alias("c")).groupBy("label").agg(F.sort_array(F.collect_list("c")).alias("__all"))
    own = rows.withColumn("__v", scaled(F.array(*(F.col(f"`{c}`") for c in columns)))).join(F.broadcast(of_label), "label", "left")
    best = F.array_min(F.transform("__all", lambda c: F.struct(F.round(squared(F.col("__v"), c["c"]), DECIMALS).alias("d"), c["cluster"].alias("cluster"))))
    return own.withColumn("__b", best).withColumns({"matched_cluster": F.col("__b.cluster"), "score": -F.col("__b.d")}).drop("__all", "__v", "__b")


def compare_means(samples: dict[str, DataFrame], reference: str, weights: DataFrame) -> DataFrame:
    """feature, mean_<sample>..., diff_<sample>..., and a row 'total' with the sums of the differences over the sum of the weights.

    ``samples`` are long tables (feature, x); ``weights`` is (feature, weight). Features without a weight row are left out.
    """
    others = [s for s in samples if s != reference]
    out = weights.select("feature", "weight")
    for name, long in samples.items():
        out = out.join(long.groupBy("feature").agg(F.avg("x").alias(f"mean_{name}")), "feature", "left")
    out = out.withColumns({f"diff_{s}": F.abs(F.col(f"mean_{s}") - F.col(f"mean_{reference}")) for s in others})
    total = out.agg(*((F.sum(f"diff_{s}") / F.sum("weight")).alias(f"diff_{s}") for s in others))
    none = [F.lit(None).cast("double").alias(f"mean_{s}") for s in samples]
    cols = [*(f"mean_{s}" for s in samples), *(f"diff_{s}" for s in others)]
    return out.select("feature", *cols).unionByName(total.select(F.lit("total").alias("feature"), *none, *(f"diff_{s}" for s in others)))


def split(rows: DataFrame, by: list[str], order: list, share: float = 0.2) -> DataFrame:
    """Rows with ``selected``: the first floor(share · total) rows of each group in the order given: W7."""
    return running(rows, by, order).withColumn("selected", F.col("before") < F.floor(F.col("total") * share)).drop("before", "total")


def common_keys(rows: DataFrame, keys: list[str], label: str = "label", labels=(0, 1, 2)) -> DataFrame:
    """The keys that each of the labels has: O2."""
    return rows.where(F.col(label).isin(*labels)).groupBy(*keys).agg(F.countDistinct(label).alias("__n")).where(F.col("__n") == len(labels)).drop("__n")


def fewshot(rows: DataFrame, number: int = 6, seed: int = 42, labels=(2, 1, 0)) -> DataFrame:
    """place, context, question, domain_name, answers: a few-shot set of at most ``number`` examples.

    ``rows`` is (label, domain_name, context, question, answer, score, qa_id). A prompt must have an answer of each
    label; of each context only its first question in text order is taken. In a random order that is the same each time, each domain gives number // 3 prompts, domains in order,
    and the first ``number`` of these are the set (with more than three domains only the first ones are in it). An
    example has the best answer of each label: highest score, then smallest id.
    """
    best = rows.groupBy("context", "question", "label").agg(F.min_by(F.struct("answer", "domain_name"), F.struct(-F.col("score"), F.col("qa_id"))).alias("b"))
    every = best.where(F.col("label").isin(*labels)).groupBy("context", "question").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("label", F.col("b.answer").alias("answer"))))).alias("answers"),  # one for each label
        F.max(F.when(F.col("label") == labels[0], F.col("b.domain_name"))).alias("domain_name"),
    )
    all_labels = every.where(F.size("answers") == len(labels))
    firsts = all_labels.groupBy("context").agg(F.min_by(F.struct("question", "answers", "domain_name"), "question").alias("f")).select("context", "f.*")
    mixed = firsts.withColumn("__o", shuffled(F.concat_ws("\n", "context", "question"), seed))
    per = mixed.withColumn("__r", F.expr("row_number() OVER (PARTITION BY domain_name ORDER BY __o)")).where(F.col("__r") <= number // 3)
    few = per.orderBy("domain_name", "__o").limit(number)
    return few.withColumn("place", F.expr("row_number() OVER (ORDER BY domain_name, __o)")).select("place", "context", "question", "domain_name", "answers")  # of ``number`` rows


def leaks(a: DataFrame, b: DataFrame, column: str = "context") -> DataFrame:
    """leaked: how many values of ``column`` both sets have; 0 is as it should be: O3."""
    return a.select(column).distinct().join(b.select(column), column, "left_semi").agg(F.count("*").alias("leaked"))
