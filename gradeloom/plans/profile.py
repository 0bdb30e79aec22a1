"""Queries on profiles of features, with their SQL: survey P1, P2, P6, P7, A1 to A7, W1, W2, M1 to M3."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import profile as O
from gradeloom.operators.ranking import long_form
from gradeloom.plans import views

PROBS = [0.25, 0.5, 0.75]
#: Means of few values often end in a half, which engines round differently; this settles it.
_TIE = 1e-12
_LONG = views.long_sql(views.FEATURES, "qa_id, label")
_P = ", ".join(f"round(quantile_cont(x, {p}), 9) AS p{int(p * 100)}" for p in PROBS)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(views.features(spark, sf_dir), ["qa_id", "label"], views.feature_columns(spark, sf_dir))


def _quartiles(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *(F.round(F.col("p")[i], 9).alias(f"p{int(q * 100)}") for i, q in enumerate(PROBS)))


def lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label of the English rows: P1."""
    return views.qa(spark, sf_dir).where("lang = 'en'").select("qa_id", "label").dropDuplicates(["qa_id"])


def class_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice, rows: the slices all, 0, 1, 2 in one pass: P2."""
    return O.slices(views.features(spark, sf_dir).select("label")).groupBy("slice").agg(F.count("*").alias("rows"))


def legacy_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features under their older names if only those are there: P6."""
    rows = views.features(spark, sf_dir).select("qa_id", F.col("recall_2gram_fc_answer").alias("recall_2gram_FC_answer"), F.col("recall_2gram_nc_answer").alias("recall_2gram_NC_answer"))
    old = {"recall_2gram_FC_answer": "recall_2gram_fc_answer", "recall_2gram_NC_answer": "recall_2gram_nc_answer"}
    return rows.withColumnsRenamed({a: b for a, b in old.items() if a in rows.columns})


def feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, <feature>_mean: A1."""
    names = views.feature_columns(spark, sf_dir)
    got = O.MEAN.over(views.features(spark, sf_dir), ["label"], names)
    return got.select("label", *(F.round(f"{c}_mean", 9).alias(f"{c}_mean") for c in names))


def feature_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<feature>_std over all rows: A4."""
    names = views.feature_columns(spark, sf_dir)
    got = O.STD.over(views.features(spark, sf_dir), [], names)
    return got.select(*(F.round(f"{c}_std", 6).alias(f"{c}_std") for c in names))


def feature_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, n, p25, p50, p75 over all rows: A2."""
    from gradeloom.operators.ranking import percentiles

    return _quartiles(percentiles(_long(spark, sf_dir).select("feature", "x"), ["feature"], PROBS), "feature")


def profile_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice, feature, n, mean, p25, p50, p75: A7 with one cluster."""
    got = O.profile(views.features(spark, sf_dir), views.feature_columns(spark, sf_dir))
    return _quartiles(got, "slice", "feature", F.round(F.col("mean") + _TIE, 9).alias("mean"))


def profile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice, cluster, feature, n, mean, p25, p50, p75: A7 with a cluster column, the question type."""
    names = [c for c in views.feature_columns(spark, sf_dir) if c != "question_type_label"]
    rows = views.features(spark, sf_dir).where("question_type_label IS NOT NULL").withColumn("cluster", F.floor("question_type_label"))
    return _quartiles(O.profile(rows, names, "cluster"), "slice", "cluster", "feature", F.round(F.col("mean") + _TIE, 9).alias("mean"))


def percentile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, px, py, v for answer length against the overlap with the context: A3."""
    got = O.percentile_matrix(views.features(spark, sf_dir), ["label"], "answer_length", "recall_1gram_context_answer", PROBS)
    return got.select("label", "px", "py", F.round("v", 9).alias("v"))


_MATRIX = f"""
WITH r AS (SELECT label, answer_length AS x, recall_1gram_context_answer AS y FROM {views.FEATURES} WHERE answer_length IS NOT NULL),
c AS (SELECT label, unnest([0.25, 0.5, 0.75])::DOUBLE AS px, unnest(quantile_cont(x, [0.25, 0.5, 0.75])) AS cut FROM r GROUP BY label),
m AS (SELECT label, px, quantile_cont(y, [0.25, 0.5, 0.75]) AS q FROM r JOIN c USING (label) WHERE x <= cut GROUP BY label, px)
SELECT label, px, unnest([0.25, 0.5, 0.75])::DOUBLE AS py, round(unnest(q), 9) AS v FROM m"""


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label and the features scaled by label: M1."""
    names = views.feature_columns(spark, sf_dir)
    got = O.minmax(views.features(spark, sf_dir).select("qa_id", "label", *names), names, ["label"])
    return got.select("qa_id", "label", *(F.round(c, 6).alias(c) for c in names))


_MINMAX = f"SELECT qa_id, label, {', '.join(f'round(CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END, 6) AS {c}' for c in views.NAMES)} FROM {views.FEATURES} WINDOW w AS (PARTITION BY label)"


def first_n_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label: the first 100 English rows of each label, null included, by id: W1. Each task passes on no more than that."""
    rows = views.qa(spark, sf_dir).where("lang = 'en'").select("qa_id", "label").distinct()
    return rows.withColumn("r", F.expr("row_number() OVER (PARTITION BY label ORDER BY qa_id)")).where("r <= 100").select("qa_id", "label")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label: 5,000 rows in a random order that is the same each time: W2."""
    return O.sample(views.features(spark, sf_dir).select("qa_id", "label"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, n, least: rows of each label and the smallest of these counts among 0, 1, 2: A5."""
    counts = views.qa(spark, sf_dir).select("qa_id", "label").dropDuplicates(["qa_id"]).groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.where("label IN (0, 1, 2)").agg(F.min("n").alias("least"))))


def _centres(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of the smallest ids as centres."""
    first = rows.orderBy("qa_id").limit(k)
    return first.select(F.expr("CAST(row_number() OVER (ORDER BY qa_id) - 1 AS INT)").alias("cluster"), F.col("v").alias("centre"))


def _scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.feature_columns(spark, sf_dir)
    rows = O.minmax(views.complete(views.features(spark, sf_dir), names).select("qa_id", "label", *names), names)
    return rows.select("qa_id", "label", F.array(*(F.round(c, 6) for c in names)).alias("v"))


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, n, inertia: one step of k-means from ten given centres over all complete rows, scaled: M2 and W9."""
    rows = _scaled_vectors(spark, sf_dir)
    return O.assign_clusters(rows, "v", _centres(rows)).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 4).alias("inertia"))


def kmeans_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, n, centre: the means after that step."""
    rows = _scaled_vectors(spark, sf_dir)
    return O.lloyd_step(rows, "v", _centres(rows)).select("cluster", "n", F.transform("centre", lambda x: F.round(x + _TIE, 9)).alias("centre"))


_scaled = f"round(CASE WHEN max({{0}}) OVER () > min({{0}}) OVER () THEN ({{0}} - min({{0}}) OVER ()) / (max({{0}}) OVER () - min({{0}}) OVER ()) ELSE 0 END, 6)"
_VECTORS = f"SELECT qa_id, label, [{', '.join(_scaled.format(c) for c in views.NAMES)}] AS v FROM {views.complete_sql()}"
_ASSIGNED = f"""
WITH r AS ({_VECTORS}),
c AS (SELECT (row_number() OVER (ORDER BY qa_id) - 1)::INT AS cluster, v AS centre FROM (SELECT * FROM r ORDER BY qa_id LIMIT 10)),
d AS (SELECT qa_id, v, cluster, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - centre[i]) * (v[i] - centre[i]))) AS distance FROM r, c),
b AS (SELECT qa_id, v, cluster, distance FROM d QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY distance, cluster) = 1)"""


def kmeans_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice, cluster, feature, n, mean, p25, p50, p75: a seeded sample of each slice, scaled, in ten clusters, profiled on the original values: M2, A7."""
    names = views.feature_columns(spark, sf_dir)
    rows, out = views.complete(views.features(spark, sf_dir), names), None
    for name, label in O.SLICES.items():
        picked = O.sample(rows if label is None else rows.where(F.col("label") == label))
        placed = O.kmeans(O.minmax(picked.select("qa_id", *names), names), names, restarts=3).select("qa_id", "cluster")
        long = long_form(picked.join(placed, "qa_id"), ["cluster"], names).withColumn("slice", F.lit(name))
        out = long if out is None else out.unionByName(long)
    from gradeloom.operators.ranking import percentiles

    by = ["slice", "cluster", "feature"]
    means = out.groupBy(*by).agg(F.round(F.avg("x"), 9).alias("mean"))
    return _quartiles(percentiles(out, by, PROBS).join(means, by), *by, "mean")


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of, mean: mean silhouette of a seeded sample by question type, and by eight random labels for comparison: M3."""
    names = views.feature_columns(spark, sf_dir)
    rows = O.minmax(O.sample(views.complete(views.features(spark, sf_dir), names)).select("qa_id", *names), names)
    v = rows.select("qa_id", F.floor(F.round("question_type_label", 6) * 7 + 0.5).cast("int").alias("kind"), O.random_labels("qa_id").alias("random"), F.array(*(F.round(c, 6) for c in names)).alias("v"))
    each = [O.silhouette(v, "qa_id", "v", c).agg(F.round(F.avg("silhouette"), 6).alias("mean")).select(F.lit(c).alias("of"), "mean") for c in ("kind", "random")]
    return each[0].unionByName(each[1])


_SILHOUETTE = f"""
WITH r AS (SELECT qa_id, [{', '.join(_scaled.format(c) for c in views.NAMES)}] AS v FROM (SELECT * FROM {views.complete_sql()} ORDER BY md5('42-' || qa_id), qa_id LIMIT 5000)),
p AS (SELECT qa_id, v, floor(v[{views.NAMES.index('question_type_label') + 1}] * 7 + 0.5)::INT AS kind, (('0x' || md5('42-' || qa_id)[:8])::BIGINT % 8)::INT AS random FROM r),
l AS (SELECT 'kind' AS "of", qa_id, v, kind AS c FROM p UNION ALL SELECT 'random', qa_id, v, random FROM p),
d AS (SELECT a."of", a.qa_id, a.c, b.c AS k, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM l a JOIN l b ON a."of" = b."of" GROUP BY ALL),
s AS (SELECT "of", qa_id, max(CASE WHEN c = k AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> k THEN s / n END) AS b FROM d GROUP BY ALL)
SELECT "of", round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS mean FROM s GROUP BY 1"""

_NAMED: dict[str, tuple[Callable, str | None]] = {
    "lang_filter": (lang_filter, f"SELECT qa_id, label FROM {views.QA} WHERE lang = 'en'"),
    "class_slices": (class_slices, f"SELECT slice, count(*) AS rows FROM (SELECT unnest(['all', label::VARCHAR]) AS slice FROM {views.FEATURES}) GROUP BY slice"),
    "legacy_rename": (legacy_rename, f"SELECT qa_id, recall_2gram_fc_answer, recall_2gram_nc_answer FROM {views.FEATURES}"),
    "label_counts": (label_counts, f"WITH c AS (SELECT label, count(*) AS n FROM {views.QA} GROUP BY label) SELECT label, n, (SELECT min(n) FROM c WHERE label IN (0, 1, 2)) AS least FROM c"),
    "feature_mean": (feature_mean, f"SELECT label, {', '.join(f'round(coalesce(avg({c}), 0), 9) AS {c}_mean' for c in views.NAMES)} FROM {views.FEATURES} GROUP BY label"),
    "feature_std": (feature_std, f"SELECT {', '.join(f'round(coalesce(stddev_pop({c}), 0), 6) AS {c}_std' for c in views.NAMES)} FROM {views.FEATURES}"),
    "feature_percentiles": (feature_percentiles, f"SELECT feature, count(*) AS n, {_P} FROM {_LONG} GROUP BY feature"),
    "profile_grouping_sets": (profile_grouping_sets, f"SELECT slice, feature, count(*) AS n, round(avg(x) + 1e-12, 9) AS mean, {_P} FROM (SELECT unnest(['all', label::VARCHAR]) AS slice, feature, x FROM {_LONG}) GROUP BY slice, feature"),
    "profile_clusters": (profile_clusters, f"SELECT slice, cluster, feature, count(*) AS n, round(avg(x) + 1e-12, 9) AS mean, {_P} FROM (SELECT unnest(['all', label::VARCHAR]) AS slice, floor(question_type_label)::BIGINT AS cluster, feature, x FROM {views.long_sql(f'(SELECT * FROM {views.FEATURES} WHERE question_type_label IS NOT NULL)', 'label, question_type_label', [c for c in views.NAMES if c != 'question_type_label'])}) GROUP BY ALL"),
    "percentile_matrix": (percentile_matrix, _MATRIX),
    "minmax_scale": (minmax_scale, _MINMAX),
    "first_n_per_label": (first_n_per_label, f"SELECT qa_id, label FROM {views.QA} WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY label ORDER BY qa_id) <= 100"),
    "seeded_sample": (seeded_sample, f"SELECT qa_id, label FROM {views.FEATURES} ORDER BY md5('42-' || qa_id), qa_id LIMIT 5000"),
    "kmeans_assign": (kmeans_assign, f"{_ASSIGNED} SELECT cluster, count(*) AS n, round(sum(distance), 4) AS inertia FROM b GROUP BY cluster"),
    "kmeans_centres": (kmeans_centres, f"{_ASSIGNED}, m AS (SELECT cluster, i, count(*) AS n, round(avg(x) + 1e-12, 9) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM b) GROUP BY cluster, i) SELECT cluster, max(n) AS n, list(m ORDER BY i) AS centre FROM m GROUP BY cluster"),
    "kmeans_profile": (kmeans_profile, None),
    "silhouette": (silhouette, _SILHOUETTE),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for name, (q, _) in _NAMED.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in _NAMED.items() if sql}
