"""Queries on evaluation, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import evaluate as O
from gradeloom.plans import relevance, views


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y_true, y_pred, n."""
    return O.confusion(views.predictions(spark, sf_dir))


def confusion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hits, n: A10."""
    return O.totals(confusion(spark, sf_dir))


def confusion_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y_true, y_pred, i: N3."""
    return O.expand(confusion(spark, sf_dir))


def eval_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, y_true, y_pred: W12, three classes."""
    return O.balanced_classes(views.predictions(spark, sf_dir))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, accuracy, precision, recall, kappa over all predictions and over those on the baseline third: M6 to M8."""
    rows = views.predictions(spark, sf_dir)
    picked = relevance.top_third_baseline(spark, sf_dir).select("qa_id")
    each = [O.metrics(df).withColumn("name", F.lit(n)) for n, df in (("all", rows), ("selected", rows.join(picked, "qa_id", "left_semi")))]
    return each[0].unionByName(each[1]).select("name", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "kappa")))


def qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kappa over all predictions: M8."""
    return O.kappa(confusion(spark, sf_dir)).select(F.round("kappa", 6).alias("kappa"))


def e3_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, pos, diff: M10, S8."""
    return O.curve(views.runs(spark, sf_dir)).select("i", "pos", F.round("diff", 6).alias("diff"))


def e3_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, mean: mean difference of each pair of runs."""
    return O.curve(views.runs(spark, sf_dir)).groupBy("i").agg(F.round(F.avg("diff"), 6).alias("mean"))


def e3_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, a1, a2: A11."""
    return O.best_worst(views.runs(spark, sf_dir)).select("pos", F.round("a1", 6).alias("a1"), F.round("a2", 6).alias("a2"))


def e3_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, pos, x, y in random pairs: J8."""
    return O.paired(views.runs(spark, sf_dir), shuffle=True)


def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairing, n, w_plus, ties, z of both pairings: M9, W13."""
    runs = views.runs(spark, sf_dir)
    each = [O.wilcoxon(O.paired(runs, shuffle=s)).withColumn("pairing", F.lit(n)) for n, s in (("order", False), ("random", True))]
    return each[0].unionByName(each[1]).select("pairing", "n", F.round("w_plus", 6).alias("w_plus"), "ties", F.round("z", 6).alias("z"))


def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, w_plus, z, p, significant of the runs in order. The engines have no error function, so p has no SQL."""
    return O.with_p(O.wilcoxon(O.paired(views.runs(spark, sf_dir)))).select("n", "w_plus", "z", "p", "significant")


_MATRIX = f"SELECT y_true, y_pred, count(*) AS n FROM {views.PREDICTIONS} GROUP BY ALL"
_SELECTED = f"(SELECT * FROM {views.PREDICTIONS} SEMI JOIN {relevance.THIRD} t USING (qa_id))"


def _balanced(source: str, classes: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('42-' || qa_id), qa_id) AS r FROM {source} WHERE y_true IN {classes}) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {source} WHERE y_true IN {classes} GROUP BY y_true)))"


def _metrics(name: str, source: str) -> str:
    three, two = _balanced(source, "(0, 1, 2)"), _balanced(source, "(0, 2)")
    return f"""SELECT '{name}' AS name, round(accuracy, 6) AS accuracy, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(kappa, 6) AS kappa FROM
(SELECT avg((y_true = y_pred)::INT) AS accuracy, 1 - avg((y_true - y_pred) ** 2) / (avg(y_true * y_true) + avg(y_pred * y_pred) - 2 * avg(y_true) * avg(y_pred)) AS kappa FROM {three}),
(SELECT sum((y_true = 2 AND y_pred = 2)::INT) / sum((y_pred = 2)::INT) AS precision_, sum((y_true = 2 AND y_pred = 2)::INT) / sum((y_true = 2)::INT) AS recall_ FROM {two})"""


_CUT = f"c AS (SELECT * FROM {views.RUNS} WHERE pos < (SELECT min(m) FROM (SELECT run, max(pos) + 1 AS m FROM {views.RUNS} GROUP BY run)))"
_PAIRED = {
    "order": "SELECT *, dense_rank() OVER (PARTITION BY arm ORDER BY run)::INT - 1 AS i FROM c",
    "random": "SELECT *, (row_number() OVER (PARTITION BY arm, pos ORDER BY md5('43-' || arm || '-' || run || '-' || pos)))::INT - 1 AS i FROM c",
}


def _pairs(kind: str) -> str:
    return f"(WITH {_CUT}, n AS ({_PAIRED[kind]}) SELECT i, pos, a.acc AS x, b.acc AS y FROM (SELECT * FROM n WHERE arm = 'sub') a JOIN (SELECT * FROM n WHERE arm = 'non') b USING (i, pos))"


def _wilcoxon(kind: str) -> str:
    return f"""SELECT '{kind}' AS pairing, n, round(w, 6) AS w_plus, ties, round((w - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) AS z FROM (
SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, count(DISTINCT CASE WHEN c > 1 THEN abs(d) END) AS ties, sum(c * c - 1)::DOUBLE AS t FROM (
SELECT d, count(*) OVER (PARTITION BY abs(d)) AS c, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM (SELECT round(x - y, 9) AS d FROM {_pairs(kind)}) WHERE d <> 0))"""


_NAMED: dict[str, tuple[Callable, str | None]] = {
    "confusion": (confusion, _MATRIX),
    "confusion_totals": (confusion_totals, f"SELECT sum((y_true = y_pred)::INT)::BIGINT AS hits, count(*) AS n FROM {views.PREDICTIONS}"),
    "confusion_expand": (confusion_expand, f"SELECT y_true, y_pred, unnest(range(n)) AS i FROM ({_MATRIX})"),
    "eval_balanced": (eval_balanced, f"SELECT qa_id, y_true, y_pred FROM {_balanced(views.PREDICTIONS, '(0, 1, 2)')}"),
    "eval_metrics": (eval_metrics, f"{_metrics('all', views.PREDICTIONS)} UNION ALL {_metrics('selected', _SELECTED)}"),
    "qwk": (qwk, f"SELECT round(1 - avg((y_true - y_pred) ** 2) / (avg(y_true * y_true) + avg(y_pred * y_pred) - 2 * avg(y_true) * avg(y_pred)), 6) AS kappa FROM {views.PREDICTIONS}"),
    "e3_curve": (e3_curve, f"SELECT i, pos, round(x - y, 6) AS diff FROM {_pairs('order')}"),
    "e3_means": (e3_means, f"SELECT i, round(avg(x - y), 6) AS mean FROM {_pairs('order')} GROUP BY i"),
    "e3_best_worst": (e3_best_worst, f"WITH {_CUT} SELECT pos, round(max(acc) FILTER (arm = 'sub') - min(acc) FILTER (arm = 'non'), 6) AS a1, round(min(acc) FILTER (arm = 'sub') - max(acc) FILTER (arm = 'non'), 6) AS a2 FROM c GROUP BY pos"),
    "e3_paired": (e3_paired, f"SELECT i, pos, x, y FROM {_pairs('random')}"),
    "wilcoxon": (wilcoxon, f"{_wilcoxon('order')} UNION ALL {_wilcoxon('random')}"),
    "wilcoxon_p": (wilcoxon_p, None),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for name, (q, _) in _NAMED.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in _NAMED.items() if sql}
