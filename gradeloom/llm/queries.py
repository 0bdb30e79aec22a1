"""The queries pN_ of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import clusters, neighbours, packing, pairs, sampling, scans, subjects, tokens
from gradeloom.llm.space import read_metric, usable
from gradeloom.plans.views import DOMAIN_SQL, NAMES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _table(spark, sf_dir, "complete_generated_data_features"), _table(spark, sf_dir, "feature_weights")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of which at least one is among the other's nearest."""
    return neighbours.neighbour_pairs(neighbours.search(*_features(spark, sf_dir)))


def p1_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its score filled anew from its neighbours."""
    features, weights = _features(spark, sf_dir)
    each = neighbours.closeness(features, neighbours.search(features, weights))
    return each.withColumn("score", F.round("score", 9))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a group of at least three rows, with the group's smallest id."""
    return clusters.group(*_features(spark, sf_dir)).select("cluster_id", "qa_id")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's size and its most typical rows."""
    features, weights = _features(spark, sf_dir)
    metric = read_metric(weights)
    rows = usable(features, metric)
    return clusters.describe(clusters.clusters(rows, metric), rows, metric)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, page numbers, divided and misread words of scanned pages."""
    return scans.find(_table(spark, sf_dir, "all_contexts"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context as continuous readable paragraphs."""
    return scans.repaired(_table(spark, sf_dir, "all_contexts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective entry of the two arrays with its kind of defect."""
    return pairs.find(_table(spark, sf_dir, "all_contexts_questions_rubrics_correct_answers"))


def _draw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.draw(_table(spark, sf_dir, "complete_generated_data"), _table(spark, sf_dir, "target_shares"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with fewer rows than they need."""
    return sampling.short_categories(_draw(spark, sf_dir)[1])


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself: qa_id, label, domain_name."""
    return _draw(spark, sf_dir)[0]


def p5_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps that the sample leaves in the margins of label and domain."""
    return sampling.residuals(_draw(spark, sf_dir)[1])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids."""
    return tokens.encode(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split in the assignment to containers."""
    return packing.split_documents(p7_packing(spark, sf_dir))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment: which part of which document goes into which container."""
    return packing.assign(_table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of the assignment are."""
    return packing.fill_report(p7_packing(spark, sf_dir))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(*(_table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_examples")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject of a document."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents treat each subject."""
    return subjects.composition(_subjects(spark, sf_dir), _table(spark, sf_dir, "documents"))


_NAMED = [p1_found, p1_closeness, p2_found, p2_groups, p3_found, p3_paragraphs, p4_found, p5_found, p5_sample, p5_residuals, p6_ids, p7_found, p7_packing, p7_fill, p8_found, p8_composition]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMED}

# The vectors of usable rows as the tables state them: the features of weight above 0, in order, with their weights and units.
_VECTORS = f"""
m AS (SELECT list(weight ORDER BY feature) AS w, list(unit ORDER BY feature) AS u, list(feature ORDER BY feature) AS f FROM feature_weights WHERE weight > 0),
l AS (SELECT DISTINCT ON (qa_id) qa_id, label, [{", ".join(f"{{'f': '{c}', 'x': {c}}}" for c in NAMES)}] AS a FROM complete_generated_data_features WHERE qa_id IS NOT NULL AND label IN (0, 1, 2)),
v AS (SELECT qa_id, label, list_transform(list_filter(a, lambda s: list_contains(f, s.f)), lambda s: s.x) AS v FROM l, m),
r AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'inf'::DOUBLE)) = len(v)),
d AS (SELECT a.qa_id, b.qa_id AS other, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: w[i] * ((a.v[i] - b.v[i]) / u[i]) * ((a.v[i] - b.v[i]) / u[i])))) AS d FROM r a JOIN r b ON a.label = b.label AND a.qa_id <> b.qa_id, m),
near AS (SELECT * FROM d WHERE d <= 0.4)"""
_NEAREST = f"{_VECTORS}, nb AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY round(d, 12), other) <= 5)"
_GROUPS = f"""WITH RECURSIVE {_VECTORS}, c(id, root) USING KEY (id) AS (SELECT qa_id, qa_id FROM r UNION
(SELECT DISTINCT ON (a.id) a.id, b.root FROM recurring.c AS a JOIN near n ON n.qa_id = a.id JOIN c AS b ON b.id = n.other WHERE b.root < a.root ORDER BY a.id, b.root)),
g AS (SELECT root AS cluster_id, id AS qa_id FROM c QUALIFY count(*) OVER (PARTITION BY root) >= 3)"""
_SCORED = "each AS (SELECT qa_id, count(*) AS n, 0 - avg(round(d, 12)) AS s FROM nb GROUP BY qa_id)"
_NEED = f"""
WITH r AS (SELECT DISTINCT ON (qa_id) qa_id, label, {DOMAIN_SQL} AS domain_name FROM complete_generated_data WHERE qa_id IS NOT NULL AND label IN (0, 1, 2) AND fileid IS NOT NULL),
s AS (SELECT count(*) // 5 AS s FROM r),
h AS (SELECT label, domain_name, count(*) AS n FROM r GROUP BY ALL)
SELECT t.label, t.domain_name FROM target_shares t LEFT JOIN h USING (label, domain_name), s WHERE coalesce(n, 0) < greatest(min_rows, (share_bp * s + 9999) // 10000)"""

#: Brute force over whole tables. The other queries have none: p3, p4 and p8 read texts by rules that SQL has no words for,
#: p6 and p7 need a tokenizer, and which rows p5_sample draws is the operator's own choice.
SQL: dict[str, str] = {
    "p1_found": f"WITH {_NEAREST} SELECT DISTINCT least(qa_id, other) AS qa_id_a, greatest(qa_id, other) AS qa_id_b FROM nb",
    "p1_closeness": f"WITH {_NEAREST}, {_SCORED} SELECT qa_id, label, coalesce(n, 0) AS neighbours, round(s, 9) AS score FROM (SELECT qa_id, max(label) AS label FROM complete_generated_data_features WHERE qa_id IS NOT NULL GROUP BY qa_id) LEFT JOIN each USING (qa_id)",
    "p2_found": f"{_GROUPS} SELECT cluster_id, qa_id FROM g",
    "p2_groups": f"""{_GROUPS},
x AS (SELECT cluster_id, label, qa_id, list_transform(range(1, len(v) + 1), lambda i: floor(v[i] * (sqrt(w[i]) / u[i]) / 0.4)) AS cell FROM g JOIN r USING (qa_id), m),
y AS (SELECT cluster_id, label, cell, count(*) AS n, min(qa_id) AS first, list(qa_id ORDER BY qa_id)[1:3] AS typical FROM x GROUP BY ALL)
SELECT cluster_id, label, sum(n)::BIGINT AS members, max(n) AS densest_cell, arg_max(typical, (n, -first)) AS typical FROM y GROUP BY cluster_id, label""",
    "p5_found": _NEED,
}
