"""Queries on relevance and few-shot sets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.paths import domain_of
from gradeloom.operators import profile, relevance as O
from gradeloom.operators.ranking import long_form, running
from gradeloom.plans import views

SEP = "\nSEPARATOR|SEPARATOR\n"
_NOT_REFERENCE = f"NOT ({views.IS_REFERENCE})"


def _weights(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Weights above 0 by feature: the table has a row for each column."""
    return {r.feature: r.weight for r in views.table(spark, sf_dir, "feature_weights").where("weight > 0").orderBy("feature").collect()}


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, float], dict[str, float]]:
    """Rows to choose from and reference rows that have all weighted features, the weights, and the deviations of the former."""
    weights = _weights(spark, sf_dir)
    rows = views.complete(views.features(spark, sf_dir), list(weights))
    train = rows.where(_NOT_REFERENCE)
    stds = profile.STD.over(train, [], list(weights)).first().asDict()
    return train, rows.where(views.IS_REFERENCE), weights, {c: round(stds[f"{c}_std"], 9) for c in weights}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows with matched_cluster and score by the nearest centre of the reference rows; a cluster is a question type."""
    train, reference, weights, stds = _rows(spark, sf_dir)
    names = list(weights)
    clustered = reference.where("question_type_label IS NOT NULL").withColumn("cluster", F.floor("question_type_label"))
    centres = clustered.groupBy("label", "cluster").agg(*(F.avg(f"`{c}`").alias(c) for c in names)).select("label", "cluster", F.array(*names).alias("centre"))
    return O.match_clusters(train, centres, names, weights, stds)


#: Weighted features; the SQL states them as the table of weights does.
_W = "(SELECT feature, weight FROM feature_weights WHERE weight > 0)"


def _ctes(names: list[str]) -> str:
    listed = ", ".join(f"'{c}'" for c in names)
    return f"""
rows_ AS (SELECT * FROM {views.FEATURES} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names)}),
train AS (SELECT * FROM rows_ WHERE {_NOT_REFERENCE}), ref AS (SELECT * FROM rows_ WHERE {views.IS_REFERENCE}),
wv AS (SELECT list(weight ORDER BY feature) AS w FROM feature_weights WHERE feature IN ({listed})),
sv AS (SELECT [{', '.join(f'round(stddev_pop({c}), 9)' for c in names)}] AS s FROM train)"""


# The features of weight above 0 in feature_weights, in order.
WEIGHTED = [c for c in views.NAMES if c != "question_type_label"]
_CENTRE = "[" + ", ".join(f"avg({c})" for c in WEIGHTED) + "]"
_VECTOR = "[" + ", ".join(WEIGHTED) + "]"
_TERM = "w[i] / list_sum(w) * pow((v[i] - centre[i]) / CASE WHEN s[i] = 0 THEN 1 ELSE s[i] END, 2)"
_SCORED = f"""{_ctes(WEIGHTED)},
cent AS (SELECT label, floor(question_type_label)::BIGINT AS cluster, {_CENTRE} AS centre FROM ref WHERE question_type_label IS NOT NULL GROUP BY ALL),
dist AS (SELECT t.qa_id, t.label, t.domain_name, cluster, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: {_TERM})), 9) AS d FROM (SELECT *, {_VECTOR} AS v FROM train) t JOIN cent USING (label), wv, sv),
scored AS (SELECT qa_id, label, domain_name, cluster AS matched_cluster, -d AS score FROM dist QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY d, cluster) = 1)"""


def neighbor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, refs, score by the places of the five nearest reference rows, for each training row whose id is divisible by 100 against all rows: J4, W8, M4."""
    train, reference, weights, stds = _rows(spark, sf_dir)
    t, r = (O.standardised(x, list(weights), stds).select("qa_id", "label", "v") for x in (train, reference))
    got = O.neighbour_rank(t, r, weights.values(), queries=t.where("qa_id % 100 = 0"))
    return got.select("qa_id", "refs", F.round("score", 6).alias("score"))


_UNIT = "list_transform(range(1, len(v) + 1), lambda i: v[i] / CASE WHEN s[i] = 0 THEN 1 ELSE s[i] END)"
_NEIGHBOURS = f"""
WITH {_ctes(WEIGHTED)},
z AS (SELECT qa_id, label, is_ref, CASE WHEN list_sum(u) = 0 THEN u ELSE list_transform(u, lambda x: x / list_sum(u)) END AS v FROM (SELECT qa_id, label, {views.IS_REFERENCE} AS is_ref, {_UNIT} AS u FROM (SELECT *, {_VECTOR} AS v FROM rows_), sv)),
d AS (SELECT q.qa_id, z.qa_id AS other, z.is_ref, round(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: w[i] * (q.v[i] - z.v[i]) * (q.v[i] - z.v[i]))), 9) AS d FROM z q JOIN z ON q.label = z.label, wv WHERE NOT q.is_ref AND q.qa_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY d, is_ref, other) - 1 AS place FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY place) AS r FROM p WHERE is_ref)
SELECT z.qa_id, count(place) AS refs, round(-avg(place), 6) AS score FROM z LEFT JOIN (SELECT * FROM f WHERE r <= 5) f USING (qa_id) WHERE NOT z.is_ref AND z.qa_id % 100 = 0 GROUP BY z.qa_id"""


def match_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label, matched_cluster, score: J5, W9."""
    return _scored(spark, sf_dir).select("qa_id", "label", "matched_cluster", "score")


def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, place, qa_id, score: training rows of each label by falling score, then id: W5, W6."""
    ranked = running(_scored(spark, sf_dir).select("qa_id", "label", "score"), ["label"], [F.col("score").desc(), F.col("qa_id")])
    return ranked.select("label", F.col("before").alias("place"), "qa_id", "score")


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label: W3 over the labels 0, 1 and 2."""
    return O.balanced(views.features(spark, sf_dir).select("qa_id", "label"))


_GROUPS = ["label", "domain_name"]


def top_third_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label, domain_name: the first third of each label and domain by id: W4."""
    return O.top_third(views.features(spark, sf_dir).select("qa_id", *_GROUPS), _GROUPS, [F.col("qa_id")])


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_third(_scored(spark, sf_dir).select("qa_id", *_GROUPS, "score"), _GROUPS, [F.col("score").desc(), F.col("qa_id")])


def top_third_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label, domain_name: the third of each label and domain with the highest scores: W4."""
    return _best(spark, sf_dir).drop("score")


_BEST = f"{_SCORED}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY label, domain_name ORDER BY score DESC, qa_id) <= count(*) OVER (PARTITION BY label, domain_name) // 3)"


def score_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chosen, every: mean score of the chosen third and of all: A8."""
    scored = _scored(spark, sf_dir)
    third = O.top_third(scored.select("qa_id", *_GROUPS, "score"), _GROUPS, [F.col("score").desc(), F.col("qa_id")])
    return third.agg(F.round(F.avg("score"), 9).alias("chosen")).join(scored.agg(F.round(F.avg("score"), 9).alias("every")))  # one row each


def subsample_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label, question, answer of the rows of the baseline third: J2."""
    picked = top_third_baseline(spark, sf_dir).select("qa_id")
    rows = views.qa(spark, sf_dir).join(picked, "qa_id", "left_semi").select("qa_id", "label", "input.question", "input.answer")
    return rows.dropDuplicates(["qa_id"])


def features_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label, answer_length, words: features beside their rows by id: J1."""
    words = F.size(F.regexp_extract_all(F.coalesce("input.answer", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rows = views.qa(spark, sf_dir).select("qa_id", words.alias("words")).dropDuplicates(["qa_id"])
    return views.features(spark, sf_dir).select("qa_id", "label", "answer_length").join(rows, "qa_id").select("qa_id", "label", "answer_length", "words")


def distinct_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain_name, in order: A6."""
    return views.qa(spark, sf_dir).select(domain_of("fileid").alias("domain_name")).where("domain_name IS NOT NULL").distinct().orderBy("domain_name")


def compare_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, means of all, of the chosen third and of the reference, and their differences from it: J7, M5, A9."""
    train, reference, weights, _ = _rows(spark, sf_dir)
    names = list(weights)
    chosen = train.join(_best(spark, sf_dir).select("qa_id"), "qa_id", "left_semi")
    long = {k: long_form(df, [], names) for k, df in (("original", train), ("chosen", chosen), ("reference", reference))}
    got = O.compare_means(long, "reference", views.table(spark, sf_dir, "feature_weights").where("weight > 0"))
    return got.select("feature", *(F.round(c, 9).alias(c) for c in got.columns if c != "feature"))


_MEANS = f"""
WITH {_BEST},
l AS (SELECT 'original' AS s, qa_id, feature, x FROM {views.long_sql('train', 'qa_id', WEIGHTED)} UNION ALL SELECT 'reference', qa_id, feature, x FROM {views.long_sql('ref', 'qa_id', WEIGHTED)}),
m AS (SELECT feature, avg(x) FILTER (s = 'original') AS o, avg(x) FILTER (s = 'original' AND qa_id IN (SELECT qa_id FROM best)) AS c, avg(x) FILTER (s = 'reference') AS r FROM l GROUP BY feature)
SELECT feature, round(o, 9) AS mean_original, round(c, 9) AS mean_chosen, round(r, 9) AS mean_reference, round(abs(o - r), 9) AS diff_original, round(abs(c - r), 9) AS diff_chosen FROM m
UNION ALL SELECT 'total', NULL, NULL, NULL, round(sum(abs(o - r)) / (SELECT sum(weight) FROM {_W}), 9), round(sum(abs(c - r)) / (SELECT sum(weight) FROM {_W}), 9) FROM m"""


def latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, line: a table row for each feature of compare_means: S7."""
    from gradeloom.sources.tables import latex_row

    got = compare_means(spark, sf_dir).where("feature <> 'total'")
    return got.select("feature", latex_row(F.col("feature"), [F.col("diff_original"), F.col("diff_chosen")]).alias("line"))


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows with score, texts and whether they are selected: the best half of each label and domain is."""
    scored = O.split(_scored(spark, sf_dir).select("qa_id", *_GROUPS, "score"), _GROUPS, [F.col("score").desc(), F.col("qa_id")], 0.5)
    texts = views.qa(spark, sf_dir).select("qa_id", "input.context", "input.question", "input.answer").dropDuplicates(["qa_id"])
    return scored.join(texts, "qa_id")


_SHOTS = f"""{_SCORED},
sel AS (SELECT *, row_number() OVER (PARTITION BY label, domain_name ORDER BY score DESC, qa_id) <= floor(count(*) OVER (PARTITION BY label, domain_name) * {{share}}) AS selected FROM scored),
shots AS (SELECT sel.*, q.input.context AS context, q.input.question AS question, q.input.answer AS answer FROM sel JOIN {views.QA} q USING (qa_id))"""
_HALF = _SHOTS.replace("{share}", "0.5")


def fewshot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label, domain_name, selected: the best fifth of each label and domain against the rest: W7."""
    return O.split(_scored(spark, sf_dir).select("qa_id", *_GROUPS, "score"), _GROUPS, [F.col("score").desc(), F.col("qa_id")], 0.2).drop("score")


def fewshot_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """selected, key: the prompts that have all three labels among the selected rows, and among the others: O2, P10."""
    return O.common_keys(_shots(spark, sf_dir).select("selected", "label", F.md5(F.concat_ws(SEP, "context", "question")).alias("key")), ["selected", "key"])


def fewshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """context_key, question: the first question of each context: W10."""
    rows = views.qa(spark, sf_dir).where("input.context IS NOT NULL AND input.question IS NOT NULL")
    return rows.groupBy(F.md5("input.context").alias("context_key")).agg(F.min("input.question").alias("question"))


def fewshot_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chosen, place, context, question, domain_name, answers: the few-shot sets of the selected rows and of the others: J6, W11, N4."""
    rows = _shots(spark, sf_dir)
    sets = [O.fewshot(rows.where(c)).withColumn("chosen", F.lit(n)) for n, c in (("selected", "selected"), ("rest", "NOT selected"))]
    both = sets[0].unionByName(sets[1])
    return both.select("chosen", "place", "context", "question", "domain_name", F.array_join(F.transform("answers", lambda a: F.concat(a["label"].cast("string"), F.lit(":"), F.coalesce(a["answer"], F.lit("")))), "|").alias("answers"))


def _built_sql() -> str:
    return f"""{_HALF},
best_of AS (SELECT selected, context, question, label, arg_min({{'a': coalesce(answer, ''), 'd': domain_name}}, (-score, qa_id)) AS b FROM shots GROUP BY ALL),
every AS (SELECT selected, context, question, string_agg(label || ':' || b.a, '|' ORDER BY label DESC) AS answers, max(b.d) FILTER (label = 2) AS domain_name FROM best_of GROUP BY ALL HAVING count(*) = 3),
firsts AS (SELECT *, md5('42-' || context || chr(10) || question) AS o FROM every QUALIFY row_number() OVER (PARTITION BY selected, context ORDER BY question) = 1),
per AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY selected, domain_name ORDER BY o) <= 2),
built AS (SELECT CASE WHEN selected THEN 'selected' ELSE 'rest' END AS chosen, row_number() OVER (PARTITION BY selected ORDER BY domain_name NULLS FIRST, o) AS place, context, question, domain_name, answers FROM per QUALIFY place <= 6)"""


def fewshot_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaked: contexts that both few-shot sets have: O3."""
    rows = _shots(spark, sf_dir)
    return O.leaks(O.fewshot(rows.where("selected")), O.fewshot(rows.where("NOT selected")))


def semi_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y_true, y_pred, n of the predictions on rows of the baseline third: P11, J3."""
    picked = top_third_baseline(spark, sf_dir).select("qa_id")
    return views.predictions(spark, sf_dir).join(picked, "qa_id", "left_semi").groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


THIRD = f"(SELECT qa_id, label, domain_name FROM {views.FEATURES} QUALIFY row_number() OVER (PARTITION BY label, domain_name ORDER BY qa_id) <= count(*) OVER (PARTITION BY label, domain_name) // 3)"
_NAMED: dict[str, tuple[Callable, str | None]] = {
    "neighbor_rank": (neighbor_rank, _NEIGHBOURS),
    "match_clusters": (match_clusters, f"WITH {_SCORED} SELECT qa_id, label, matched_cluster, score FROM scored"),
    "rank_scores": (rank_scores, f"WITH {_SCORED} SELECT label, row_number() OVER (PARTITION BY label ORDER BY score DESC, qa_id) - 1 AS place, qa_id, score FROM scored"),
    "balanced_sample": (balanced_sample, f"WITH f AS {views.FEATURES} SELECT qa_id, label FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42-' || qa_id), qa_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM f GROUP BY label))"),
    "top_third_baseline": (top_third_baseline, f"SELECT * FROM {THIRD}"),
    "top_third_scored": (top_third_scored, f"WITH {_BEST} SELECT qa_id, label, domain_name FROM best"),
    "score_means": (score_means, f"WITH {_BEST} SELECT (SELECT round(avg(score), 9) FROM best) AS chosen, (SELECT round(avg(score), 9) FROM scored) AS every"),
    "subsample_materialize": (subsample_materialize, f"SELECT qa_id, q.label, q.input.question AS question, q.input.answer AS answer FROM {views.QA} q SEMI JOIN {THIRD} t USING (qa_id)"),
    "features_join": (features_join, rf"SELECT qa_id, f.label, answer_length, len(regexp_extract_all(coalesce(q.input.answer, ''), '[\p{{L}}\p{{N}}]+')) AS words FROM {views.FEATURES} f JOIN {views.QA} q USING (qa_id)"),
    "distinct_domains": (distinct_domains, f"SELECT DISTINCT {views.DOMAIN_SQL} AS domain_name FROM {views.QA} WHERE domain_name IS NOT NULL"),
    "compare_means": (compare_means, _MEANS),
    "latex_rows": (latex_rows, f"SELECT feature, replace(feature, '_', ' ') || ' & ' || printf('%.3f', diff_original) || ' & ' || printf('%.3f', diff_chosen) || ' \\\\' AS line FROM ({_MEANS}) WHERE feature <> 'total'"),
    "fewshot_split": (fewshot_split, f"WITH {_SHOTS.replace('{share}', '0.2')} SELECT qa_id, label, domain_name, selected FROM sel"),
    "fewshot_common": (fewshot_common, f"WITH {_HALF} SELECT selected, md5(concat_ws(chr(10) || 'SEPARATOR|SEPARATOR' || chr(10), context, question)) AS key FROM shots GROUP BY ALL HAVING count(DISTINCT label) = 3"),
    "fewshot_dedup": (fewshot_dedup, f"SELECT md5(q.input.context) AS context_key, min(q.input.question) AS question FROM {views.QA} q WHERE q.input.context IS NOT NULL AND q.input.question IS NOT NULL GROUP BY 1"),
    "fewshot_build": (fewshot_build, f"WITH {_built_sql()} SELECT * FROM built"),
    "fewshot_leak_check": (fewshot_leak_check, f"WITH {_built_sql()} SELECT count(*) AS leaked FROM (SELECT context FROM built WHERE chosen = 'selected' INTERSECT SELECT context FROM built WHERE chosen = 'rest')"),
    "semi_selected": (semi_selected, f"SELECT y_true, y_pred, count(*) AS n FROM {views.PREDICTIONS} p SEMI JOIN {THIRD} t USING (qa_id) GROUP BY ALL"),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for name, (q, _) in _NAMED.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in _NAMED.items() if sql}
