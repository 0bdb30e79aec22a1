"""The views that queries and their SQL share, over the tables of a folder.

Policy on dirty rows: rows without an id are left out, repeats of an id count once. Where a view says so,
rows with a label other than 0, 1 or 2 are left out as well. Null texts read 'None', as str() gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.paths import domain_of
from gradeloom.operators.ranking import present

LABELS = (0, 1, 2)
#: The text fields of a graded answer by their short names.
FIELDS = {
    "context": "input.context",
    "question": "input.question",
    "answer": "input.answer",
    "fc": "input.rubrics.FC",
    "pc": "input.rubrics.PC",
    "nc": "input.rubrics.NC",
}
#: domain_of in SQL, of the column fileid.
DOMAIN_SQL = r"nullif(regexp_replace(regexp_replace(regexp_extract(lower(replace(fileid, '\', '/')), '(?:^|/)\s*devset\s*/[\s/]*([^/]+)/', 1), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan of fewer partitions than there are cores, such as one small file, dealt over the cores by its key.

    Text functions cost far more than that shuffle; larger scans stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complete_generated_data with an id; repeats of a row are still there."""
    return spread(table(spark, sf_dir, "complete_generated_data").where("qa_id IS NOT NULL"), "qa_id")


QA = "(SELECT DISTINCT ON (qa_id) * FROM complete_generated_data WHERE qa_id IS NOT NULL)"


def feature_columns(spark: SparkSession, sf_dir: str) -> list[str]:
    """The feature names, in order: those of feature_weights, a table of one row for each column."""
    return [r.feature for r in table(spark, sf_dir, "feature_weights").where("feature IS NOT NULL").select("feature").distinct().orderBy("feature").collect()]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label (0, 1 or 2), fileid, domain_name, the 19 features (NaN as null), score; one row per id."""
    names = feature_columns(spark, sf_dir)
    rows = table(spark, sf_dir, "complete_generated_data_features").where(F.col("qa_id").isNotNull() & F.col("label").isin(*LABELS)).dropDuplicates(["qa_id"])
    return rows.select("qa_id", "label", "fileid", domain_of("fileid").alias("domain_name"), *(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).alias(c) for c in names), "score")


# The same in SQL; the columns are the rows of feature_weights, stated here as SQL has no list of columns by value.
NAMES = [
    "answer_length", "answer_lexical_density", "cond_overlap_1gram", "cond_overlap_2gram", "cosine_context_answer", "cosine_context_question", "cosine_fc_answer",
    "jaccard_1gram_context_answer", "jaccard_1gram_question_answer", "precision_1gram_question_answer", "question_type_label", "recall_1gram_context_answer",
    "recall_1gram_question_answer", "recall_2gram_context_answer", "recall_2gram_fc_answer", "recall_2gram_nc_answer", "recall_2gram_question_answer",
    "tfidf_cosine_context_answer", "tfidf_cosine_question_answer",
]
FEATURES = f"(SELECT DISTINCT ON (qa_id) qa_id, label, fileid, {DOMAIN_SQL} AS domain_name, {', '.join(f'CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}' for c in NAMES)}, score FROM complete_generated_data_features WHERE qa_id IS NOT NULL AND label IN (0, 1, 2))"


def long_sql(source: str, keep: str, names: list[str] | None = None) -> str:
    """(keep, feature, x) of the non-null values of each feature."""
    listed = ", ".join(f"{{'feature': '{c}', 'x': {c}}}" for c in names or NAMES)
    return f"(SELECT {keep}, f.feature AS feature, f.x AS x FROM (SELECT {keep}, unnest([{listed}]) AS f FROM {source}) WHERE f.x IS NOT NULL)"


#: Rows of the reference set; all others are to be chosen from.
IS_REFERENCE = "qa_id % 4 = 1"


def complete(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with all the named features: distances need each of them."""
    return present(rows, names)


def complete_sql(names: list[str] | None = None) -> str:
    return f"(SELECT * FROM {FEATURES} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names or NAMES)})"


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """context_id, fileid, chunk_idx, context of all_contexts, one row per id; null contexts are left out."""
    return table(spark, sf_dir, "all_contexts").where("context_id IS NOT NULL AND context IS NOT NULL").select("context_id", "fileid", "chunk_idx", "context")


CONTEXTS = "(SELECT DISTINCT ON (context_id) context_id, fileid, chunk_idx, context FROM all_contexts WHERE context_id IS NOT NULL AND context IS NOT NULL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts with their candidates, with an id; repeats are still there."""
    return table(spark, sf_dir, "all_contexts_questions_rubrics_correct_answers").where("pair_id IS NOT NULL")


PAIRS = "(SELECT DISTINCT ON (pair_id) * FROM all_contexts_questions_rubrics_correct_answers WHERE pair_id IS NOT NULL)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, y_true, y_pred: the label, and one that is off by one for each fifth id."""
    rows = qa(spark, sf_dir).where(F.col("label").isin(*LABELS)).select("qa_id", "label").dropDuplicates(["qa_id"])
    return rows.select("qa_id", F.col("label").alias("y_true"), F.expr("(label + CASE WHEN qa_id % 5 = 0 THEN 1 ELSE 0 END) % 3").alias("y_pred"))


PREDICTIONS = "(SELECT qa_id, label AS y_true, (label + CASE WHEN qa_id % 5 = 0 THEN 1 ELSE 0 END) % 3 AS y_pred FROM (SELECT DISTINCT qa_id, label FROM complete_generated_data WHERE qa_id IS NOT NULL AND label IN (0, 1, 2)))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, run, pos, acc: six runs, three in each arm; a position is a day of events, its accuracy their mean value."""
    ev = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    by = ev.select((F.col("user_id") % 6).alias("run"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("pos"), "value").groupBy("run", "pos").agg(F.round(F.avg("value"), 6).alias("acc"))
    return by.select(F.when(F.col("run") < 3, "sub").otherwise("non").alias("arm"), "run", "pos", "acc")


RUNS = "(SELECT CASE WHEN run < 3 THEN 'sub' ELSE 'non' END AS arm, run, pos, round(avg(value), 6) AS acc FROM (SELECT user_id % 6 AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS pos, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL) GROUP BY run, pos)"
