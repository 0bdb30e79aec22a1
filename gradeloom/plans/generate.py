"""Queries on chunking, critics, assembly and sources, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.paths import domain_of
from gradeloom.operators import generate as O
from gradeloom.operators.ranking import running
from gradeloom.plans import views
from gradeloom.sources import files, tables
from gradeloom.storage import shared_dir


def fileid_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fileid, domain_name of each file: S2, T17."""
    return views.qa(spark, sf_dir).select("fileid").where("fileid IS NOT NULL").distinct().withColumn("domain_name", domain_of("fileid"))


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, ind: the place of each row by id, from 0: P9."""
    ids = views.qa(spark, sf_dir).select("qa_id").distinct()
    return running(ids, [], [F.col("qa_id")]).select("qa_id", F.col("before").alias("ind"))


def sentence_split_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, first, last: sentences of all documents, cut without regard to abbreviations: T15."""
    s = views.table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text"), []).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"), F.get("s", F.size("s") - 1).alias("last"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n: sentences with regard to abbreviations; SQL has no lookbehind for them."""
    return views.table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, chunk: sentences of all documents packed to 60 words: T16."""
    s = views.table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text"), []).alias("s"))
    return s.select("doc_id", F.posexplode(T.chunks(F.col("s"), F.col("doc_id"), 60, 60)).alias("k", "chunk"))


_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]+[''"”’)\]}}]*){T.SPACE}([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(regexp_replace(s, '^{T.SPACE}', ''), '{T.SPACE}$', '')), lambda s: s <> '')"""
_N = f"len(list_filter(string_split_regex(s[i], '{T.SPACE}'), lambda w: w <> ''))"
_CHUNKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
w AS (SELECT doc_id, i, s[i] AS x, {_N} AS n, len(s) AS m FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, x, n, m, CASE WHEN n + 1 <= 60 THEN 0 ELSE 1 END AS g, n AS used FROM w WHERE i = 1
  UNION ALL SELECT w.doc_id, w.i, w.x, w.n, w.m, CASE WHEN f.used + w.n + 1 <= 60 THEN f.g ELSE f.g + 1 END, CASE WHEN f.used + w.n + 1 <= 60 THEN f.used + w.n ELSE w.n END FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1),
c AS (SELECT doc_id, g, string_agg(x, ' ' ORDER BY i) AS chunk, sum(n) AS n, max(i) = max(m) AS final FROM f GROUP BY doc_id, g)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g))::INT - 1 AS k, chunk FROM c WHERE NOT final OR n >= 60"""


def chunk_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, words: chunks of all documents with targets from 150 to 800 words drawn by a hash."""
    s = views.table(spark, sf_dir, "documents").select("doc_id", T.chunks(T.sentences(F.col("text")), F.col("doc_id")).alias("c"))
    return s.select("doc_id", F.posexplode("c").alias("k", "chunk")).select("doc_id", "k", T.words_of(F.col("chunk")).alias("words"))


def critic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, n, kept: the candidates that the critic accepted: P5."""
    k = views.pairs(spark, sf_dir).select("pair_id", O.kept(F.col("generated_answers"), F.col("critiques")).alias("k")).dropDuplicates(["pair_id"])
    return k.select("pair_id", F.size("k").alias("n"), F.array_join("k", "|", "-").alias("kept"))


_KEPT = "list_transform(list_filter(list_transform(range(1, least(len(generated_answers), len(critiques)) + 1), lambda i: {'x': generated_answers[i], 'ok': coalesce(critiques[i], false)}), lambda s: s.ok), lambda s: s.x)"


def explode_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, pos, text: a row for each accepted candidate, none for an empty list: N1."""
    k = views.pairs(spark, sf_dir).select("pair_id", O.kept(F.col("generated_answers"), F.col("critiques")).alias("k")).dropDuplicates(["pair_id"])
    return k.select("pair_id", F.posexplode("k").alias("pos", "text"))


def rubric_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id of the rows that have rubrics: P4."""
    return views.pairs(spark, sf_dir).where("rubrics IS NOT NULL").select("pair_id").distinct()


def _branches(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """Three branches of the prompts: the exported answers, what the critic accepts of the candidates, and what it rejects."""
    rows = views.pairs(spark, sf_dir).select("pair_id", "fileid", "context", "question", "rubrics", "generated_answers", "critiques", "answers")
    accepted = O.kept(F.col("generated_answers"), F.col("critiques"))
    rejected = O.kept(F.col("generated_answers"), F.transform("critiques", lambda c: ~c))
    return {2: rows, 1: rows.withColumn("answers", accepted), 0: rows.withColumn("answers", rejected)}


def qa_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, label, pos, lang, fileid, question, fc, answer: union of three branches, a row for each answer: O1, P8, N2."""
    rows = O.assemble(_branches(spark, sf_dir), ["pair_id"])
    return rows.select("pair_id", "label", "pos", "lang", "fileid", "input.question", F.col("input.rubrics.FC").alias("fc"), "input.answer").dropDuplicates(["pair_id", "label", "pos"])


_REJECTED = _KEPT.replace("critiques[i]", "NOT critiques[i]")
_ASSEMBLED = " UNION ALL ".join(
    f"SELECT pair_id, {label} AS label, unnest(range(len(a)))::INT AS pos, 'en' AS lang, fileid, question, rubrics.FC AS fc, unnest(a) AS answer FROM (SELECT *, {a} AS a FROM {views.PAIRS})" for label, a in ((2, "answers"), (1, _KEPT), (0, _REJECTED))
)


def generated_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, rows: the whole generation over all contexts with the stand-in for the model: L1 to L12."""
    texts = views.contexts(spark, sf_dir).groupBy("context_id").agg(F.max("fileid").alias("fileid"), F.max("context").alias("text"))
    return O.generate(texts.select("fileid", "text"), lambda: O.stub_client(), low=20, high=80).groupBy("label").agg(F.count("*").alias("rows"))


def rubric_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt, passed, rows: the rubric loop over all prompts with the stand-in: L4, L5, L12."""
    rows = views.pairs(spark, sf_dir).select("pair_id", "context", "question").dropDuplicates(["pair_id"])
    got = O.rubrics(rows, lambda: O.stub_client(2))
    return got.groupBy("attempt", F.col("rubrics").isNotNull().alias("passed")).agg(F.count("*").alias("rows"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """context_id, chars: contexts written as JSON and read again under their schema: S3, S6."""
    rows = views.contexts(spark, sf_dir).dropDuplicates(["context_id"])
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    tables.write_json(rows, path)
    return files.read_json_lines(spark, path, rows.schema).select("context_id", F.length("context").alias("chars"))


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain_name, words: the answers written as text files by domain and read again by a glob: S1."""
    rows = views.qa(spark, sf_dir).select("qa_id", domain_of("fileid").alias("domain"), F.regexp_replace(F.coalesce("input.answer", F.lit("")), r"[\r\n]+", " ").alias("value")).where("domain IS NOT NULL").dropDuplicates(["qa_id"])
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    rows.select("domain", "value").write.partitionBy("domain").text(path)
    read = files.read_texts(spark, f"{path}/domain=*/*.txt", root=path.rsplit("/", 1)[1])
    return read.select(F.regexp_extract("fileid", "domain=([^/]+)", 1).alias("domain_name"), T.words_of(F.col("text")).alias("n")).groupBy("domain_name").agg(F.sum("n").alias("words"))


_NAMED: dict[str, tuple[Callable, str | None]] = {
    "fileid_domain": (fileid_domain, f"SELECT DISTINCT fileid, {views.DOMAIN_SQL} AS domain_name FROM {views.QA} WHERE fileid IS NOT NULL"),
    "row_index": (row_index, f"SELECT qa_id, row_number() OVER (ORDER BY qa_id) - 1 AS ind FROM {views.QA}"),
    "sentence_split_simple": (sentence_split_simple, f"SELECT doc_id, len(s) AS n, s[1] AS first, s[len(s)] AS last FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)"),
    "sentence_split": (sentence_split, None),
    "chunk_pack": (chunk_pack, _CHUNKS),
    "chunk_random": (chunk_random, None),
    "critic_filter": (critic_filter, f"SELECT pair_id, len(k) AS n, array_to_string(list_transform(k, lambda x: coalesce(x, '-')), '|') AS kept FROM (SELECT pair_id, coalesce({_KEPT}, []) AS k FROM {views.PAIRS})"),
    "explode_questions": (explode_questions, f"SELECT pair_id, unnest(range(len(k)))::INT AS pos, unnest(k) AS text FROM (SELECT pair_id, {_KEPT} AS k FROM {views.PAIRS})"),
    "rubric_present": (rubric_present, f"SELECT pair_id FROM {views.PAIRS} WHERE rubrics IS NOT NULL"),
    "qa_assemble": (qa_assemble, _ASSEMBLED),
    "generated_qa": (generated_qa, None),
    "rubric_attempts": (rubric_attempts, None),
    "json_round_trip": (json_round_trip, f"SELECT context_id, len(context) AS chars FROM {views.CONTEXTS}"),
    "text_round_trip": (text_round_trip, rf"SELECT domain_name, sum(len(list_filter(string_split_regex(coalesce(q.input.answer, ''), '{T.SPACE}'), lambda w: w <> '')))::BIGINT AS words FROM (SELECT *, {views.DOMAIN_SQL} AS domain_name FROM {views.QA}) q WHERE domain_name IS NOT NULL GROUP BY 1"),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for name, (q, _) in _NAMED.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in _NAMED.items() if sql}
