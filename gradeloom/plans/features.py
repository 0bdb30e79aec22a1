"""Queries on text features, with their SQL: survey T1 to T15."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.words import CLOSED, STOPWORDS
from gradeloom.operators import features as O
from gradeloom.operators.ranking import percentiles
from gradeloom.plans import views

_list = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_set = lambda words: "(" + _list(words)[1:-1] + ")"


def text_sql(f: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({f}, 'None')), '{T.SPACE}', ' ', 'g'))"


def tokens_sql(f: str, pattern: str = T.WORD, stop: bool = True) -> str:
    found = f"regexp_extract_all({text_sql(f)}, '{pattern}')"
    return f"list_filter({found}, lambda t: t NOT IN {_set(STOPWORDS)})" if stop else found


def grams_sql(t: str, n: int) -> str:
    return f"list_distinct({t})" if n == 1 else f"list_distinct(list_transform(range(1, len({t}) - {n - 2}), lambda p: array_to_string({t}[p : p + {n - 1}], ' ')))"


def overlap_sql(a: str, b: str, metric: str) -> str:
    both = f"len(list_intersect({a}, {b}))::DOUBLE"
    if metric == "jaccard":
        return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {both} / (len({a}) + len({b}) - {both}) END"
    if metric == "recall":
        return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 WHEN len({b}) = 0 THEN 1.0 ELSE {both} / len({b}) END"
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE {both} / len({a}) END"


def conditional_sql(a: str, b: str, c: str) -> str:
    rest = f"list_filter({b}, lambda g: NOT list_contains({c}, g))"
    return f"CASE WHEN len({rest}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {rest}))::DOUBLE / len({rest}) END"


def type_sql(f: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({text_sql(f)}, '{w}') THEN {i}.0::DOUBLE" for i, w in enumerate(T.QUESTION_WORDS)) + f" ELSE {len(T.QUESTION_WORDS)}.0::DOUBLE END"


def density_sql(t: str) -> str:
    return rf"CASE WHEN len({t}) = 0 THEN 0.0 ELSE len(list_filter({t}, lambda w: regexp_matches(w, '\p{{L}}') AND w NOT IN {_set(CLOSED)}))::DOUBLE / len({t}) END"


def profile(values: DataFrame, x: str) -> DataFrame:
    """label, n, mean, p25, p50, p75 of a feature; repeats of a qa_id count once, dropped when the texts are gone."""
    rows = values.dropDuplicates(["qa_id"])
    means = rows.groupBy("label").agg(F.round(F.avg(x), 9).alias("mean"))
    p = percentiles(rows.select("label", F.col(f"`{x}`").alias("x")), ["label"], [0.25, 0.5, 0.75])
    got = means.withColumnRenamed("label", "l").join(p, F.col("l").eqNullSafe(F.col("label")))
    return got.select("label", "n", "mean", *(F.round(F.col("p")[i], 9).alias(c) for i, c in enumerate(("p25", "p50", "p75"))))


def profile_sql(rows: str) -> str:
    quartiles = ", ".join(f"round(quantile_cont(x, 0.{p}), 9) AS p{p}" for p in (25, 50, 75))
    return f"SELECT label, count(*) AS n, round(avg(x), 9) AS mean, {quartiles} FROM ({rows}) GROUP BY label"


def _profiled(feature: O.Feature, sql: str, **named: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """Profile of a feature by label, and its SQL over the columns ``named``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile(O.extract(views.qa(spark, sf_dir), ["qa_id", "label"], views.FIELDS, [feature]), feature.name)

    listed = ", ".join(f"{e} AS {c}" for c, e in named.items())
    return query, profile_sql(f"SELECT label, {sql} AS x FROM (SELECT label, {listed} FROM {views.QA})")


def _overlap(metric: str, n: int, a: str, b: str):
    named = {c: tokens_sql(views.FIELDS[f]) for c, f in (("t1", a), ("t2", b))}
    query, _ = _profiled(O.overlap(a, b, n, metric), "0")
    sets = f"(SELECT label, {grams_sql('t1', n)} AS s1, {grams_sql('t2', n)} AS s2 FROM (SELECT label, {', '.join(f'{e} AS {c}' for c, e in named.items())} FROM {views.QA}))"
    return query, profile_sql(f"SELECT label, {overlap_sql('s1', 's2', metric)} AS x FROM {sets}")


def _conditional(n: int):
    fields = ("context", "answer", "question")
    query, _ = _profiled(O.conditional_overlap(*fields, n=n), "0")
    tokens = ", ".join(f"{tokens_sql(views.FIELDS[f])} AS t{i}" for i, f in enumerate(fields))
    sets = f"(SELECT label, {', '.join(f'{grams_sql(f"t{i}", n)} AS s{i}' for i in range(3))} FROM (SELECT label, {tokens} FROM {views.QA}))"
    return query, profile_sql(f"SELECT label, {conditional_sql('s0', 's1', 's2')} AS x FROM {sets}")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, normal: T1 over all documents."""
    return views.table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, n, tokens (joined): T2 over all answers."""
    t = T.tokenize(T.normalize(F.col("input.answer")))
    return views.qa(spark, sf_dir).select("qa_id", t.alias("t")).dropDuplicates(["qa_id"]).select("qa_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def treebank_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, n, tokens: T2 in treebank mode over all answers."""
    t = T.tokenize(T.normalize(F.col("input.answer")), "treebank")
    return views.qa(spark, sf_dir).select("qa_id", t.alias("t")).dropDuplicates(["qa_id"]).select("qa_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def _treebank_sql() -> str:
    spaced = text_sql("input.answer")
    for pattern, put in T.TREEBANK:
        for i in "1234":
            put = put.replace("{" + i + "}", "\\" + i)
        spaced = "regexp_replace({}, '{}', '{}', 'g')".format(spaced, pattern.replace("'", "''"), put.replace("'", "''"))
    kept = rf"list_filter(string_split_regex({spaced}, ' +'), lambda t: NOT regexp_matches(t, '^[\x{{21}}-\x{{2f}}\x{{3a}}-\x{{40}}\x{{5b}}-\x{{60}}\x{{7b}}-\x{{7e}}]?$') AND t NOT IN {_set(STOPWORDS)})"
    return f"SELECT qa_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT qa_id, {kept} AS t FROM {views.QA})"


def ngram_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, n, grams: T3, the distinct bigrams of all answers in order."""
    g = T.ngrams(F.col("t"), 2)
    return views.qa(spark, sf_dir).select("qa_id", T.tokenize(T.normalize(F.col("input.answer"))).alias("t")).select("qa_id", g.alias("g")).dropDuplicates(["qa_id"]).select("qa_id", F.size("g").alias("n"), F.array_join(F.array_sort("g"), "|").alias("grams"))


def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id and the sizes of intersection, union, difference and concatenation of two token arrays: O4, O5."""
    q, a = (T.tokenize(T.normalize(F.col(f"input.{f}"))) for f in ("question", "answer"))
    t = views.qa(spark, sf_dir).select("qa_id", q.alias("q"), a.alias("a"))
    n = {"common": F.array_intersect("q", "a"), "either": F.array_union("q", "a"), "beyond": F.array_except("a", "q"), "joined": F.concat("q", "a")}
    return t.select("qa_id", *(F.size(c).alias(k) for k, c in n.items())).dropDuplicates(["qa_id"])


def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, cosine of the term weights of question and answer, fitted on both fields of all rows: T9."""
    got = O.tfidf_cosine(views.qa(spark, sf_dir), "qa_id", "input.question", "input.answer")
    return got.select("qa_id", F.round("cosine", 6).alias("cosine"))


_TFIDF = f"""
WITH q AS (SELECT qa_id, {tokens_sql('input.question', T.TERM)} AS a, {tokens_sql('input.answer', T.TERM)} AS b FROM {views.QA}),
e AS (SELECT qa_id, unnest(a) AS term, 1 AS x, 0 AS y FROM q UNION ALL SELECT qa_id, unnest(b), 0, 1 FROM q),
c AS (SELECT qa_id, term, sum(x) AS x, sum(y) AS y FROM e GROUP BY ALL),
w AS (SELECT term, ln((1.0 + (SELECT 2 * count(*) FROM q)) / (1.0 + sum((x > 0)::INT + (y > 0)::INT))) + 1 AS w FROM c GROUP BY term),
s AS (SELECT qa_id, sum(x * y * w * w) AS xy, sum(x * x * w * w) AS xx, sum(y * y * w * w) AS yy FROM c JOIN w USING (term) GROUP BY qa_id)
SELECT qa_id, round(coalesce(CASE WHEN xx > 0 AND yy > 0 THEN xy / sqrt(xx) / sqrt(yy) ELSE 0 END, 0), 6) AS cosine FROM q LEFT JOIN s USING (qa_id)"""


def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cosine of each stored vector with the mean vector of its label: T10 on given embeddings."""
    v = views.table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    long = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # as many entries as a vector has
    return v.join(centre, "label").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))


_EMBEDDING = """
WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(c, c)), 6) AS cosine FROM embeddings JOIN c USING (label)"""


def kn_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, perplexity of all answers under a model of the answers of the reference set (infinity as -1): T11."""
    t = views.qa(spark, sf_dir).select("qa_id", T.tokenize(T.normalize(F.col("input.answer"))).alias("t")).dropDuplicates(["qa_id"])
    model = O.fit_trigrams(t.where(views.IS_REFERENCE).select("t"))
    got = O.trigram_perplexity(t, "qa_id", "t", model)
    return got.select("qa_id", F.when(F.col("perplexity") < float("inf"), F.round("perplexity", 4)).otherwise(-1.0).alias("perplexity"))


_KN = f"""
WITH q AS (SELECT qa_id, {tokens_sql('input.answer')} AS t FROM {views.QA}),
s AS (SELECT list_concat(['<s>', '<s>'], t, ['</s>', '</s>']) AS s FROM q WHERE {views.IS_REFERENCE}),
g AS (SELECT s[i] AS u, s[i + 1] AS v, s[i + 2] AS w FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM s)),
c3 AS (SELECT u, v, w, count(*) AS c FROM g GROUP BY ALL),
b AS (SELECT DISTINCT s[i] AS a, s[i + 1] AS b FROM (SELECT s, unnest(range(1, len(s))) AS i FROM s)),
n3 AS (SELECT u, v, sum(c) AS n, count(*) AS t FROM c3 GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS c FROM c3 GROUP BY ALL),
n2 AS (SELECT v, n, t FROM (SELECT v, count(*) AS n FROM c3 GROUP BY v) JOIN (SELECT a AS v, count(*) AS t FROM b GROUP BY a) USING (v)),
p1 AS (SELECT b AS w, count(*) / (SELECT count(*) FROM b) AS p FROM b GROUP BY b),
e AS (SELECT qa_id, t[i] AS u, t[i + 1] AS v, t[i + 2] AS w FROM (SELECT qa_id, t, unnest(range(1, len(t) - 1)) AS i FROM q)),
k AS (SELECT qa_id, CASE WHEN n2.n IS NULL THEN coalesce(p, 0) ELSE greatest(coalesce(c2.c, 0) - 0.1::DOUBLE, 0) / n2.n + 0.1::DOUBLE * n2.t / n2.n * coalesce(p, 0) END AS p2, n3.n AS n3, n3.t AS t3, c3.c AS c
  FROM e LEFT JOIN c3 USING (u, v, w) LEFT JOIN n3 USING (u, v) LEFT JOIN c2 USING (v, w) LEFT JOIN n2 USING (v) LEFT JOIN p1 USING (w)),
l AS (SELECT qa_id, CASE WHEN n3 IS NULL THEN p2 ELSE greatest(coalesce(c, 0) - 0.1::DOUBLE, 0) / n3 + 0.1::DOUBLE * t3 / n3 * p2 END AS p FROM k),
r AS (SELECT qa_id, CASE WHEN min(p) <= 0 THEN -1.0 ELSE round(pow(2.0, -avg(log2(greatest(p, 1e-300)))), 4) END AS perplexity FROM l GROUP BY qa_id)
SELECT qa_id, coalesce(perplexity, 0.0) AS perplexity FROM q LEFT JOIN r USING (qa_id)"""

#: The features of the bundle that need no fitted model: (feature, SQL over t_<field> (tokens), s_<field>_<n> (sets)).
BUNDLE = [
    *((O.overlap(a, b, n, m), overlap_sql(f"s_{a}_{n}", f"s_{b}_{n}", m)) for m, n, a, b in (
        ("recall", 2, "fc", "answer"), ("recall", 2, "nc", "answer"), ("jaccard", 1, "question", "answer"), ("jaccard", 1, "context", "answer"), ("recall", 2, "question", "answer"),
        ("recall", 2, "context", "answer"), ("precision", 1, "question", "answer"), ("recall", 1, "question", "answer"), ("recall", 1, "context", "answer"),
    )),
    *((O.conditional_overlap("context", "answer", "question", n=n), conditional_sql(f"s_context_{n}", f"s_answer_{n}", f"s_question_{n}")) for n in (1, 2)),
    (O.token_length("answer"), "len(t_answer)::DOUBLE"),
    (O.lexical_density("answer"), density_sql("t_answer")),
    (O.question_type("question"), "y_question"),
]


def feature_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label and the configured features of English rows in one pass, with the two term-weight cosines joined: T14.

    The three embedding features need an encoder, see :func:`gradeloom.operators.features.embedded_cosine`.
    """
    rows = views.qa(spark, sf_dir).where("lang = 'en'")
    local = O.extract(rows, ["qa_id", "label"], views.FIELDS, [f for f, _ in BUNDLE]).dropDuplicates(["qa_id"])
    for a in ("question", "context"):
        local = local.join(O.tfidf_cosine(rows, "qa_id", f"input.{a}", "input.answer").withColumnRenamed("cosine", f"tfidf_cosine_{a}_answer"), "qa_id")
    return local.select("qa_id", "label", *(F.round(c, 6).alias(c) for c in local.columns if c not in ("qa_id", "label")))


def _bundle_sql() -> str:
    source = f"(SELECT * FROM {views.QA} WHERE lang = 'en')"
    tokens = ", ".join(f"{tokens_sql(views.FIELDS[f])} AS t_{f}" for f in ("context", "question", "answer", "fc", "nc"))
    sets = ", ".join(f"{grams_sql(f't_{f}', n)} AS s_{f}_{n}" for f in ("context", "question", "answer", "fc", "nc") for n in (1, 2))
    cosines = {a: _TFIDF.replace("input.question", f"input.{a}").replace(views.QA, source) for a in ("question", "context")}
    local = ", ".join(f"round({e}, 6) AS {f.name}" for f, e in BUNDLE)
    joined = " ".join(f"JOIN ({sql}) c_{a} ON c_{a}.qa_id = r.qa_id" for a, sql in cosines.items())
    return f"SELECT r.*, {', '.join(f'c_{a}.cosine AS tfidf_cosine_{a}_answer' for a in cosines)} FROM (SELECT qa_id, label, {local} FROM (SELECT *, {sets} FROM (SELECT qa_id, label, {type_sql('input.question')} AS y_question, {tokens} FROM {source}))) r {joined}"


_TOKENS = tokens_sql("input.answer")
_NAMED = {
    "overlap_recall2": _overlap("recall", 2, "context", "answer"),
    "overlap_recall1": _overlap("recall", 1, "context", "answer"),
    "overlap_jaccard1": _overlap("jaccard", 1, "question", "answer"),
    "overlap_precision1": _overlap("precision", 1, "question", "answer"),
    "cond_overlap1": _conditional(1),
    "cond_overlap2": _conditional(2),
    "token_length": _profiled(O.token_length("answer"), "len(t)::DOUBLE", t=_TOKENS),
    "lexical_density_rules": _profiled(O.lexical_density("answer"), density_sql("t"), t=_TOKENS),
    "question_type": _profiled(O.question_type("question"), "t", t=type_sql("input.question")),
    "normalize_text": (normalize_text, f"SELECT doc_id, {text_sql('text')} AS normal FROM documents"),
    "tokenize": (tokenize, f"SELECT qa_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT qa_id, {_TOKENS} AS t FROM {views.QA})"),
    "treebank_tokens": (treebank_tokens, _treebank_sql()),
    "ngram_set": (ngram_set, f"SELECT qa_id, len(g) AS n, array_to_string(list_sort(g), '|') AS grams FROM (SELECT qa_id, {grams_sql('t', 2)} AS g FROM (SELECT qa_id, {_TOKENS} AS t FROM {views.QA}))"),
    "array_sets": (array_sets, f"SELECT qa_id, len(list_intersect(q, a)) AS common, len(list_distinct(list_concat(q, a))) AS either, len(list_filter(list_distinct(a), lambda w: NOT list_contains(q, w))) AS beyond, len(list_concat(q, a)) AS joined FROM (SELECT qa_id, {tokens_sql('input.question')} AS q, {_TOKENS} AS a FROM {views.QA})"),
    "tfidf_cosine": (tfidf_cosine, _TFIDF),
    "embedding_cosine": (embedding_cosine, _EMBEDDING),
    "kn_perplexity": (kn_perplexity, _KN),
    "feature_bundle": (feature_bundle, _bundle_sql()),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for name, (q, _) in _NAMED.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in _NAMED.items()}
