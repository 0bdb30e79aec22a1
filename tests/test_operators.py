import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.paths import domain_of
from gradeloom.operators import evaluate, features, generate, profile, ranking, relevance
from gradeloom.sources import files, tables
from gradeloom.storage import shared_dir


def _one(spark, column, **values):
    fields = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], fields).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [(None, "none"), ("", ""), (" A  B\n\tc ", "a b c"), ("Ünïcode　X", "ünïcode x")])
def test_normal_form(spark, text, want):
    assert _one(spark, T.normalize(F.col("t")), t=("string", text)) == want


def test_tokens_of_both_modes(spark):
    text = ("string", "don't stop: it's 3.5% of the naïve e-mail.")
    assert _one(spark, T.tokenize(F.col("t"), stop=[]), t=text) == ["don", "t", "stop", "it", "s", "3", "5", "of", "the", "naïve", "e", "mail"]
    assert _one(spark, T.tokenize(F.col("t"), "treebank", stop=[]), t=text) == ["do", "n't", "stop", "it", "'s", "3.5", "of", "the", "naïve", "e-mail"]
    assert _one(spark, T.tokenize(F.col("t")), t=("string", "the of and")) == []


def test_ngrams_of_few_tokens(spark):
    assert _one(spark, T.ngrams(F.col("t"), 2), t=("array<string>", ["a"])) == []
    assert _one(spark, T.ngrams(F.col("t"), 2), t=("array<string>", ["a", "b", "a", "b"])) == ["a b", "b a"]


@pytest.mark.parametrize("metric, a, b, want", [
    ("jaccard", [], [], 0.0), ("recall", [], [], 0.0), ("precision", [], [], 0.0), ("recall", ["a"], [], 1.0), ("precision", [], ["a"], 0.0),
    ("jaccard", ["a", "b"], ["b", "c"], 1 / 3), ("recall", ["a", "b"], ["b", "c"], 0.5), ("precision", ["a"], ["a", "c"], 1.0),
])
def test_overlap_edges(spark, metric, a, b, want):
    assert _one(spark, T.overlap(F.col("a"), F.col("b"), metric), a=("array<string>", a), b=("array<string>", b)) == pytest.approx(want)


def test_unknown_metric_raises_early():
    with pytest.raises(ValueError):
        features.overlap("context", "answer", 1, "dice")


def test_conditional_overlap_of_a_covered_answer(spark):
    kind = "array<string>"
    assert _one(spark, T.conditional_overlap(F.col("a"), F.col("b"), F.col("c")), a=(kind, ["x"]), b=(kind, ["y"]), c=(kind, ["y"])) == 1.0


@pytest.mark.parametrize("text, want", [("however", 5.0), ("whose book", 0.0), ("tell me", 7.0), ("", 7.0), ("which", 6.0)])
def test_question_type(spark, text, want):
    assert _one(spark, T.question_type(F.col("t")), t=("string", text)) == want


def test_sentences_and_chunks(spark):
    text = "Dr. Who met J. Smith. They left! “Fine.” 3 days later it ended"
    s = _one(spark, T.sentences(F.col("t")), t=("string", text))
    assert s == ["Dr. Who met J. Smith.", "They left! “Fine.”", "3 days later it ended"]
    long = ["a b c d e f.", "g h.", "i.", "j k l."]
    pack = lambda **k: _one(spark, T.chunks(F.col("s"), F.lit("k"), 4, 4, **k), s=("array<string>", long))
    assert pack(keep_empty=True)[0] == "" and pack() == ["a b c d e f.", "g h. i."]
    assert _one(spark, T.sentences(F.col("t")), t=("string", None)) == []


def test_domain_of_odd_paths(spark):
    rows = spark.createDataFrame([("devset\\Farm Almanac\\a.txt",), ("./devset//x_y/b.TXT",), ("other/x.txt",), (None,)], "fileid string")
    assert [r.d for r in rows.select(domain_of("fileid").alias("d")).collect()] == ["farm_almanac", "x_y", None, None]


def test_running_over_a_hot_group(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, F.lit(None)).otherwise(F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("o"))
    got = ranking.running(rows, ["g"], [F.col("o")]).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    assert sum(map(len, by.values())) == 1000
    for group in by.values():
        group.sort(key=lambda r: r.o)
        assert [r.before for r in group] == list(range(len(group))) and {r.total for r in group} == {len(group)}
    assert ranking.running(rows.limit(0), ["g"], [F.col("o")]).count() == 0


def test_percentiles_interpolate(spark):
    x = [5.0, 1.0, 1.0, 9.0, 2.5, float("nan"), None]
    long = ranking.long_form(spark.createDataFrame([(v,) for v in x], "f double"), [], ["f"])
    (row,) = ranking.percentiles(long, ["feature"], [0.25, 0.5, 0.9]).collect()
    assert row.n == 5 and row.p == pytest.approx(np.quantile([5, 1, 1, 9, 2.5], [0.25, 0.5, 0.9]))
    assert ranking.percentiles(long.limit(0), ["feature"], [0.5]).count() == 0


def test_profile_of_clashing_columns_and_constant(spark):
    rows = spark.createDataFrame([(0, 1.0, 7), (0, 1.0, 8), (1, 3.0, 9)], "label int, n double, total int")
    got = {(r.slice, r.feature): r.mean for r in profile.profile(rows, ["n"]).collect()}
    assert got == {("all", "n"): pytest.approx(5 / 3), ("0", "n"): 1.0, ("1", "n"): 3.0}
    scaled = profile.minmax(rows, ["n"], ["label"]).collect()
    assert {r.n for r in scaled} == {0.0}


def test_kmeans_and_silhouette(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, float(i % 2 * 10 + rng.random()), float(rng.random())) for i in range(60)], "qa_id bigint, a double, b double")
    placed = profile.kmeans(rows, ["a", "b"], k=2, restarts=2)
    groups = {(r.qa_id % 2, r.cluster) for r in placed.collect()}
    assert len(groups) == 2
    s = profile.silhouette(placed.withColumn("v", F.array("a", "b")), "qa_id", "v", "cluster").agg(F.min("silhouette")).first()[0]
    assert s > 0.8
    with pytest.raises(ValueError):
        profile.silhouette(placed.withColumn("v", F.array("a", "b")), "qa_id", "v", "cluster", limit=10)


def _rank(train, ref, w, first=5):
    out = {}
    for i, lab, v in train:
        d = lambda x: round(sum(a * (p - q) ** 2 for a, p, q in zip(w, v, x, strict=True)), 9)
        places = sorted([(d(x), 0, j) for j, k, x in train if k == lab] + [(d(x), 1, j) for j, k, x in ref if k == lab])
        at = [n for n, p in enumerate(places) if p[1]][:first]
        out[i] = -sum(at) / len(at) if at else None
    return out


def test_neighbour_rank_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(relevance, "QUERY_BLOCK", 16)
    monkeypatch.setattr(relevance, "DATA_BLOCK", 20)
    rng = np.random.default_rng(3)
    make = lambda n, at: [(at + i, int(i % 3), [float(x) for x in rng.integers(0, 4, 2)]) for i in range(n)]  # many ties
    train, ref = make(90, 0), [r for r in make(40, 1000) if r[1] != 2]
    schema = "qa_id bigint, label int, v array<double>"
    got = relevance.neighbour_rank(spark.createDataFrame(train, schema), spark.createDataFrame(ref, schema), [1.0, 2.0])
    assert {r.qa_id: r.score for r in got.collect()} == pytest.approx(_rank(train, ref, [1.0, 2.0]))
    empty = spark.createDataFrame([], schema)
    assert relevance.neighbour_rank(empty, empty, [1.0, 1.0]).count() == 0


def test_balanced_takes_the_rarest_count(spark):
    rows = spark.createDataFrame([(i, 0 if i < 70 else 1 if i < 95 else 2) for i in range(100)], "qa_id bigint, label int")
    assert {r.label: r["count"] for r in relevance.balanced(rows).groupBy("label").count().collect()} == {0: 5, 1: 5, 2: 5}


def test_tfidf_of_repeats_and_empty(spark):
    rows = [(1, "cat dog", "cat dog"), (1, "cat dog", "cat dog"), (2, "", "cat"), (3, "sun moon", "tree"), (None, "a b", "a b"), (4, None, None)]
    got = {r.k: r.cosine for r in features.tfidf_cosine(spark.createDataFrame(rows, "k bigint, a string, b string"), "k", "a", "b").collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0, 4: pytest.approx(1.0)}


def test_perplexity_policy(spark):
    corpus = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b", "d"],)], "t array<string>")
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "b", "zzz"]), (4, None)], "k bigint, t array<string>")
    got = {r.k: r.perplexity for r in features.trigram_perplexity(rows, "k", "t", features.fit_trigrams(corpus)).collect()}
    assert got[2] == got[4] == 0.0 and got[3] == float("inf")
    # p(c | a b) = 0.9/2 + 0.1*2/2 * p(c | b); p(c | b) = 0.9/2 + 0.1*2/2 * p(c); p(c) = 1/11 of the different bigrams
    bigrams = {(x, y) for s in (["<s>", "<s>", *"abcd", "</s>", "</s>"], ["<s>", "<s>", *"abd", "</s>", "</s>"]) for x, y in zip(s, s[1:])}
    p1 = sum(y == "c" for _, y in bigrams) / len(bigrams)
    assert got[1] == pytest.approx(1 / (0.45 + 0.1 * (0.45 + 0.1 * p1)))


def test_kappa_and_metrics(spark):
    same = spark.createDataFrame([(1, 1, 5)], "y_true int, y_pred int, n bigint")
    assert evaluate.kappa(same).first().kappa is None and evaluate.kappa(same.limit(0)).first().kappa is None
    perfect = spark.createDataFrame([(0, 0, 3), (2, 2, 3)], "y_true int, y_pred int, n bigint")
    assert evaluate.kappa(perfect).first().kappa == 1.0
    rows = spark.createDataFrame([(i, i % 2 * 2, 1) for i in range(10)], "qa_id bigint, y_true int, y_pred int")
    r = evaluate.metrics(rows).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.accuracy is None  # no class 1, nothing said to be 2
    assert evaluate.expand(spark.createDataFrame([(0, 1, 5), (1, 1, 0)], "y_true int, y_pred int, n bigint"), block=2).count() == 5


def test_wilcoxon(spark):
    pairs = lambda d: spark.createDataFrame([(float(x), 0.0) for x in d], "x double, y double")
    none = evaluate.wilcoxon(pairs([0, 0])).first()
    assert none.n == 0 and none.z is None and evaluate.p_greater(0, 0.0, 0, None) == 1.0
    r = evaluate.wilcoxon(pairs([1, 2, -3, 4, 5])).first()
    assert (r.n, r.w_plus, r.ties) == (5, 12.0, 0) and evaluate.p_greater(5, 12.0, 0, r.z) == pytest.approx(5 / 32)
    tied = evaluate.wilcoxon(pairs([1, -1, 2])).first()
    assert tied.w_plus == 4.5 and tied.ties == 1
    assert evaluate.p_greater(60, 0.0, 0, 1.6448536269514722) == pytest.approx(0.05)


@pytest.mark.parametrize("critiques, want", [([True, False], ["a"]), ([True, True, True, True], ["a", "b", None]), ([], []), (None, []), ([None, True], ["b"])])
def test_critic_of_other_length(spark, critiques, want):
    assert _one(spark, generate.kept(F.col("q"), F.col("c")), q=("array<string>", ["a", "b", None]), c=("array<boolean>", critiques)) == want


@pytest.mark.parametrize("passes_at, attempt", [(1, 1), (10, 10), (None, 10)])
def test_rubric_loop(spark, passes_at, attempt):
    def client():
        seen = []

        def ask(signature, inputs):
            if signature.name == "rubric":
                assert (inputs["critique"] is None) == (not seen)
                return {"full_credit": "f", "partial_credit": "p", "no_credit": "n"}
            seen.append(1)
            return {"follows_criteria": len(seen) == passes_at, "critique": "no"}

        return ask

    (r,) = generate.rubrics(spark.createDataFrame([("c", "q")], "context string, question string"), client).collect()
    assert r.attempt == attempt and (r.rubrics is None) == (passes_at is None)


def test_generation_is_the_same_each_time(spark):
    text = " ".join(f"Sentence number {i} tells of the harbour." for i in range(60))
    rows = spark.createDataFrame([("devset/a/x.txt", text), ("devset/a/y.txt", ""), (None, None)], "fileid string, text string")
    runs = [sorted(map(str, generate.generate(rows, lambda: generate.stub_client(), 20, 60).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]


def test_unknown_input_of_a_signature_raises(spark):
    with pytest.raises(ValueError):
        generate.llm_map(spark.range(1), "clean", generate.stub_client, "x", wrong="id")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"a": 1.5, "b": 0}))
    assert {r.key: r.value for r in files.read_json_object(spark, str(tmp_path / "w.json")).collect()} == {"a": 1.5, "b": 0.0}
    for arm in ("s", "n"):
        (tmp_path / arm).mkdir()
        for i in range(2):
            (tmp_path / arm / f"{i}.json").write_text(json.dumps([0.1 * i, 0.5]))
    runs = files.read_runs(spark, {"sub": str(tmp_path / "s"), "non": str(tmp_path / "n")})
    assert runs.count() == 8 and {r.run for r in runs.collect()} == {0, 1}
    rows = spark.createDataFrame([(1, "ä"), (2, None)], "id bigint, t string")
    tables.write_json(rows, str(tmp_path / "out.json"), single=True)
    assert "ä" in (tmp_path / "out.json").read_text() and json.loads((tmp_path / "out.json").read_text())[1] == {"id": 2, "t": None}
    assert sorted(map(tuple, files.read_json_array(spark, str(tmp_path / "out.json"), rows.schema).collect())) == [(1, "ä"), (2, None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ntwo")
    (got,) = files.read_texts(spark, str(tmp_path / "d" / "*.txt"), root=tmp_path.name).collect()
    assert got.fileid == "devset/d/a.txt" and got.text == "one\ntwo"


def test_latex_row(spark):
    assert _one(spark, tables.latex_row(F.col("n"), [F.col("v"), F.col("w")]), n=("string", "input/a_b"), v=("double", 0.12345), w=("double", None)) == "a b & 0.123 &  \\\\"


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(dict)})

    assert shared_dir(spark)
    with pytest.raises(ValueError):
        shared_dir(Cluster())


def test_lexical_density_and_tagger(spark):
    assert _one(spark, T.lexical_density(F.col("t")), t=("array<string>", ["dog", "although", "12", "runs"])) == 0.5
    assert _one(spark, T.lexical_density(F.col("t")), t=("array<string>", [])) == 0.0
    assert _one(spark, features.tagged_density(F.col("t"), lambda ts: ["NN" if len(t) > 2 else "DT" for t in ts]), t=("array<string>", ["dog", "a"])) == 0.5


def test_embedded_cosine(spark):
    encoder = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert _one(spark, features.embedded_cosine(F.col("a"), F.col("b"), encoder), a=("string", "xy"), b=("string", "ab")) == pytest.approx(1.0)
    assert math.isclose(_one(spark, T.cosine(F.col("a"), F.col("b")), a=("array<double>", [1.0, 0.0]), b=("array<double>", [1.0, 1.0])), 2**-0.5)
