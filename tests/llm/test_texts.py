"""Problems 3 to 8 on dirty, empty, very long, tied and repeated rows, and on tables with extra columns of clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import packing, pairs, sampling, scans, subjects, tokens

PAIRS = "pair_id bigint, question string, generated_answers array<string>, answers array<string>, defect string"
QUESTION = "Why did the old sailor cross the wide river before the harbour froze?"


def _defects(spark, rows):
    return sorted((r.pair_id, r.field_name, r.pos, r.defect) for r in pairs.find(spark.createDataFrame(rows, PAIRS)).collect())


@pytest.mark.parametrize("text, want", [
    (None, "empty"), ("  ", "empty"), ("<p></p>", "empty"), ("N/A", "empty"), ("—", "empty"),
    ("The old sailor feared the ice and", "truncated"), ("He said: \"It was cold", "truncated"), ("Because the ice (thick", "truncated"),
    ("I'm afraid we are not allowed to comment on this.", "refusal"), ("Unfortunately, my guidelines do not permit me to evaluate this.", "refusal"), ("Dazu darf ich mich leider nicht äußern.", "refusal"),
    ("Je ne suis pas en mesure de répondre à cette demande.", "refusal"), ("Lo siento, pero no puedo ayudarte con eso.", "refusal"), ("The assistant refused to give an answer.", "refusal"),
    (QUESTION, "copy"), (QUESTION.upper(), "copy"), ("Question: " + QUESTION, "copy"),
    ("Weil der alte Seemann nicht auf das Eis gehen wollte und die Stadt noch offen war.", "language"),
    ("Because of the ice.", None), (QUESTION + " Because the ice was near.", None), ("\"I cannot say,\" the sailor replied, for the harbour had closed.", None), ("It could not be crossed later, so the sailor went early.", None),
])
def test_each_defect(spark, text, want):
    got = _defects(spark, [(1, QUESTION, [text], [], "x")])
    assert got == ([(1, "generated_answers", 0, want)] if want else [])


def test_pairs_of_nulls_and_repeats(spark):
    rows = [(None, QUESTION, [""], [""], "x"), (2, None, [None, "Fine."], None, "x"), (2, None, [None, "Fine."], None, "x"), (3, QUESTION, [], ["no response"], "x"), (4, None, None, None, None)]
    assert _defects(spark, rows) == [(2, "generated_answers", 0, "empty"), (3, "answers", 0, "empty")]
    assert _defects(spark, []) == []


def test_a_very_long_copy_is_linear():
    prompt = [f"w{i % 5000}" for i in range(20_000)]
    covered = pairs.SuffixAutomaton(prompt).covered(prompt * 5, 2)
    assert all(covered) and len(covered) == 100_000


def test_scans_of_empty_tables_and_clashing_columns(spark):
    schema = "context_id bigint, context string, noise string, item string, word string, n int"
    empty = spark.createDataFrame([], schema)
    assert scans.find(empty).count() == 0 and scans.repaired(empty).count() == 0
    rows = [(1, "", "a", "b", "c", 1), (2, None, "a", "b", "c", 1), (None, "x", "a", "b", "c", 1), (3, "A line.", "a", "b", "c", 1), (3, "A line.", "a", "b", "c", 1)]
    df = spark.createDataFrame(rows, schema)
    assert scans.find(df).count() == 0
    assert dict(map(tuple, scans.repaired(df).collect())) == {1: "", 2: None, 3: "A line."}


def test_a_very_long_page(spark):
    line = "the harbour of the town was quiet before the boat had crossed the wide"
    text = "\n".join([line] * 5_000)
    ((key, out),) = scans.repaired(spark.createDataFrame([(1, text)], "context_id bigint, context string")).collect()
    assert key == 1 and out == " ".join([line] * 5_000)


SHARES = "label int, domain_name string, share_bp int, min_rows int"
QA = "qa_id bigint, label int, fileid string, cell int, h string"


def _qa(spark, counts):
    rows, i = [], 0
    for (label, domain), n in counts.items():
        for _ in range(n):
            rows.append((i, label, f"devset/{domain}/f.txt", 1, "x"))
            i += 1
    return spark.createDataFrame(rows, QA)


def test_sample_follows_shares_and_minimums(spark):
    shares = spark.createDataFrame([(0, "a", 5000, 0), (1, "a", 2500, 0), (1, "b", 2400, 5), (2, "gone", 100, 3)], SHARES)
    rows = _qa(spark, {(0, "a"): 3000, (1, "a"): 900, (1, "b"): 1000, (2, "other"): 100})
    sample, report = sampling.draw(rows.unionByName(rows.limit(50)), shares)
    got = {(r.label, r.domain_name): r for r in report.collect()}
    assert sample.count() == 1000 == sample.select("qa_id").distinct().count() == sum(r.drawn for r in got.values())
    assert all(r.converged for r in got.values()) and got[2, "gone"].gap == 10 and got[1, "b"].drawn >= 240
    assert {(r.label, r.domain_name) for r in sampling.short_categories(report).collect()} == {(2, "gone")}
    again = sampling.draw(rows, shares)[0]
    assert {r.qa_id for r in sample.collect()} == {r.qa_id for r in again.collect()}
    left = {(r.margin, r.value): r for r in sampling.residuals(report).collect()}
    assert left["domain_name", "gone"].residual == -10.0 and left["label", "2"].drawn == 0


def test_sample_of_empty_tables(spark):
    none, shares = spark.createDataFrame([], QA), spark.createDataFrame([(0, "a", 10000, 2)], SHARES)
    sample, report = sampling.draw(none, shares)
    assert sample.count() == 0 and [r.gap for r in report.collect()] == [2]
    sample, report = sampling.draw(_qa(spark, {(0, "a"): 10}), shares.limit(0))
    assert sample.count() == 0 and report.count() == 0


def test_keys_are_cut_exactly(spark):
    """Within a category the drawn rows are those of the smallest hashes."""
    rows = _qa(spark, {(0, "a"): 400, (1, "a"): 100})
    shares = spark.createDataFrame([(0, "a", 8000, 0), (1, "a", 2000, 0)], SHARES)
    drawn = {r.qa_id for r in sampling.draw(rows, shares)[0].collect()}
    hashes = {r.qa_id: (r.label, r.h) for r in rows.select("qa_id", "label", F.shiftrightunsigned(F.xxhash64("qa_id", F.lit(42)), 1).alias("h")).collect()}
    for label in (0, 1):
        kept = [h for i, (lab, h) in hashes.items() if lab == label and i in drawn]
        rest = [h for i, (lab, h) in hashes.items() if lab == label and i not in drawn]
        assert max(kept) < min(rest)


def test_rake_reports_convergence():
    q, settled = sampling.rake(np.array([100, 100, 100, 0]), np.array([10.0, 20, 30, 40]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])])
    assert q[3] == 0 and (settled or len(q) == 4)
    assert sampling.rake(np.array([50, 50]), np.array([10.0, 20.0]), [np.array([0, 1])])[1]


DOCS = "doc_id bigint, text string, source string, fileid string, key string, ids string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}", "devset/a/x.txt", "k", "i") for i, t in texts], DOCS)


def test_encoding_is_exact_on_long_unsplit_text(spark):
    rng = np.random.default_rng(1)
    long = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 30_000)), "ab" * 20_000, " " * 30_000 + "x", "é" * 9_000, "word " * 9_000, "日本" * 9_000]
    texts = [*enumerate(long), (100, ""), (101, None), (102, "<|endoftext|> plain"), (0, long[0])]
    got = {r.doc_id: r.ids for r in tokens.encode(_docs(spark, texts)).collect()}
    enc = tokens.encoder()
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in texts}
    assert tokens.encode(_docs(spark, [])).count() == 0


def test_repeated_keys_give_the_smallest_row(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "x")], "doc_id bigint, text string")
    assert sorted(map(tuple, tokens.one_row_each(rows, "doc_id").collect()), key=str) == [(1, "a"), (2, None)]


def test_packing(spark):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(["word"] * int(rng.integers(0, 700)))) for i in range(300)] + [(1000, "tea " * 5000), (1001, "tea " * 2048), (1002, None), (1003, "")]
    out = packing.assign(_docs(spark, texts + texts[:5]), shard=100).collect()
    room: dict = {}
    for r in out:
        room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
    assert max(room.values()) <= 2048 and len({(r.doc_id, r.part) for r in out}) == len(out)
    enc = tokens.encoder()
    for i, t in texts:
        mine = sorted((r.part, r.first_token, r.n_tokens) for r in out if r.doc_id == i)
        n = len(enc.encode_ordinary(t or ""))
        assert sum(x[2] for x in mine) == n and [x[1] for x in mine] == [2048 * k for k in range(len(mine))] and (len(mine) == -(-n // 2048))
    assert packing.assign(_docs(spark, [])).count() == 0


def test_equal_texts_avoid_each_other():
    at = packing.pack([10] * 40, [None] * 40, list(range(20)) * 2, capacity=100)
    assert all(at[i] != at[i + 20] for i in range(20)) and max(at) + 1 <= 5
    crowd = packing.pack([10] * 40, [None] * 40, ["same"] * 40, capacity=100)  # more copies than containers
    assert len(set(crowd)) <= 6


def test_more_clusters_than_any_word_has_bits():
    n = 9_000
    at = packing.pack([1] * (2 * n), [None] * (2 * n), list(range(n)) * 2, capacity=100)
    assert all(at[i] != at[i + n] for i in range(n)) and max(at) + 1 <= 2 * n // 100 + 2


AREAS = [("law", "Law", ""), ("sport", "Sport", "")]
WORDS = {"law": "judge court verdict appeal statute clause", "sport": "striker goal referee match league trophy"}


def _examples(spark):
    rows = []
    for subject, listed in WORDS.items():
        w = listed.split()
        rows += [(len(rows) + i, f"The {a} and the {b} met again. The {b} stood near the {a}.", [subject]) for i, (a, b) in enumerate(zip(w * 5, w[1:] * 6, strict=False))]
    return spark.createDataFrame(rows, "example_id bigint, text string, subjects array<string>")


def test_subjects(spark):
    areas = spark.createDataFrame(AREAS, "subject string, title string, scope string")
    half = "The judge read the verdict. The court heard the appeal. The striker met the referee. The goal won the match."
    texts = [(1, "The judge read the verdict. The court heard the appeal."), (2, half), (3, ""), (4, None), (5, "Nothing much was there. It went on."), (2, half)]
    got = {(r.doc_id, r.subject) for r in subjects.assign(_docs(spark, texts), areas, _examples(spark)).collect()}
    assert got == {(1, "law"), (2, "law"), (2, "sport")}
    assert subjects.assign(_docs(spark, []), areas, _examples(spark)).count() == 0


def test_parts_know_headings_and_lone_sentences():
    got = subjects.parts("The Law\n\nThe judge spoke. The court rose.\n\nAll was well.\n\nEnd of it all.")
    assert got == [("The Law", True, True), ("The judge spoke.", False, False), ("The court rose.", False, False), ("All was well.", False, True), ("End of it all.", False, False)]


def test_held_out_examples(spark):
    """Fitted on every other labelled text, the subjects of the rest are found."""
    examples = spark.read.parquet("/root/testdata/sf0.001/subject_examples.parquet")
    areas = spark.read.parquet("/root/testdata/sf0.001/subject_areas.parquet")
    rest = examples.where("example_id % 2 = 1")
    docs = rest.select(F.col("example_id").alias("doc_id"), "text", F.lit("s").alias("source"), F.lit("devset/a/x.txt").alias("fileid"))
    got = {(r.doc_id, r.subject) for r in subjects.assign(docs, areas, examples.where("example_id % 2 = 0")).collect()}
    want = {(r.example_id, s) for r in rest.collect() for s in r.subjects}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    print("held out:", len(want), len(got), len(got & want))
    assert recall >= 0.95 and precision >= 0.95
