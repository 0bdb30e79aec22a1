"""Problem 8: the subjects of each document, by labelling functions and a latent model of their accuracy."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.paths import domain_of
from gradeloom.llm.pairs import FUNCTION_WORDS
from gradeloom.llm.tokens import one_row_each
from gradeloom.storage import written

WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
BREAK = re.compile(r"<\s*/?\s*(?:p|br|div|li|ul|ol|h[1-6]|tr|table|section|article)\b[^<>]*>", re.I)
INVISIBLE = re.compile("[​-‏⁠﻿­]")
ODD_BLANK = re.compile("[  -   　\t\r\f\v]")
SPLIT = re.compile(r"(?<=[.!?…])(?<!\b[A-Z]\.)(?:[\"”»’')\]]*)\s+(?=[\"“„«(\[¿¡]*[A-ZÀ-ÖØ-Þ0-9])")
END = re.compile(r"[.!?…][\"”»’'*_)\]]*$")
#: German nouns are written like names; they follow an article, names don't.
ARTICLES = {"die", "der", "das", "den", "dem", "des"}
HEADING_WORDS = 5


def clean(text: str) -> str:
    """Text without markup, entities, invisible characters and doubly encoded letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", BREAK.sub("\n\n", text))
    if "Ã" in text or "â€" in text:
        text = "".join(_decoded(part) for part in re.split(r"(\s+)", text))
    return ODD_BLANK.sub(" ", INVISIBLE.sub("", text))


def _decoded(word: str) -> str:
    if "Ã" not in word and "â€" not in word:
        return word
    for kind in ("cp1252", "latin-1"):
        try:
            return word.encode(kind).decode("utf-8")
        except UnicodeError:
            pass
    return word


def parts(text: str) -> list[tuple[str, bool, bool]]:
    """(sentence, whether it is a heading, whether it stands alone before another paragraph) in the order of the text.

    A paragraph that isn't closed by a full stop is a heading unless it is longer than one line can be.
    """
    out: list[tuple[str, bool, bool]] = []
    paragraphs = re.split(r"\n\s*\n", text)
    for n, paragraph in enumerate(paragraphs):
        lines = [x.strip() for x in paragraph.split("\n") if x.strip()]
        if not lines:
            continue
        sentences = [s for s in SPLIT.split(" ".join(lines)) if WORD.search(s)]
        alone = len(sentences) == 1
        for i, s in enumerate(sentences):
            closed = bool(END.search(s.strip())) or i + 1 < len(sentences)
            out.append((s, not closed and alone and len(WORD.findall(s)) <= 12, alone and n + 1 < len(paragraphs)))
    return out


def terms(sentence: str) -> list[tuple[str, bool]]:
    """(word in lower case, whether it can't be a name here) for each word of a sentence."""
    out, before = [], ""
    for m in WORD.finditer(sentence):
        w = m.group()
        out.append((w.lower(), w[0].islower() or before in ARTICLES))
        before = w.lower()
    return out


class Lexicon:
    """Log odds of words for subjects, fitted on labelled texts."""

    def __init__(self, subjects: list[str], weights: dict[str, dict[int, float]], margin: float = 0.7):
        self.subjects, self.weights, self.margin = subjects, weights, margin

    def vote(self, words: set[str]) -> int:
        """1 + the number of the subject that the words speak for; 0 if they don't."""
        score: dict[int, float] = defaultdict(float)
        for w in sorted(words & self.weights.keys()):
            for s, v in self.weights[w].items():
                score[s] += v
        if not score:
            return 0
        ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
        second = max(ranked[1][1], 0.0) if len(ranked) > 1 else 0.0
        return ranked[0][0] + 1 if ranked[0][1] > 0 and ranked[0][1] - second >= self.margin else 0


def fit_lexicon(examples: list[tuple[str, list[str]]], subjects: list[str], smooth: float = 0.3, rounds: int = 2) -> Lexicon:
    """Counts words by subject over labelled sentences.

    A sentence of a text with one subject counts for it. Those of texts with several count, from the second
    round on, for the one of these that the words so far speak for. Words that are only ever written
    like names, and function words, speak for nothing.
    """
    number = {s: i for i, s in enumerate(subjects)}
    stop = {w for each in FUNCTION_WORDS.values() for w in each}
    data = []
    for text, labels in examples:
        known = sorted({number[x] for x in labels or () if x in number})
        if text and known:
            data += [(terms(s), known) for s, heading, _ in parts(clean(text)) if not heading]
    proper = Counter(w for found, _ in data for w, common in found if common)
    seen = Counter(w for found, _ in data for w, _ in found)
    lexicon = Lexicon(subjects, {})
    for step in range(rounds):
        count: dict[str, Counter] = defaultdict(Counter)
        size = Counter()
        for found, known in data:
            if len(known) > 1:
                if not step:
                    continue
                vote = lexicon.vote({w for w, _ in found}) - 1
                if vote not in known:
                    continue
                known = [vote]
            size[known[0]] += 1
            for w in {w for w, _ in found}:
                if w not in stop and proper[w] * 4 >= seen[w]:
                    count[w][known[0]] += 1
        weights = {}
        for w, by in count.items():
            rate = {s: (by[s] + smooth) / (size[s] + 1) for s in size}
            mean = sum(rate.values()) / len(rate)
            # Words spread over all subjects say nothing; one seen twice in a single subject says a lot.
            odds = {s: math.log(r / mean) for s, r in rate.items()}
            top = max(by.values()) / sum(by.values())
            if top >= 0.35 and len(by) <= 4:
                weights[w] = {s: v * min(1.0, sum(by.values()) / 3) for s, v in odds.items() if v > 0.2 and by[s]}
        lexicon = Lexicon(subjects, weights)
    return lexicon


def latent(patterns: np.ndarray, counts: np.ndarray, classes: int, rounds: int = 25, smooth: float = 1.0, belief: float = 50.0, trust: float = 0.95) -> np.ndarray:
    """Posterior of the latent class of each vote pattern, the functions' accuracies being learned from their agreement.

    ``patterns`` has a column for each labelling function (0: it abstains); class 0 is no subject. Each function
    has a confusion table of its own; expectation and maximisation take turns from the first function's votes.
    The first function, which is fitted on labelled texts, is right with at least the share ``trust`` of its
    votes, whatever the others say together. For the others ``belief`` votes of each class count beforehand, as frequent as they are in all classes
    together; they decide only where there are hardly any sentences.
    """
    n, f = patterns.shape
    post = np.full((n, classes), 0.02 / max(classes - 1, 1))
    post[np.arange(n), patterns[:, 0]] = 0.98
    for _ in range(rounds):
        mass = post * counts[:, None]
        prior = (mass.sum(axis=0) + smooth) / (mass.sum() + smooth * classes)
        log = np.tile(np.log(prior), (n, 1))
        for j in range(f):
            if j:
                often = np.bincount(patterns[:, j], weights=counts, minlength=classes) / counts.sum()
                table = np.tile((smooth + belief) * often, (classes, 1)) + 1e-9
            else:
                table = np.full((classes, classes), smooth / classes)
            np.add.at(table.T, patterns[:, j], mass)
            table /= table.sum(axis=1, keepdims=True)
            if not j:  # where it doesn't abstain
                table[1:, 1:] = trust * np.diag(table[1:, 1:].sum(axis=1)) + (1 - trust) * table[1:, 1:]
            log += np.log(table[:, patterns[:, j]]).T
        fresh = np.exp(log - log.max(axis=1, keepdims=True))
        fresh /= fresh.sum(axis=1, keepdims=True)
        if np.abs(fresh - post).max(initial=0.0) < 1e-6:
            post = fresh
            break
        post = fresh
    return post


def assign(documents: DataFrame, areas: DataFrame, examples: DataFrame, share: float = 0.25, max_examples: int = 20_000) -> DataFrame:
    """doc_id, subject, sentences, of_sentences: each subject that at least ``share`` of a document's sentences treat.

    Labelling functions vote on each sentence: the lexicon on its words, on those of its section's heading,
    the address (the subject most frequent in the folder of its fileid) and the source. The lexicon is
    fitted on at most ``max_examples`` labelled texts (smallest ids first); everything else covers all
    documents. The latent model sees only counts of vote patterns, a table bounded by the number of subjects.
    The usual subjects of folders and sources are looked up by joins that the engine broadcasts where their measured size
    allows, and else splits on the documents' side.
    Null, empty and subjectless texts give no row; repeats of a doc_id count once.
    """
    spark = documents.sparkSession
    subjects = sorted({r.subject for r in areas.select("subject").where("subject IS NOT NULL").collect()})
    labelled = [(r.text, r.subjects) for r in examples.where("text IS NOT NULL").orderBy("example_id").limit(max_examples).select("text", "subjects").collect()]
    weights = fit_lexicon(labelled, subjects).weights
    shared = spark.sparkContext.broadcast((subjects, weights))  # bounded by the words of max_examples texts

    def vote(batches):
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                section, seen = 0, []
                for s, heading, alone in parts(clean(text)):
                    found = WORD.findall(s)
                    v = lexicon.vote(set(map(str.lower, found)))
                    if heading or not v and len(found) <= HEADING_WORDS and alone:
                        section = v
                    else:
                        seen.append((v, section))
                rows += [(key, lex, sec, len(list(g))) for (lex, sec), g in groupby(sorted(seen))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "lex", "sec", "n"])

    rows = one_row_each(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "fileid"), "doc_id")
    votes = rows.where("text IS NOT NULL AND text <> ''").select("doc_id", "text").mapInArrow(vote, "doc_id bigint, lex int, sec int, n int")
    places = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(domain_of("fileid"), F.lit("")).alias("address"))
    votes, _ = written(votes.join(places, "doc_id"))

    def usual(column: str, name: str) -> DataFrame:
        by = votes.where("lex > 0").groupBy(column, "lex").agg(F.sum("n").alias("n"))
        return by.groupBy(column).agg(F.max(F.struct("n", -F.col("lex"))).alias("m")).select(column, (-F.col("m.col2")).alias(name))

    voted = votes.join(usual("address", "adr"), "address", "left").join(usual("source", "src"), "source", "left").select("doc_id", "n", "lex", "sec", F.coalesce("adr", F.lit(0)).alias("adr"), F.coalesce("src", F.lit(0)).alias("src"))
    voted, _ = written(voted)
    pattern = ["lex", "sec", "adr", "src"]
    counted = voted.groupBy(*pattern).agg(F.sum("n").alias("n")).orderBy(*pattern).toPandas()
    schema = "lex int, sec int, adr int, src int, z int"
    if len(counted):
        seen = counted[pattern].to_numpy(int)
        z = latent(seen, counted["n"].to_numpy(float), len(subjects) + 1).argmax(axis=1)
        table = spark.createDataFrame([(*map(int, p), int(c)) for p, c in zip(seen, z, strict=True)], schema)
    else:
        table = spark.createDataFrame([], schema)
    named = spark.createDataFrame([(i + 1, s) for i, s in enumerate(subjects)], "z int, subject string")
    judged = voted.join(F.broadcast(table), pattern)
    sizes = judged.groupBy("doc_id").agg(F.sum("n").alias("of_sentences"))
    each = judged.where("z > 0").groupBy("doc_id", "z").agg(F.sum("n").alias("sentences")).join(sizes, "doc_id")
    return each.where(F.col("sentences") >= F.col("of_sentences") * share).join(F.broadcast(named), "z").select("doc_id", "subject", "sentences", "of_sentences")


def composition(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """subject, documents, share: how many documents treat each subject, and their share of all."""
    n = documents.where("doc_id IS NOT NULL").agg(F.countDistinct("doc_id").alias("n"))
    return assigned.groupBy("subject").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(n)).select("subject", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))
