"""Row-local text features (survey T1 to T8, T12 to T14), fitted ones (T9 to T11) and the bundle of them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T

#: Texts and n-gram sets that a feature can ask for: ("text", field) or ("tokens", field) or ("grams", field, n).
Need = tuple


@dataclass(frozen=True)
class Feature:
    """A named number of a row: ``make`` gets a function from needs to columns.

    Any object with ``name``, ``needs`` and ``make`` will do; what a row's features share (normal form,
    tokens, n-gram sets) is computed once for all of them.
    """

    name: str
    needs: tuple[Need, ...]
    make: Callable[[Callable[..., Column]], Column] = field(compare=False)


def token_length(a: str) -> Feature:
    return Feature(f"token_length_{a}", (("tokens", a),), lambda g: F.size(g("tokens", a)).cast("double"))


def lexical_density(a: str) -> Feature:
    return Feature(f"lexical_density_{a}", (("tokens", a),), lambda g: T.lexical_density(g("tokens", a)))


def question_type(a: str) -> Feature:
    return Feature(f"question_type_{a}", (("text", a),), lambda g: T.question_type(g("text", a)))


def overlap(a: str, b: str, n: int = 1, metric: str = "jaccard") -> Feature:
    """Raises ValueError for an unknown metric before any row is read."""
    if metric not in T.METRICS:
        raise ValueError(f"metric must be one of {T.METRICS}")
    return Feature(f"{metric}_{n}gram_{a}_{b}", (("grams", a, n), ("grams", b, n)), lambda g: T.overlap(g("grams", a, n), g("grams", b, n), metric))


def conditional_overlap(a: str, b: str, given: str, n: int = 1) -> Feature:
    return Feature(f"cond_overlap_{n}gram_{a}_{b}_{given}", tuple(("grams", x, n) for x in (a, b, given)), lambda g: T.conditional_overlap(*(g("grams", x, n) for x in (a, b, given))))


def extract(rows: DataFrame, keep: list[str], fields: dict[str, str], features: list[Feature], mode: str = "simple", stop: list[str] | None = None) -> DataFrame:
    """keep..., and a DOUBLE column for each feature, by built-in expressions only.

    ``fields`` maps short names to (nested) columns; an unknown column or field raises when the plan is made. A null text reads 'None', an
    empty one has no tokens. Repeated rows are featured each.
    """
    needs = {n for f in features for n in f.needs}
    named = {x: sorted({n[1] for n in needs if n[0] == x or x == "text"}) for x in ("text", "tokens")}
    grams = sorted(n for n in needs if n[0] == "grams")
    named["tokens"] = sorted({*named["tokens"], *(g[1] for g in grams)})
    kept = [F.col(f"`{k}`") for k in keep]
    out = rows.select(*kept, *(T.normalize(F.col(fields[a])).alias(f"__text_{a}") for a in named["text"]))
    out = out.select(*kept, *(f"__text_{a}" for a in named["text"] if ("text", a) in needs), *(T.tokenize(F.col(f"__text_{a}"), mode, stop).alias(f"__tokens_{a}") for a in named["tokens"]))
    out = out.select("*", *(T.ngrams(F.col(f"__tokens_{a}"), n).alias(f"__grams_{a}_{n}") for _, a, n in grams))
    return out.select(*kept, *(f.make(lambda *need: F.col("__" + "_".join(map(str, need)))).alias(f.name) for f in features))


def tagged_density(tokens: Column, tagger: Callable[[list[str]], list[str]]) -> Column:
    """:func:`lexical_density` by a tagger of one's own, which gives a tag for each token: the share of tags in N, V, J or R.

    The tagger runs in Arrow batches; None and [] give 0.
    """

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            tags = [tagger(list(t)) if t is not None and len(t) else [] for t in batch]
            yield pd.Series([sum(x[:1] in "NVJR" for x in t) / len(t) if t else 0.0 for t in tags], dtype=float)

    return share(tokens)


def embedded_cosine(a: Column, b: Column, encoder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """Cosine of the embeddings of two texts by an encoder of one's own, loaded once by each worker.

    ``encoder()`` loads and returns a function from texts to vectors; a text without a vector gives null.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in encode(["" if t is None else t for t in batch])])

    return T.cosine(embed(a), embed(b))


def tfidf_cosine(rows: DataFrame, key: str, a: str, b: str, stop: list[str] | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(key, cosine) of the term weights of two texts: raw counts times ln((1 + N) / (1 + df)) + 1.

    Terms are words of two letters or more outside ``stop``. Without ``corpus`` (a frame with one text column)
    the weights are fitted on both texts of all rows, N being twice the number of distinct keys. Repeats of a
    row make both its vectors longer, not its cosine; rows without a key give none, texts without terms 0.
    Rows must not repeat a key with other texts.
    """
    from gradeloom.functions.words import STOPWORDS

    stop = STOPWORDS if stop is None else stop
    terms = lambda c: F.filter(F.regexp_extract_all(T.normalize(F.col(c)), F.lit(T.TERM), F.lit(0)), lambda t: ~t.isin(stop)) if stop else F.regexp_extract_all(T.normalize(F.col(c)), F.lit(T.TERM), F.lit(0))
    each = lambda c, one, two: rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(terms(c)).alias("term"), F.lit(one).alias("x"), F.lit(two).alias("y"))
    counts = each(a, 1, 0).unionByName(each(b, 0, 1)).groupBy("k", "term").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    if corpus is None:
        df = counts.groupBy("term").agg(F.sum(F.expr("CAST(x > 0 AS INT) + CAST(y > 0 AS INT)")).alias("df"))
        n = rows.where(F.col(key).isNotNull()).agg((F.countDistinct(key) * 2).alias("n"))
    else:
        (text,) = corpus.columns
        df = corpus.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        n = corpus.agg(F.count("*").alias("n"))
    weights = df.join(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w"))  # n is one row
    both = counts.join(weights, "term").select("k", (F.col("x") * F.col("w")).alias("x"), (F.col("y") * F.col("w")).alias("y"))
    sums = both.groupBy("k").agg(F.sum(F.expr("x * y")).alias("xy"), F.sum(F.expr("x * x")).alias("xx"), F.sum(F.expr("y * y")).alias("yy"))
    got = sums.select("k", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy"))).otherwise(0.0).alias("cosine"))
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    return keys.join(got, "k", "left").select(F.col("k").alias(key), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


@dataclass
class TrigramModel:
    """Counts of an interpolated Kneser–Ney model of order 3, as tables.

    p(w | u v) = max(c(uvw) - D, 0) / c(uv) + D t(uv) / c(uv) p(w | v), with t the number of different followers;
    the lower orders count predecessors: p(w | v) the pairs (u, v) before w among all trigrams around v, p(w) the
    different predecessors of w among all different bigrams. Unseen contexts fall back at once; a word that the
    corpus doesn't have has probability 0.
    """

    three: DataFrame  # u, v, w, c
    pair: DataFrame  # u, v, n (tokens after it), t (different followers)
    two: DataFrame  # v, w, c (different u before)
    one: DataFrame  # v, n (different (u, w) around), t (different followers)
    word: DataFrame  # w, p
    discount: float


def fit_trigrams(tokens: DataFrame, discount: float = 0.1) -> TrigramModel:
    """``tokens`` has one array column; each text is padded by two marks at both ends."""
    (c,) = tokens.columns
    pad = lambda mark: F.array(F.lit(mark), F.lit(mark))
    seq = tokens.select(F.concat(pad("<s>"), F.col(c), pad("</s>")).alias("s"))
    three = seq.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 2), lambda i: F.struct(F.element_at("s", i).alias("u"), F.element_at("s", i + 1).alias("v"), F.element_at("s", i + 2).alias("w")))).alias("g")).select("g.*")
    three = three.groupBy("u", "v", "w").agg(F.count("*").alias("c"))
    # Each bigram but a text's first ends a trigram, and the first one is always the two opening marks.
    bigrams = three.select(F.col("v").alias("a"), F.col("w").alias("b")).unionByName(three.limit(1).select(F.lit("<s>").alias("a"), F.lit("<s>").alias("b"))).distinct()
    pair = three.groupBy("u", "v").agg(F.sum("c").alias("n"), F.count("*").alias("t"))
    two = three.groupBy("v", "w").agg(F.count("*").alias("c"))
    followers = bigrams.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("t"))
    one = three.groupBy("v").agg(F.count("*").alias("n")).join(followers, "v")
    total = bigrams.agg(F.count("*").alias("n"))
    word = bigrams.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("c")).join(F.broadcast(total)).select("w", (F.col("c") / F.col("n")).alias("p"))
    return TrigramModel(three, pair, two, one, word, discount)


def trigram_perplexity(rows: DataFrame, key: str, tokens: str, model: TrigramModel) -> DataFrame:
    """(key, perplexity) of each row: 2 to the mean negative log2 probability of its trigrams.

    Fewer than three tokens (or null) give 0, a word of probability 0 infinity. Each different trigram is
    judged once. Repeats of a row count once.
    """
    t = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(tokens).alias("s")).dropDuplicates(["k"])
    grams = F.when(F.size("s") < 3, F.array().cast("array<struct<u:string,v:string,w:string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size("s") - 2), lambda i: F.struct(F.element_at("s", i).alias("u"), F.element_at("s", i + 1).alias("v"), F.element_at("s", i + 2).alias("w"))))
    each = t.where(F.size("s") >= 3).select("k", F.explode(grams).alias("g")).groupBy("k", "g.u", "g.v", "g.w").agg(F.count("*").alias("m"))
    distinct = each.select("u", "v", "w").distinct()
    d, m = F.lit(model.discount), model
    p = distinct.join(m.three.withColumnRenamed("c", "c3"), ["u", "v", "w"], "left").join(m.pair.withColumnsRenamed({"n": "n3", "t": "t3"}), ["u", "v"], "left")
    p = p.join(m.two.withColumnRenamed("c", "c2"), ["v", "w"], "left").join(m.one.withColumnsRenamed({"n": "n2", "t": "t2"}), "v", "left").join(m.word, "w", "left")
    p1 = F.coalesce("p", F.lit(0.0))
    p2 = F.when(F.col("n2").isNull(), p1).otherwise(F.greatest(F.coalesce("c2", F.lit(0)) - d, F.lit(0.0)) / F.col("n2") + d * F.col("t2") / F.col("n2") * p1)
    p3 = F.when(F.col("n3").isNull(), p2).otherwise(F.greatest(F.coalesce("c3", F.lit(0)) - d, F.lit(0.0)) / F.col("n3") + d * F.col("t3") / F.col("n3") * p2)
    judged = each.join(p.select("u", "v", "w", p3.alias("p")), ["u", "v", "w"])
    sums = judged.groupBy("k").agg(F.sum(F.when(F.col("p") > 0, F.log2("p") * F.col("m"))).alias("lp"), F.sum("m").alias("m"), F.max(F.col("p") <= 0).alias("zero"))
    got = sums.select("k", F.when(F.col("zero"), F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), -F.col("lp") / F.col("m"))).alias("perplexity"))
    return t.select("k").join(got, "k", "left").select(F.col("k").alias(key), F.coalesce("perplexity", F.lit(0.0)).alias("perplexity"))
