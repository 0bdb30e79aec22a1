"""Text functions as columns: normal form, tokens, n-gram sets, overlaps, question type, sentences, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.words import CLOSED, STOPWORDS

#: White space of Unicode, spelled out so that each engine reads it alike.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD = r"[\p{L}\p{N}]+"
#: Words of two letters or more, as term weights count them.
TERM = r"[\p{L}\p{N}_]{2,}"
# The classes of questions in order; others have the number after the last.
QUESTION_WORDS = ["who", "what", "when", "where", "why", "how", "which"]
# Words whose full stop ends no sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Rev", "St", "Mt", "Jr", "Sr", "vs", "etc"]
CLOSERS = r"[.!?]+['\"”’\)\]}]*"


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends; a null text reads 'none' (the text 'None')."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit("None"))), SPACE, " "))


#: The steps of the treebank mode: a pattern and what takes its place, {1} being its first group.
TREEBANK = [
    (r"(^|[ (\[{<])\"", "{1} `` "),
    (r"([:,])([^\d]|$)", " {1} {2}"),
    (r"(\.{2,}|--|[;@#$%&?!\[\](){}<>])", " {1} "),
    (r"([\p{L}\p{N}]{2,}|\d)\.([\"'”’»]*)( |$)", "{1} . {2} "),
    (r"\"", " '' "),
    (r"([^' ])('s|'m|'d|'ll|'re|'ve|n't)( |$|[.,:])", "{1} {2} {3}"),
    (r"(^| )(can)(not)( |$)", "{1}{2} {3}{4}"),
    (r"(^| )(gon|wan)(na)( |$)", "{1}{2} {3}{4}"),
]


def tokenize(normal: Column, mode: str = "simple", stop: list[str] | None = None) -> Column:
    """Tokens of a text in normal form without single punctuation marks and without the words of ``stop``.

    Mode 'simple': runs of letters and digits. Mode 'treebank': contractions, quotes and punctuation come
    apart as in the Penn conventions, by regular expressions; every word-final full stop is split off, as the
    normal form has no capitals to tell abbreviations by.
    """
    stop = STOPWORDS if stop is None else stop
    if mode == "simple":
        tokens = F.regexp_extract_all(normal, F.lit(WORD), F.lit(0))
    elif mode == "treebank":
        spaced = normal
        for pattern, put in TREEBANK:
            spaced = F.regexp_replace(spaced, pattern, put.replace("{1}", "$1").replace("{2}", "$2").replace("{3}", "$3").replace("{4}", "$4"))
        tokens = F.filter(F.split(spaced, " +"), lambda t: ~t.rlike(r"^[\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}]?$"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def ngrams(tokens: Column, n: int) -> Column:
    """The distinct n-grams, their tokens joined by blanks; fewer than n tokens give none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return F.array_distinct(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


METRICS = ("jaccard", "precision", "recall")


def overlap(s1: Column, s2: Column, metric: str) -> Column:
    """Share of common n-grams: 0 if both sets are empty; recall is 1 and precision 0 where only its own set is empty."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    n1, n2 = F.size(s1), F.size(s2)
    both = F.size(F.array_intersect(s1, s2)).cast("double")
    empty = (n1 == 0) & (n2 == 0)
    if metric == "jaccard":
        return F.when(empty, 0.0).otherwise(both / (n1 + n2 - both))
    if metric == "recall":
        return F.when(empty, 0.0).when(n2 == 0, 1.0).otherwise(both / n2)
    return F.when(n1 == 0, 0.0).otherwise(both / n1)


def conditional_overlap(s1: Column, s2: Column, s3: Column) -> Column:
    """Share of what s2 has beyond s3 that is in s1; 1 where there is nothing beyond s3."""
    rest = F.array_except(s2, s3)
    return F.when(F.size(rest) == 0, 1.0).otherwise(F.size(F.array_intersect(s1, rest)) / F.size(rest).cast("double"))


def question_type(normal: Column) -> Column:
    """0 to 6 by the question word a text begins with, not bounded by a word ('however' begins with how); else 7."""
    out = F.lit(None)
    for i, w in reversed(list(enumerate(QUESTION_WORDS))):
        out = F.when(normal.startswith(w), F.lit(float(i))).otherwise(F.lit(float(len(QUESTION_WORDS))) if i == len(QUESTION_WORDS) - 1 else out)
    return out


def lexical_density(tokens: Column) -> Column:
    """Share of nouns, verbs, adjectives and adverbs among the tokens, 0 without tokens.

    The rule behind it: what isn't in a closed class and has a letter is one of these four. A trained tagger
    can take its place, see :func:`gradeloom.operators.features.tagged_density`.
    """
    content = F.filter(tokens, lambda t: t.rlike(r"\p{L}") & ~t.isin(CLOSED))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(content) / F.size(tokens).cast("double"))


def sentences(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Sentences of a text: it is cut behind closing marks with their quotes and brackets, before white space and a capital or digit.

    No cut is made behind one of the ``abbreviations`` or a single capital. Null and blank texts give no sentence.
    """
    listed = ABBREVIATIONS if abbreviations is None else abbreviations
    guard = "".join(rf"(?<!\b{a})" for a in listed) + (r"(?<!\b[A-Z])" if listed else "")
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{guard}({CLOSERS}){SPACE}(?=[A-Z0-9])", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, rf"^{SPACE}|{SPACE}$", "")), lambda s: s != "")


def words_of(text: Column) -> Column:
    """How many words, parted by white space, a text has."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def chunks(parts: Column, key: Column, low: int = 150, high: int = 800, keep_empty: bool = False) -> Column:
    """Sentences packed greedily: one joins the chunk if both have, with one word to spare, at most the target's words.

    Targets lie between ``low`` and ``high``, drawn anew for each chunk by a hash of ``key`` and the chunk's number
    (``low`` = ``high``: fixed). The last chunk stays only if it has ``low`` words. A first sentence longer than
    its target closes an empty chunk, which is kept only with ``keep_empty``.
    """
    target = lambda k: F.lit(low) + F.pmod(F.xxhash64(key, k), F.lit(high - low + 1)).cast("int")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"), F.lit(0).alias("k"))

    def step(s, x):
        n = words_of(x)
        fits = s["n"] + n + 1 <= target(s["k"])
        closed = F.concat(s["done"], F.array(F.array_join(s["now"], " ")))
        return F.struct(
            F.when(fits, s["done"]).otherwise(closed).alias("done"),
            F.when(fits, F.concat(s["now"], F.array(x))).otherwise(F.array(x)).alias("now"),
            F.when(fits, s["n"] + n).otherwise(n).alias("n"),
            F.when(fits, s["k"]).otherwise(s["k"] + 1).alias("k"),
        )

    def end(s):
        out = F.when((s["n"] >= low) & (F.size(s["now"]) > 0), F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"])
        return out if keep_empty else F.filter(out, lambda c: c != "")

    return F.aggregate(parts, start, step, end)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of one length; null where one is null, of another length or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
