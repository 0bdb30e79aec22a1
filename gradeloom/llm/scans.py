"""Problem 3: scanning noise in pages: running heads, page numbers, words divided at line ends, misread letters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.pairs import FUNCTION_WORDS
from gradeloom.llm.tokens import one_row_each
from gradeloom.storage import task_count, written

LINE = re.compile(r"\r\n|\r|\n|\x0b|\x0c|\x85| | ")
HYPHENS = "-‐‑­¬"
BROKEN = re.compile(rf"(\S*[^\W\d_])([{HYPHENS}])\s*$")
ROMAN = r"(?=[ivxlcdm])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
NUMBER = rf"(?:\d{{1,4}}|{ROMAN})"
#: A page number as it stands alone or beside a heading: bare, framed by dashes, brackets or tildes, with a word, of a total.
PAGE = rf"(?:[-–—~*|]\s*{NUMBER}\s*[-–—~*|]|[\[(<]\s*{NUMBER}\s*[\])>]|(?:page|pag\.?|p\.|pp\.|seite|s\.|pág\.?|página)\s*{NUMBER}|\d{{1,4}}\s*/\s*\d{{1,4}}|{NUMBER}\.?)"
PAGE_ALONE = re.compile(rf"^{PAGE}$", re.I)
PAGE_FIRST = re.compile(rf"^({PAGE})(?:\s{{2,}}|\t)(\S.*)$", re.I)
PAGE_LAST = re.compile(rf"^(\S.*?)(?:\s{{2,}}|\t)({PAGE})$", re.I)
CLOSED = re.compile(r"[.!?…][\"”’»')\]]*$")
TOKEN = re.compile(r"\S+")
EDGE = re.compile(r"^[^\w†]+|[^\w†]+$")
LETTER = re.compile(r"[^\W\d_]")
TITLE_WORDS = {"the", "of", "for", "and", "its", "a", "an", "in", "from", "to", "on", "at"}
#: Words that a heading doesn't end with.
BINDING = {w for each in FUNCTION_WORDS.values() for w in each if not w.isdigit()} - {"not", "no", "it", "them", "out", "how", "why"}


def broken(line: str) -> re.Match | None:
    """The match of a word divided at the end of a line."""
    line = line.rstrip()
    return BROKEN.search(line) if line and line[-1] in HYPHENS else None


def bare(token: str) -> str:
    """A token in lower case without adjoining punctuation."""
    return EDGE.sub("", token).lower().replace("’", "'")


class Page:
    """The lines of a text and what each of them is."""

    def __init__(self, text: str):
        self.lines = LINE.split(text)
        self.kind = ["" if x.strip() else "blank" for x in self.lines]
        self._judge()

    def _natural(self) -> list[int]:
        return [i for i, k in enumerate(self.kind) if not k]

    def _fill(self) -> tuple[dict[int, int], dict[int, int], int]:
        """Length of each text line before words were divided, that of its first word, and the width of the block.

        The part of a divided word that stands on the line before is counted where the word began its line.
        """
        length, first, carry = {}, {}, 0
        before = None
        for i in self._natural():
            body = self.lines[i].strip()
            cut = broken(body)
            own = carry if before is not None and not any(self.kind[j] == "blank" for j in range(before, i)) else 0
            indent = len(self.lines[i]) - len(self.lines[i].lstrip()) if len(self.lines[i]) - len(self.lines[i].lstrip()) <= 4 else 0
            length[i] = indent + own + len(body) - (len(cut.group(0)) + 1 if cut else 0)
            word = body.split()[0]
            first[i] = own + len(word)
            carry = len(cut.group(1)) if cut else 0
            before = i
        widths = sorted(length.values())
        width = widths[-1] if widths else 0
        for a, b in zip(widths[::-1], widths[-2::-1], strict=False):
            width = a
            if a - b <= 3:
                break
        return length, first, width

    def _judge(self) -> None:
        lines, kind = self.lines, self.kind
        filled = [i for i, k in enumerate(kind) if not k]
        pairs = sum(1 for a, b in zip(filled, filled[1:], strict=False) if b == a + 1)
        self.wrapped = pairs >= 1 and max((len(lines[i]) for i in filled), default=0) <= 120
        if not self.wrapped:
            return
        for i in filled:
            body = lines[i].strip()
            if PAGE_ALONE.match(body) and not self._ends_sentence(i):
                kind[i] = "pageno"
            elif (m := PAGE_FIRST.match(body)) and self._title(m.group(2)) or (m := PAGE_LAST.match(body)) and self._title(m.group(1)):
                kind[i] = "header"
        for _ in range(2):
            length, first, width = self._fill()
            natural = self._natural()
            if not natural:
                return
            for n, i in enumerate(natural):
                body = lines[i].strip()
                if not self._title(body):
                    continue
                after = i + 1 < len(lines) and kind[i + 1] == "blank"
                beside = any(0 <= j < len(lines) and kind[j] == "pageno" for j in (i - 1, i + 1))
                if after and not beside:
                    continue
                if beside and self._named(body):
                    kind[i] = "header"
                    continue
                follows = natural[n + 1] if n + 1 < len(natural) else None
                slack = width - length[i] - 1 - (first[follows] if follows is not None else 0)
                split = n > 0 and broken(lines[natural[n - 1]]) and body[:1].isupper()
                caps = self._capitals(body)
                if not caps and self._sentence(body, lines[natural[n - 1]].strip() if n else "", lines[follows].strip() if follows is not None else ""):
                    continue
                if follows is None:
                    found = beside or caps or n > 0 and len(natural) > 2
                else:
                    found = caps or beside and slack >= 1 or slack >= 3 or bool(split)
                if found:
                    kind[i] = "header"
        for i in filled:
            if not kind[i] and PAGE_ALONE.match(lines[i].strip()) and not self._ends_sentence(i):
                kind[i] = "pageno"

    def _ends_sentence(self, i: int) -> bool:
        """The number on line i is the end of the text before it, not a page number."""
        body = self.lines[i].strip()
        if not re.fullmatch(rf"{NUMBER}\.?", body, re.I):
            return False
        before = next((j for j in range(i - 1, -1, -1) if self.kind[j] not in ("header", "pageno")), None)
        if before is None or self.kind[before] == "blank" or CLOSED.search(self.lines[before].strip()):
            return False
        if not body[0].isdigit() and broken(self.lines[before]) is None and not body.endswith("."):
            return False
        if broken(self.lines[before]):
            return not body[0].isdigit() and body.endswith(".")
        after = i + 1
        while after < len(self.lines) and self.kind[after] in ("header", "pageno"):
            after += 1
        if after >= len(self.lines) or self.kind[after] == "blank":
            return body.endswith(".")
        return body.endswith(".") and self.lines[after].startswith("   ") and LETTER.search(self.lines[after]) is not None and self.lines[after].strip()[0].isupper()

    @staticmethod
    def _title(body: str) -> bool:
        if CLOSED.search(body) or not LETTER.search(body) or body[-1] in f",;{HYPHENS}" or re.search(r"[.!?;][\"”')]*\s", body):
            return False
        words = body.split()
        spaced = sum(len(w) == 1 for w in words) * 2 > len(words)
        return (len(words) <= 9 or spaced) and not body[0].islower() and body[0] not in "\"“«("

    def _sentence(self, body: str, before: str, follows: str) -> bool:
        """The line begins a sentence that goes on below, or breaks off as no heading does."""
        if "," in body or read(body.split()[-1]) in BINDING:
            return True
        goes_on = (not before or CLOSED.search(before)) and follows[:1].islower()
        return bool(goes_on) and sum(x.strip() == body for x in self.lines) < 2

    @staticmethod
    def _named(body: str) -> bool:
        """Two capitalised words or more, and small words that titles have between them."""
        words = body.split()
        return "," not in body and words[-1][:1].isupper() and sum(w[:1].isupper() for w in words) >= 2 and all(w[:1].isupper() or w in TITLE_WORDS for w in words)

    @staticmethod
    def _capitals(body: str) -> bool:
        letters = LETTER.findall(body)
        return len(letters) >= 4 and sum(x.isupper() for x in letters) >= 0.8 * len(letters) and len(body.split()) >= 2

    def paragraphs(self) -> list[list[int]]:
        """Runs of text lines; headings and page numbers within a run are skipped."""
        out, run = [], []
        for i, k in enumerate(self.kind):
            if k == "blank":
                between = next((x for x in self.kind[i + 1 :] if x != "blank"), "")
                if run and not (between in ("header", "pageno") and not CLOSED.search(self.lines[run[-1]].strip())):
                    out.append(run)
                    run = []
            elif not k:
                if run and self.wrapped and re.match(r" {2,4}\S", self.lines[i]) and CLOSED.search(self.lines[run[-1]].strip()):
                    out.append(run)
                    run = []
                run.append(i)
        return [*out, run] if run else out

    def tokens(self) -> list[list[tuple[str, str, str]]]:
        """Of each paragraph its tokens as (left, sign, right): a divided word has its sign and right half, others two empty strings."""
        out = []
        for run in self.paragraphs():
            found: list[tuple[str, str, str]] = []
            for i in run:
                words = self.lines[i].split()
                if found and found[-1][1] == "?":
                    left, _, sign = found[-1]
                    joins = words and words[0][:1].isalpha() and (words[0][:1].islower() or not left[:1].islower() and left.isupper())
                    found[-1] = (left, sign, words.pop(0)) if joins else (left + sign, "", "")
                found += [(w, "", "") for w in words]
                cut = broken(self.lines[i])
                if cut and words and self.wrapped and words[-1][-1:] in HYPHENS:
                    found[-1] = (words[-1][:-1], "?", words[-1][-1])
            if found and found[-1][1] == "?":
                found[-1] = (found[-1][0] + found[-1][2], "", "")
            out.append(found)
        return out


#: What scanning makes of letters: the sign as read and what it should be. Signs that no word has by itself.
SIGNS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("9", "q"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("†", "t"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("$", "s"), ("@", "a"), ("€", "e"), ("ı", "i"), ("ſ", "s"),
]
#: Letters read as other letters.
LETTERS = [
    ("c", "e"), ("e", "c"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("rn", "m"), ("ri", "n"), ("ii", "n"), ("ii", "u"), ("ni", "m"), ("in", "m"), ("nn", "m"),
    ("u", "n"), ("n", "u"), ("h", "b"), ("b", "h"), ("l", "i"), ("i", "l"), ("f", "s"), ("f", "t"), ("t", "f"), ("o", "c"), ("c", "o"), ("m", "rn"), ("d", "cl"), ("h", "li"),
    *((x, unicodedata.normalize("NFD", x)[0]) for x in "ãåāēìīòõōūýčšž"),
]
#: Letters read with an accent that the word hasn't.
ACCENTS = [(x, unicodedata.normalize("NFD", x)[0]) for x in "áàâäéèêëíîïóôöúùûüÿñç"]
CONFUSIONS = SIGNS + LETTERS + ACCENTS
SIGN_CHARS = frozenset(a for a, _ in SIGNS)
#: Confusions that one word may hold, and how often the right word must be there for each time that the misread one is.
MOST, RATIO, ENOUGH = 2, 8, 4
LEAD = re.compile(r"^[^\w†!|$@]*([!|$@](?=[^\W\d_])\S*)$")


@lru_cache(1 << 16)
def read(token: str) -> str:
    """:func:`bare`, but a sign that stands for a first letter stays: "!t" may be "it"."""
    m = LEAD.match(token)
    return m.group(1)[0] + bare(m.group(1)[1:]) if m else bare(token)


@lru_cache(1 << 16)
def lettered(word: str) -> bool:
    """The word has a letter."""
    return LETTER.search(word) is not None


def anagram(word: str) -> int:
    """A number that is the same for words of the same letters, and adds up over them; 64 bits with sign."""
    return _signed(sum(ord(x) ** 5 for x in word))


def _signed(n: int) -> int:
    return ((n + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


_SHIFT = [(a, sum(ord(x) ** 5 for x in b) - sum(ord(x) ** 5 for x in a)) for a, b in CONFUSIONS]


def targets(word: str) -> dict[int, int]:
    """The anagram numbers that up to MOST different confusions in the word lead to, with how many these are.

    One confusion may have struck up to three times.
    """
    base = sum(ord(x) ** 5 for x in word)
    here = [(i, k * d) for i, (a, d) in enumerate(_SHIFT) if a in word for k in range(1, min(word.count(a), 3) + 1)]
    out: dict[int, int] = {}
    for n in range(1, MOST + 1):
        for each in combinations(here, n):
            if len({i for i, _ in each}) == n:
                out.setdefault(_signed(base + sum(d for _, d in each)), n)
    return out


def replaced(word: str, right: str) -> tuple[int, int, int] | None:
    """(signs, letters, accents) replaced where confusions in place turn ``word`` into ``right``; None where they don't."""
    live: dict[tuple[int, int], tuple[int, int, int]] = {(0, 0): (0, 0, 0)}
    groups = [(a, b, g) for g, each in enumerate((SIGNS, LETTERS, ACCENTS)) for a, b in each]
    best = None
    while live:
        after: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (i, j), cost in live.items():
            if i == len(word) and j == len(right):
                best = min(best, cost, key=lambda c: (sum(c), c)) if best else cost
                continue
            steps = [(i + 1, j + 1, cost)] if i < len(word) and j < len(right) and word[i] == right[j] else []
            steps += [(i + len(a), j + len(b), tuple(c + (k == g) for k, c in enumerate(cost))) for a, b, g in groups if word.startswith(a, i) and right.startswith(b, j)]
            for p, q, c in steps:
                if sum(c) <= 4 and ((p, q) not in after or (sum(c), c) < (sum(after[p, q]), after[p, q])):
                    after[p, q] = c
        live = after
    return best


def lines_and_words(contexts: DataFrame) -> DataFrame:
    """context_id, kind, item, hyphened, n, clean (no printed page): headings, page numbers, words with their number, divided words."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch["context_id"].to_pylist(), batch["context"].to_pylist(), strict=True):
                page = Page(text)
                found: Counter = Counter()
                for i, kind in enumerate(page.kind):
                    if kind in ("header", "pageno"):
                        found[kind, page.lines[i].strip(), None] += 1
                for run in page.tokens():
                    for left, sign, right in run:
                        word = read(left + right)
                        if lettered(word):
                            found["hyphen" if sign else "word", word, read(left + "-" + right) if sign else None] += 1
                out += [(key, *k, n, not page.wrapped) for k, n in found.items()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["context_id", "kind", "item", "hyphened", "n", "clean"])

    rows = one_row_each(contexts.select(F.col("context_id").cast("bigint").alias("context_id"), "context"), "context_id").where("context IS NOT NULL")
    return rows.mapInArrow(run, "context_id bigint, kind string, item string, hyphened string, n bigint, clean boolean")


def corrections(found: DataFrame) -> DataFrame:
    """word, right_word: the best reading of each misread word of the corpus.

    A word of which a tenth or more stands in texts that aren't printed pages is a right one. A word is rare beside another if the other is there at least RATIO times as often (with signs that words
    don't have: at least as often). Rare words meet these where the difference of their anagram numbers is
    that of a few confusions; what the confusions don't give in place is left out, and the rest is ranked by
    the number of confusions, then by count.
    """
    whole = found.where("kind = 'word'").select(F.col("item").alias("word"), "n", F.when(F.col("clean"), F.col("n")).otherwise(0).alias("clean"))
    divided = found.where("kind = 'hyphen'").select(F.explode(F.array("item", "hyphened")).alias("word"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("clean"))
    counts, _ = written(whole.unionByName(divided).groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")))

    def numbers(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array([anagram(w) for w in batch["word"].to_pylist()], pa.int64())], ["right_word", "right_n", "number"])

    def reach(batches):
        for batch in batches:
            out = [(w, n, t) for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True) for t in targets(w)]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["word", "n", "number"])

    def judge(batches):
        for batch in batches:
            rows = []
            for w, n, r, m in zip(*(batch[c].to_pylist() for c in ("word", "n", "right_word", "right_n")), strict=True):
                cost = replaced(w, r)
                if cost and sum(cost) and (not cost[1] and not cost[2] or m >= RATIO * n):
                    rows.append((w, r, m, sum(cost) + cost[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "right_word", "right_n", "cost"])

    strange = "[" + "".join(re.escape(x) for x in sorted(SIGN_CHARS)) + "]"
    frequent = counts.where((F.col("n") >= 1) & ~F.col("word").rlike(strange)).select("word", "n").mapInArrow(numbers, "right_word string, right_n bigint, number bigint")
    suspect = counts.where((F.length("word").between(2, 40)) & ((F.col("clean") == 0) | (F.col("clean") * 10 < F.col("n"))))
    rare = suspect.select("word", "n").repartition(task_count(found.sparkSession)).mapInArrow(reach, "word string, n bigint, number bigint")
    met = rare.join(frequent, "number").where((F.col("right_n") >= F.col("n")) & (F.col("word").rlike(strange) | (F.col("right_n") >= F.greatest(F.col("n") * RATIO, F.lit(ENOUGH)))))
    judged = met.select("word", "n", "right_word", "right_n").distinct().mapInArrow(judge, "word string, right_word string, right_n bigint, cost int")
    rank = F.expr("row_number() OVER (PARTITION BY word ORDER BY cost, right_n DESC, right_word)")
    best, _ = written(judged.withColumn("r", rank).where("r = 1").select("word", "right_word"))
    # One sign amid at least four letters is misread even where the corpus has the right word nowhere else.
    first = dict(reversed(SIGNS))
    letters, signs = F.regexp_replace("word", r"[^\p{L}]", ""), F.regexp_replace("word", strange.replace("[", "[^", 1), "")
    alone = suspect.where((F.length(letters) >= 4) & (F.length(signs) == 1)).join(best, "word", "left_anti")
    return best.unionByName(alone.select("word", F.translate("word", "".join(first), "".join(first.values())).alias("right_word")))


def _evidence(found: DataFrame) -> DataFrame:
    """context_id, joined, as_read: each divided word as it reads, with its hyphen only if the corpus has it so more often."""
    counts = found.where("kind = 'word'").groupBy("item").agg(F.sum("n").alias("n"))
    cut = found.where("kind = 'hyphen'").select("context_id", F.col("item").alias("joined"), "hyphened")
    for column in ("joined", "hyphened"):
        cut = cut.join(counts.select(F.col("item").alias(column), F.col("n").alias(f"{column}_n")), column, "left")
    more = F.coalesce("hyphened_n", F.lit(0)) > F.coalesce("joined_n", F.lit(0))
    return cut.select("context_id", "joined", F.when(more, F.col("hyphened")).otherwise(F.col("joined")).alias("as_read"))


def _solved(contexts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines and words, the misread words of each context, and its divided words as they should read."""
    found, _ = written(lines_and_words(contexts))
    fixed, _ = written(corrections(found))
    divided = _evidence(found)
    both = found.where("kind = 'word'").select("context_id", F.col("item").alias("word")).unionByName(divided.select("context_id", F.col("as_read").alias("word")))
    misread, _ = written(both.join(fixed, "word").select("context_id", "word", "right_word").distinct())
    whole = divided.join(fixed.withColumnRenamed("word", "as_read"), "as_read", "left").select("context_id", "joined", "right_word", "as_read")
    return found, misread, whole.select("context_id", "joined", F.coalesce("right_word", "as_read").alias("whole"))


def find(contexts: DataFrame) -> DataFrame:
    """context_id, noise, item: headings, page numbers, divided words and misread words of every context.

    Null contexts and rows without an id give nothing; repeats of a row count once.
    """
    found, misread, whole = _solved(contexts)
    lines = found.where("kind IN ('header', 'pageno')").select("context_id", F.col("kind").alias("noise"), "item")
    hyphens = whole.select("context_id", F.lit("hyphen").alias("noise"), F.col("whole").alias("item"))
    ocr = misread.select("context_id", F.lit("ocr").alias("noise"), F.col("right_word").alias("item"))
    return lines.unionByName(hyphens).unionByName(ocr).distinct()


def _like(right: str, token: str) -> str:
    """The right word with the capitals of the token."""
    letters = [x for x in token if x.isalpha()]
    if len(letters) > 1 and all(x.isupper() for x in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if letters and token.strip("\"“„«([¿¡'‘")[:1].isupper() else right


def _put(token: str, word: str, right: str) -> str:
    at = token.lower().replace("’", "'").find(word)
    return token if at < 0 else token[:at] + _like(right, token[at : at + len(word)]) + token[at + len(word) :]


def repair(text: str, misread: dict[str, str], whole: dict[str, str]) -> str:
    """The text as continuous paragraphs, a blank line between them; a text that isn't a printed page keeps its lines."""
    page = Page(text)
    fix = lambda t: _put(t, w, misread[w]) if (w := read(t)) in misread else t
    if not page.wrapped:
        return TOKEN.sub(lambda m: fix(m.group()), text)
    out = []
    for run in page.tokens():
        line = []
        for left, sign, right in run:
            token = left + right
            line.append(_put(token, w, whole[w]) if sign and (w := read(token)) in whole else fix(token))
        out.append(" ".join(line))
    return "\n\n".join(x for x in out if x)


def repaired(contexts: DataFrame) -> DataFrame:
    """context_id, context: every context as continuous readable paragraphs; null stays null."""
    _, misread, whole = _solved(contexts)
    pairs = misread.select("context_id", F.lit(0).alias("k"), F.col("word").alias("a"), F.col("right_word").alias("b")).unionByName(whole.select("context_id", F.lit(1).alias("k"), F.col("joined").alias("a"), F.col("whole").alias("b")))
    known = pairs.groupBy("context_id").agg(F.collect_list(F.struct("k", "a", "b")).alias("known"))
    rows = one_row_each(contexts.select(F.col("context_id").cast("bigint").alias("context_id"), "context"), "context_id").join(known, "context_id", "left")

    def run(batches):
        for batch in batches:
            texts = []
            for text, each in zip(batch["context"].to_pylist(), batch["known"].to_pylist(), strict=True):
                by: tuple[dict, dict] = ({}, {})
                for x in each or ():
                    by[x["k"]][x["a"]] = x["b"]
                texts.append(None if text is None else repair(text, *by))
            yield pa.RecordBatch.from_arrays([batch["context_id"], pa.array(texts, pa.string())], ["context_id", "context"])

    return rows.mapInArrow(run, "context_id bigint, context string")
