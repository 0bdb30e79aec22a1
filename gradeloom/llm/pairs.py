"""Problem 4: defective entries among the responses to a prompt, one kind of defect for each.

A response is held against its prompt and itself: stand-ins for nothing, phrases of refusal in a word
automaton, the share of it that a suffix automaton of the prompt gives back, votes of function words for
its language, and a stack of open delimiters with the way it ends.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that stand for nothing, in normalised form.
STAND_INS = {
    "", "n a", "na", "none", "null", "nil", "nan", "no answer", "no response", "not available", "not applicable", "empty", "blank", "undefined",
    "keine antwort", "keine angabe", "k a", "sans réponse", "pas de réponse", "aucune réponse", "sin respuesta", "ninguna respuesta",
}

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an of and to in is was were are be been that this it its he she they them his her their for on with as by at from not but or which who what when where why how had has have would could should will can only most because before after although than then there these those into out about no yes some any all both neither nor so if while also very more did does do whether".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war waren wird werden hat haben hatte im in an am auf aus bei mit nach seit von vom zu zum zur für über unter vor durch ohne um dass weil wenn als wie so auch nur noch sehr es er sie wir ihr ich sich obwohl trotz warum was wer welche welcher wo sagt alles kein keine nichts".split(),
    "fr": "le la les un une des du de et ou mais ne pas est sont était étaient a ont avait au aux en dans sur sous avec sans pour par que qui quand où comme si ce cette ces son sa ses leur leurs il elle ils elles on nous vous je se plus très tout tous toute pourquoi dit après avant malgré aucune à parce est-ce quoi y".split(),
    "es": "el la los las un una unos unas y e o pero no es son era eran ha han había al del de en con sin por para que quien cuando donde como si este esta estos estas su sus se lo le les muy más todo todos toda porque qué cuál tras desde hasta a pesar dice ya también ni hay aquí".split(),
}

#: Word classes of a refusal; a speaker, what keeps it from answering, and a verb of answering make one, in each language.
CLASSES = {
    "I": "i we",
    "CANNOT": "cannot can't couldn't won't wouldn't shan't mustn't mayn't",
    "MODAL": "can could will would shall may must",
    "AM": "am are be was i'm we're",
    "UNABLE": "unable unwilling forbidden prohibited barred prevented",
    "ABLE": "able allowed permitted authorised authorized supposed willing ready going prepared free programmed designed meant",
    "BOT": "assistant model system bot chatbot author machine program",
    "DECLINE": "decline refuse abstain refrain pass declined refused abstained refrained declines refuses",
    "MUST": "must should shall will i'll we'll have need has had",
    "RATHER": "rather prefer i'd we'd",
    "SPEAK": "answer respond reply help provide comment discuss grade assist offer give share say fulfil fulfill complete evaluate tell talk speak explain address handle process judge advise engage continue elaborate",
    "ANSWER": "answer reply response comment statement help assistance information",
    "GIVEN": "given provided offered made possible available supplied",
    "ALLOW": "allow permit let enable",
    "RULES": "instructions guidelines rules policy policies guideline instruction principles settings programming restrictions",
    "FORBID": "forbid prohibit prevent exclude bar stop",
    "OUTSIDE": "outside beyond against",
    "LEAVE": "leave skip pass avoid drop",
    "ASK": "ask consult contact see",
    "EXPERT": "teacher tutor instructor expert professional specialist doctor lawyer human",
    "REQUEST": "request question topic subject task matter",
    "MY": "my our your",
    "NOT": "not never",
    "KANN": "kann darf möchte will werde könnte dürfte können dürfen möchten",
    "NICHT": "nicht nichts leider keine keinen kein",
    "MUSS": "muss müssen musste sollte",
    "ABLEHNEN": "ablehnen verweigern zurückweisen passen absehen verzichten",
    "SAGEN": "beantworten antworten helfen geben sagen kommentieren weiterhelfen bewerten äußern besprechen eingehen bearbeiten mitteilen liefern erteilen",
    "PEUX": "peux puis pourrai pourrais souhaite veux saurais vais peut",
    "DOIS": "dois devons préfère refuse décline souhaite regrette",
    "REFUSER": "refuser décliner m'abstenir éviter renoncer",
    "REPONDRE": "répondre aider donner fournir commenter évaluer dire traiter discuter",
    "PUEDO": "puedo podemos podré podría quiero deseo debo",
    "NEGAR": "declinar rechazar negarme abstenerme rehusar evitar negarnos",
    "DEBO": "debo tengo debemos tenemos prefiero",
    "RESPONDER": "responder contestar ayudar ayudarte ayudarle dar comentar ofrecer proporcionar evaluar decir contestarte responderle tratar",
}
#: Shapes of a refusal, in words and classes; * stands for up to three words.
SHAPES = [
    "I CANNOT * SPEAK", "I MODAL NOT * SPEAK", "AM UNABLE * SPEAK", "AM NOT ABLE * SPEAK", "I CANNOT be ABLE", "I MODAL NOT be ABLE", "I'm unable", "I'm NOT ABLE",
    "I MUST DECLINE", "I MUST to DECLINE", "I DECLINE", "MUST respectfully DECLINE", "I RATHER NOT", "I would RATHER NOT", "I RATHER to LEAVE", "RATHER to LEAVE", "I'd RATHER NOT", "I don't SPEAK", "I do NOT SPEAK", "I won't be ABLE",
    "possible for me", "impossible for me", "OUTSIDE what I MODAL", "OUTSIDE what I'm ABLE", "OUTSIDE MY RULES", "NOT ALLOW me", "don't ALLOW me", "doesn't ALLOW me", "RULES FORBID", "RULES do NOT ALLOW", "RULES don't ALLOW", "MY RULES FORBID",
    "I have no access", "was NOT shared with me", "has NOT been shared with me", "no ANSWER MODAL be GIVEN", "no ANSWER will be GIVEN", "no ANSWER is GIVEN", "ANSWER cannot be GIVEN", "BOT DECLINE", "BOT CANNOT", "BOT does NOT SPEAK", "BOT did NOT SPEAK", "BOT has DECLINE",
    "let us SPEAK about something", "let's SPEAK about something", "let us SPEAK about another", "let's SPEAK about another", "let us change the REQUEST", "let's change the REQUEST", "please ASK MY EXPERT", "please ASK a EXPERT", "please ASK an EXPERT", "REQUEST * OUTSIDE MY", "REQUEST falls under",
    "ich KANN * NICHT * SAGEN", "KANN ich * NICHT * SAGEN", "ich KANN NICHT", "KANN ich NICHT", "KANN ich leider", "ich KANN leider", "MUSS ich * ABLEHNEN", "ich MUSS * ABLEHNEN", "nicht in der lage", "ist es mir NICHT", "es ist mir NICHT", "mir nicht möglich", "mir leider nicht möglich", "mir nicht erlaubt", "mir nicht gestattet", "lehne ich", "ich lehne",
    "je ne PEUX * REPONDRE", "je ne PEUX pas", "je ne PEUX malheureusement pas", "je ne suis pas en mesure", "je ne suis pas autorisé", "je ne saurais", "m'est impossible", "impossible pour moi", "DOIS REFUSER", "je refuse de", "je DOIS ne pas", "je préfère m'abstenir", "m'est pas possible", "m'est pas permis",
    "no PUEDO * RESPONDER", "no me es posible", "no nos es posible", "me resulta imposible", "me es imposible", "DEBO NEGAR", "DEBO que NEGAR", "no estoy en condiciones", "no soy capaz de", "prefiero no", "no se me permite", "no me está permitido", "no estoy autorizado",
]

WORD = re.compile(r"\w+(?:['’\-]\w+)*")
BLANKS = re.compile(r"[\s​-‏ - ⁠﻿­ㅤ]+")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->")
FRAME = re.compile(r"^[\s\W]+|[\s\W]+$")
OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“"}
CLOSERS = set(OPEN.values())


def words(text: str) -> list[str]:
    return [w.replace("’", "'") for w in WORD.findall(text.lower())]


class Phrases:
    """An automaton over words: a trie of shapes whose steps are words, word classes (in capitals) and short gaps (*)."""

    def __init__(self, shapes: list[str], classes: dict[str, str]):
        self.root: dict = {}
        for shape in shapes:
            node = self.root
            for w in shape.split():
                node = node.setdefault(w if w in classes else w.lower(), {})
            node["END"] = True
        self.of: dict[str, list[str]] = {}
        for name, listed in classes.items():
            for w in listed.split():
                self.of.setdefault(w, []).append(name)

    def find(self, tokens: list[str]) -> int:
        """Place of the first shape, -1 if there is none."""
        live: list[tuple[dict, int, int]] = []
        for i, w in enumerate(tokens):
            live.append((self.root, i, 0))
            steps, after = (w, *self.of.get(w, ())), []
            for node, start, gap in live:
                if gap:
                    after.append((node, start, gap - 1))
                for one, room in ((node, 0), (node.get("*"), 3)):
                    if one is None:
                        continue
                    if room:
                        after.append((one, start, room - 1))
                    after += [(one[x], start, 0) for x in steps if x in one]
            live = []
            for state in after:
                if "END" in state[0]:
                    return state[1]
                live.append(state)
        return -1


class SuffixAutomaton:
    """All runs of words of a prompt, in space linear in its length."""

    def __init__(self, tokens: list[str]):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for w in tokens:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def covered(self, tokens: list[str], least: int) -> list[bool]:
        """For each word whether it lies in a run of at least ``least`` words that the prompt has too."""
        runs, state, run = [], 0, 0
        for w in tokens:
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state, run = self.next[state][w], run + 1
            else:
                run = 0
            runs.append(run)
        out, left = [False] * len(tokens), 0
        for i in range(len(tokens) - 1, -1, -1):  # each word is marked once, from the end of the run it lies in
            left = max(left - 1, runs[i] if runs[i] >= least else 0)
            out[i] = left > 0
        return out


_REFUSE = Phrases(SHAPES, CLASSES)
_VOTES: dict[str, dict[str, float]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _VOTES.setdefault(_w, {})[_lang] = 1.0
for _each in _VOTES.values():
    for _lang in _each:
        _each[_lang] = 1.0 / len(_each)


def votes(tokens: list[str]) -> dict[str, float]:
    """Votes of the function words for each language; a word of several languages is shared between them."""
    out = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for t in tokens:
        if t in _VOTES:
            for lang, v in _VOTES[t].items():
                out[lang] += v
        if "'" in t:
            for w in t.split("'"):
                for lang, v in _VOTES.get(w, {}).items():
                    out[lang] += v
    return out


def language(tokens: list[str], text: str = "") -> str | None:
    """The language with the most votes; none without a clear one."""
    got = votes(tokens)
    if "¿" in text or "¡" in text:
        got["es"] += 1
    first, second = sorted(got.values(), reverse=True)[:2]
    return max(got, key=got.get) if first > second else None


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    bare = FRAME.sub("", BLANKS.sub(" ", TAG.sub(" ", text)))
    return re.sub(r"[\W_]+", " ", bare).strip().lower() in STAND_INS


def is_refusal(text: str, tokens: list[str]) -> bool:
    """The response declines in its own voice: what it quotes, or hedges before it answers, is no refusal."""
    at = _REFUSE.find(tokens)
    if at < 0:
        return False
    own = re.sub(r"[\"“„«][^\"“”„«»]*[\"”“»]", " ", text)
    return own == text or _REFUSE.find(words(own)) >= 0


def _in_order(tokens: list[str], prompt: list[str]) -> int:
    """How often the prompt is gone through when the tokens are found in it in order; 0 if one isn't there."""
    rounds, at = 1, 0
    for w in tokens:
        while at < len(prompt) and prompt[at] != w:
            at += 1
        if at == len(prompt):
            if w not in prompt:
                return 0
            rounds, at = rounds + 1, prompt.index(w)
        at += 1
    return rounds


def is_copy(text: str, tokens: list[str], prompt: list[str], machine, share: float = 0.75, lead_in: int = 5) -> bool:
    """The response gives the prompt back, perhaps behind a short lead-in, several times or with a word left out, and adds nothing after it.

    The suffix automaton tells which of its words lie in runs of the prompt; these must be all behind the
    lead-in, follow the prompt's order and make up at least ``share`` of it.
    """
    if not prompt or len(tokens) < share * len(prompt) or tokens[-1] not in prompt:
        return False
    covered = machine().covered(tokens, 1)
    lead = len(covered) - covered[::-1].index(False) if False in covered else 0
    inside = set(prompt)
    for start in range(lead, lead_in + 1):
        rest = tokens[start:]
        if len(rest) < share * len(prompt):
            return False
        rounds = _in_order(rest, prompt)
        if not rounds or rounds > 1 and len(rest) < rounds * share * len(prompt) or rest[0] not in prompt[:2]:
            continue
        if sum(machine().covered(rest, min(2, len(prompt)))) < share * len(rest) or len(inside & set(rest)) < share * len(inside):
            continue
        return start == 0 or not re.search(r"[.!?;]\s*[\"')\]]?\s*$", text[: list(WORD.finditer(text))[start].start()])
    return False


def is_other_language(tokens: list[str], asked: str | None) -> bool:
    if asked is None:
        return False
    got = votes(tokens)
    best = max(got, key=got.get)
    return best != asked and got[best] >= 0.9 and got[best] > 2 * got[asked]


def open_delimiters(text: str) -> list[str]:
    """The stack of delimiters that are still open at the end; a straight quote closes one or opens one."""
    stack: list[str] = []
    for i, ch in enumerate(text):
        if stack and ch == stack[-1]:
            stack.pop()
        elif ch == '"':
            stack.append(ch)
        elif ch in OPEN:
            stack.append(OPEN[ch])
        elif ch in CLOSERS and ch in stack:
            while stack.pop() != ch:
                pass
        elif ch == "`" and text[i : i + 3] == "```" and text[i - 1 : i] != "`":
            if "```" in stack:
                stack.remove("```")
            else:
                stack.append("```")
    return stack


_ENDS = re.compile(r"[.!?。！？][\"'”’»)\]}]*$")
_ITEM = re.compile(r"(?:^|\n)\s*(?:\d+[.)]|[-*•])\s*$")
_ABBREVIATED = re.compile(r"(?:\.\.\.|…)[\"'”’»)\]}]*$")
_BARE = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+\S")


def is_truncated(text: str, tokens: list[str], fragment: int = 6) -> bool:
    """The response breaks off: a delimiter stays open, the last list item is bare, or it ends like no end.

    A short fragment without a full stop is whole if it starts like a fragment (small letter, number, or nothing
    but names) and does not end in a function word; so is a list whose items have none.
    """
    body = text.strip().strip("​﻿")
    if open_delimiters(body) or _ABBREVIATED.search(body) or _ITEM.search(body):
        return True
    if _ENDS.search(body):
        return False
    if not tokens or re.search(r"[,;:\-–—(/&+]$", body):
        return True
    if tokens[-1] in _VOTES:
        return True
    lines = [x for x in body.splitlines() if x.strip()]
    if len(lines) > 1 and all(_BARE.match(x) for x in lines):
        return False
    if len(lines) > 1 or re.search(r"[.!?][\"'”’)]*\s+\S", body):
        return True
    last = body[-1]
    if len(tokens) <= fragment and (body[0].islower() or body[0].isdigit() or _BARE.match(body)):
        return False
    if len(tokens) <= 3 and all(w[0].isupper() or w[0].isdigit() for w in body.split()):
        return False
    return last.isalnum() or unicodedata.category(last)[0] in "LNP"


def defect(text: str | None, tokens: list[str], prompt: list[str], asked: str | None, machine) -> str | None:
    """The kind of defect, the first that holds of empty, refusal, copy, language, truncated; None if there is none."""
    if is_empty(text):
        return "empty"
    if is_refusal(text, tokens):
        return "refusal"
    if is_copy(text, tokens, prompt, machine):
        return "copy"
    if is_other_language(tokens, asked):
        return "language"
    if is_truncated(text, tokens):
        return "truncated"
    return None


def find(pairs: DataFrame, fields=("generated_answers", "answers")) -> DataFrame:
    """pair_id, field_name, pos (from 0), defect: each defective entry.

    A null entry is empty; a null or empty array has no entries; with a null prompt neither copy nor language
    can be told. Rows without a pair_id give nothing, repeats of a row count once.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            ids, prompts = batch["pair_id"].to_pylist(), batch["question"].to_pylist()
            lists = [batch[f].to_pylist() for f in fields]
            for n, (key, question) in enumerate(zip(ids, prompts, strict=True)):
                prompt = words(question or "")
                asked = language(prompt, question or "")
                made: list[SuffixAutomaton] = []

                def machine(prompt=prompt, made=made):
                    if not made:
                        made.append(SuffixAutomaton(prompt))
                    return made[0]

                known: dict = {}
                for field, each in zip(fields, lists, strict=True):
                    for pos, text in enumerate(each[n] or ()):
                        if text not in known:
                            known[text] = defect(text, words(text or ""), prompt, asked, machine)
                        if known[text]:
                            out.append((key, field, pos, known[text]))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], ["pair_id", "field_name", "pos", "defect"])

    rows = pairs.where("pair_id IS NOT NULL").select(F.col("pair_id").cast("bigint").alias("pair_id"), "question", *fields)
    return rows.mapInArrow(run, "pair_id bigint, field_name string, pos int, defect string").distinct()


def defect_counts(found: DataFrame) -> DataFrame:
    """field_name, defect, n."""
    return found.groupBy("field_name", "defect").agg(F.count("*").alias("n"))
