"""Generation of graded rows from texts by a language model: typed prompts, critics, the rubric loop, assembly (survey L1 to L12, N1, N2, O1, P4, P5)."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType

from gradeloom.functions import text as T
from gradeloom.storage import written


@dataclass(frozen=True)
class Signature:
    """A typed prompt: what to do, the names of the inputs, and the outputs with their SQL types."""

    name: str
    task: str
    inputs: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> str:
        return "struct<" + ",".join(f"{n}:{t}" for n, t in self.outputs) + ">"


_LIST, _FLAGS = "array<string>", "array<boolean>"
_GRADES = {"correct": "full", "semicorrect": "partial", "incorrect": "no"}
SIGNATURES = {
    s.name: s
    for s in (
        Signature("clean", "Remove what is not running text, such as markup and page furniture, and change nothing else.", ("text",), (("cleaned_text", "string"),)),
        Signature("questions", "Write one to five open questions that the context alone answers.", ("context",), (("questions", _LIST),)),
        Signature("question_critic", "Say of each question whether it is clear, open and answered by the context.", ("context", "questions"), (("critiques", _FLAGS),)),
        Signature("rubric", "Write what an answer must have for full, for partial and for no credit; heed the former version and its critique, if given.", ("context", "question", "full_credit", "partial_credit", "no_credit", "critique"), (("full_credit", "string"), ("partial_credit", "string"), ("no_credit", "string"))),
        Signature("rubric_critic", "Say whether the three criteria exclude each other and can be judged from the context; if not, say why.", ("context", "question", "full_credit", "partial_credit", "no_credit"), (("follows_criteria", "boolean"), ("critique", "string"))),
        *(Signature(f"{g}_answers", f"Write five different answers that deserve {c} credit by the criteria.", ("context", "question", "criteria"), (("answers", _LIST),)) for g, c in _GRADES.items()),
        *(Signature(f"{g}_critic", f"Say of each answer whether it deserves {c} credit by the criteria.", ("context", "question", "criteria", "answers"), (("critiques", _FLAGS),)) for g, c in _GRADES.items()),
    )
}

#: A client answers a signature: (signature, inputs by name) -> outputs by name. A factory makes one in each worker.
Client = Callable[[Signature, dict], dict]


def chat_client(url: str, model: str, api_key: str = "", max_tokens: int = 16_000, timeout: float = 600.0) -> Client:
    """A client for a chat endpoint of the usual completions form; it asks for a JSON object with the outputs.

    What is no such object raises; missing outputs are null.
    """

    def ask(signature: Signature, inputs: dict) -> dict:
        wanted = ", ".join(f"{n} ({t})" for n, t in signature.outputs)
        body = {"model": model, "max_tokens": max_tokens, "messages": [{"role": "system", "content": f"{signature.task} Answer with a JSON object with the keys: {wanted}."}, {"role": "user", "content": json.dumps(inputs, ensure_ascii=False)}]}
        request = urllib.request.Request(url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            text = json.load(answer)["choices"][0]["message"]["content"]
        return json.loads(text[text.index("{") : text.rindex("}") + 1])

    return ask


def stub_client(fail_every: int = 7) -> Client:
    """A deterministic stand-in for tests: outputs depend on the inputs alone; critics reject about one in ``fail_every``."""

    def number(*parts) -> int:
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    def ask(signature: Signature, inputs: dict) -> dict:
        subject = next(iter(inputs.values())) or ""
        words = str(subject).split()
        pick = lambda i: words[number(signature.name, subject, i) % len(words)].strip('.,;:"') if words else "it"
        out = {}
        for name, kind in signature.outputs:
            if name == "cleaned_text":
                out[name] = " ".join(words)
            elif kind == _LIST:
                n = 1 + number(signature.name, subject) % 5 if signature.name == "questions" else 5
                out[name] = [f"{'What about' if signature.name == 'questions' else signature.name.split('_')[0]} {pick(i)}?" for i in range(n)]
            elif kind == _FLAGS:
                given = inputs.get("questions") or inputs.get("answers") or []
                out[name] = [number(signature.name, g, i) % fail_every != 0 for i, g in enumerate(given)]
            elif kind == "boolean":
                out[name] = number(*inputs.values()) % fail_every != 0
            elif name == "critique":
                out[name] = "too close to each other"
            else:
                out[name] = f"{name} {pick(name)} {number(*map(str, inputs.values())) % 97}"
        return out

    return ask


def llm_map(df: DataFrame, signature: str | Signature, client: Callable[[], Client], out: str, **inputs: str) -> DataFrame:
    """``df`` with a struct column ``out``: the client's outputs for each row. ``inputs`` map the signature's inputs to columns; others are null.

    ``client`` is a factory called once in each task. Spark may run a task twice, so write the result before it
    is read again, as :func:`stage` does. A failing call fails its task; wrap the client to retry.
    """
    signature = SIGNATURES[signature] if isinstance(signature, str) else signature
    if unknown := set(inputs) - set(signature.inputs):
        raise ValueError(f"{signature.name} has no input {sorted(unknown)}")
    given = df.withColumn("__in", F.struct(*((F.col(inputs[n]) if n in inputs else F.lit(None).cast("string")).alias(n) for n in signature.inputs)))
    schema = given.drop("__in").schema.add(out, DataType.fromDDL(signature.schema))
    kind = _arrow(signature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            ask = ask or client()
            at = batch.schema.get_field_index("__in")
            got = [ask(signature, x) for x in batch.column(at).to_pylist()]
            kept = [i for i in range(batch.num_columns) if i != at]
            made = pa.array([{n: g.get(n) for n, _ in signature.outputs} for g in got], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], [*(batch.schema.names[i] for i in kept), out])

    return given.mapInArrow(run, schema)


def _arrow(signature: Signature) -> pa.DataType:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), _LIST: pa.list_(pa.string()), _FLAGS: pa.list_(pa.bool_())}
    return pa.struct([(n, kinds[t]) for n, t in signature.outputs])


def stage(df: DataFrame) -> DataFrame:
    """A stage's rows, written and read again: model calls are made once, whatever is done with their results."""
    return written(df)[0]


def kept(candidates: Column, critiques: Column) -> Column:
    """The candidates that the critic accepts; the shorter of both lists decides, a null verdict rejects, null lists give none."""
    n = F.least(F.size(candidates), F.size(critiques))
    return F.coalesce(F.filter(candidates, lambda x, i: (i < n) & F.coalesce(F.get(critiques, i), F.lit(False))), F.array().cast("array<string>"))


def rubrics(df: DataFrame, client: Callable[[], Client], attempts: int = 10, context: str = "context", question: str = "question") -> DataFrame:
    """``df`` with rubrics STRUCT<FC, PC, NC> (null where no version passed) and attempt, the number of rounds.

    Each row goes through at most ``attempts`` rounds of writing and criticism, the last version and its critique
    going into the next. The loop is a row's own, within its task.
    """
    schema = df.select("*").schema.add("rubrics", DataType.fromDDL("struct<FC:string,PC:string,NC:string>")).add("attempt", IntegerType())
    write, judge = SIGNATURES["rubric"], SIGNATURES["rubric_critic"]

    def loop(ask: Client, c, q) -> tuple[dict | None, int]:
        made: dict = {"full_credit": None, "partial_credit": None, "no_credit": None}
        critique = None
        for n in range(1, attempts + 1):
            made = ask(write, {"context": c, "question": q, **made, "critique": critique})
            made = {k: made.get(k) for k, _ in write.outputs}
            verdict = ask(judge, {"context": c, "question": q, **made})
            if verdict.get("follows_criteria"):
                return {"FC": made["full_credit"], "PC": made["partial_credit"], "NC": made["no_credit"]}, n
            critique = verdict.get("critique")
        return None, attempts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            ask = ask or client()
            got = [loop(ask, c, q) for c, q in zip(batch[context].to_pylist(), batch[question].to_pylist(), strict=True)]
            kind = pa.struct([(k, pa.string()) for k in ("FC", "PC", "NC")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.int32())], [*batch.schema.names, "rubrics", "attempt"])

    return df.mapInArrow(run, schema)


def assemble(branches: dict[int, DataFrame], keys: list[str], lang: str = "en") -> DataFrame:
    """keys..., label, lang, fileid, input STRUCT<context, question, rubrics, answer>, pos: a row for each answer of each branch (label -> answered rows).

    Rows without answers give none.
    """
    out = None
    for label, df in branches.items():
        each = df.select(*keys, "fileid", "context", "question", "rubrics", F.posexplode("answers").alias("pos", "answer"))
        rows = each.select(*keys, F.lit(label).alias("label"), F.lit(lang).alias("lang"), "fileid", F.struct("context", "question", "rubrics", "answer").alias("input"), "pos")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no branches")
    return out


def generate(texts: DataFrame, client: Callable[[], Client], low: int = 150, high: int = 800, attempts: int = 10) -> DataFrame:
    """Graded rows from texts (fileid, text): chunks, cleaning, questions and critic, rubrics, answers of three grades and their critics.

    Each stage with model calls is written before the next reads it. Empty texts give no rows.
    """
    parts = texts.where("text IS NOT NULL").select("fileid", F.posexplode(T.chunks(T.sentences(F.col("text")), F.coalesce("fileid", F.lit("")), low, high)).alias("chunk_idx", "context"))
    cleaned = stage(llm_map(parts, "clean", client, "c", text="context").select("fileid", "chunk_idx", F.col("c.cleaned_text").alias("context")))
    asked = stage(llm_map(cleaned, "questions", client, "q", context="context").select("*", F.col("q.questions").alias("generated_questions")).drop("q"))
    judged = stage(llm_map(asked, "question_critic", client, "k", context="context", questions="generated_questions").withColumn("questions", kept(F.col("generated_questions"), F.col("k.critiques"))).drop("k"))
    flat = judged.select("fileid", "chunk_idx", "context", F.posexplode("questions").alias("question_idx", "question"))
    graded = stage(rubrics(flat, client, attempts)).where("rubrics IS NOT NULL").drop("attempt")
    branches = {}
    for label, (grade, part) in {2: ("correct", "FC"), 1: ("semicorrect", "PC"), 0: ("incorrect", "NC")}.items():
        own = graded.withColumn("criteria", F.col(f"rubrics.{part}"))
        made = stage(llm_map(own, f"{grade}_answers", client, "a", context="context", question="question", criteria="criteria").withColumn("generated_answers", F.col("a.answers")).drop("a"))
        held = stage(llm_map(made, f"{grade}_critic", client, "k", context="context", question="question", criteria="criteria", answers="generated_answers"))
        branches[label] = held.withColumn("answers", kept(F.col("generated_answers"), F.col("k.critiques")))
    return assemble(branches, ["chunk_idx", "question_idx"])
