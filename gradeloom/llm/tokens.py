"""Problem 6: token ids of whole texts by a public byte-level BPE vocabulary.

Texts are cut into the vocabulary's own pre-tokens, so segments of whole pre-tokens can be encoded
anywhere and put side by side. A pre-token longer than a block is unsplit text: its blocks are encoded
on their own, then joined two by two in a tree. At each join a growing window of tokens on both sides
is encoded again until it begins with the left side's token and ends with the right side's. A token
sequence is the BPE encoding of its bytes exactly when each two neighbouring tokens are the encoding of
their joint bytes; agreement at both seams therefore makes the joined sequence exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.storage import task_count

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's published pre-token pattern; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters than this are cut into segments of about as many.
SEGMENT = 16_384
#: Pre-tokens of more bytes than this are cut into blocks of as many.
BLOCK = 2_048

_loaded: dict = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The vocabulary as an encoder, read once in each process."""
    key = (folder, vocabulary)
    if key not in _loaded:
        import tiktoken

        lines = Path(folder, vocabulary).read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _loaded[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of the joint bytes of two encoded neighbours within one pre-token."""
    if not left or not right:
        return left + right
    width = 4
    while True:
        a, b = min(width, len(left)), min(width, len(right))
        window = left[len(left) - a :] + right[:b]
        middle = enc._encode_single_piece(b"".join(enc.decode_single_token_bytes(t) for t in window))
        if (a == len(left) or middle[0] == window[0]) and (b == len(right) or middle[-1] == window[-1]):
            return left[: len(left) - a] + middle + right[b:]
        width *= 2


def join_tree(enc, parts: list[list[int]]) -> list[int]:
    """Joins the encoded blocks of one pre-token two by two."""
    while len(parts) > 1:
        parts = [join(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def segments(text: str, segment: int = SEGMENT, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(piece, bytes): segments of whole pre-tokens (piece -1), and the blocks of each long pre-token under its number.

    White space at the end of a segment would be split otherwise than before a word, so such pre-tokens go out alone.
    """
    import regex

    start = solid = end = 0  # of the segment; the end of its last pre-token that isn't white space; of all so far
    blank: list[tuple[int, bytes]] = []
    for n, m in enumerate(regex.finditer(PATTERN, text)):
        long = m.end() - m.start() > block // 4 and len(m.group().encode()) > block
        if (long or m.end() - start > segment) and end > start:
            if solid > start:
                yield -1, text[start:solid].encode()
            yield from blank
            start, blank = end, []
        if long:
            data = m.group().encode()
            for i in range(0, len(data), block):
                yield n, data[i : i + block]
            start = solid = m.end()
        elif m.group().isspace():
            blank.append((n, m.group().encode()))
        else:
            solid, blank = m.end(), []
        end = m.end()
    if solid > start:
        yield -1, text[start:solid].encode()
    yield from blank


def encode_long(enc, text: str, segment: int = SEGMENT, block: int = BLOCK) -> list[int]:
    """The encoding of one text by its segments and blocks, in one process."""
    return assemble(enc, [(p, enc.encode_ordinary(d.decode()) if p < 0 else enc._encode_single_piece(d)) for p, d in segments(text, segment, block)])


def assemble(enc, parts: list[tuple[int, list[int]]]) -> list[int]:
    """Puts encoded segments in order side by side and joins the blocks of each long pre-token."""
    out, i = [], 0
    while i < len(parts):
        j = i + 1
        while parts[i][0] >= 0 and j < len(parts) and parts[j][0] == parts[i][0]:
            j += 1
        out += parts[i][1] if parts[i][0] < 0 else join_tree(enc, [p[1] for p in parts[i:j]])
        i = j
    return out


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``, none for null: the smallest of the rows that share it, column by column.

    Texts are shuffled only where a key does repeat.
    """
    rows = rows.where(F.col(key).isNotNull())
    again = rows.groupBy(key).count().where("count > 1").select(key)
    if again.isEmpty():
        return rows
    others = [c for c in rows.columns if c != key]
    chosen = rows.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*others)).alias("m")).select(*(F.col(key) if c == key else F.col(f"m.{c}").alias(c) for c in rows.columns))
    return rows.join(again, key, "left_anti").unionByName(chosen)


def encode(rows: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY, count_only: bool = False, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(key, ids ARRAY<INT>) or, with ``count_only``, (key, n_tokens INT), without special tokens.

    Null and empty texts give an empty list (0). Repeated rows of a key count once, rows without a key
    not at all, and an empty table gives none. Strings that spell special tokens are ordinary text.
    """
    spark = rows.sparkSession
    rows = one_row_each(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    size = F.coalesce(F.length("text"), F.lit(0))
    result = "key bigint, n_tokens int" if count_only else "key bigint, ids array<int>"

    def give(keys, lists):
        second = pa.array([len(x) for x in lists], pa.int32()) if count_only else pa.array(lists, pa.list_(pa.int32()))
        return [keys.cast(pa.int64()) if isinstance(keys, (pa.Array, pa.ChunkedArray)) else pa.array(keys, pa.int64()), second]

    names = ["key", "n_tokens" if count_only else "ids"]

    def short(batches):
        enc = encoder(folder, vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(give(batch["key"], [enc.encode_ordinary(t) if t else [] for t in batch["text"].to_pylist()]), names)

    def cut(batches):
        for batch in batches:
            for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                parts = list(segments(t, segment, block))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["key", "seq", "piece", "data"])

    def each(batches):
        enc = encoder(folder, vocabulary)
        for batch in batches:
            ids = [enc.encode_ordinary(d.decode()) if p < 0 else enc._encode_single_piece(d) for p, d in zip(batch["piece"].to_pylist(), batch["data"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["seq"], batch["piece"], pa.array(ids, pa.list_(pa.int32()))], ["key", "seq", "piece", "ids"])

    def whole(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table["seq"].to_pylist(), table["piece"].to_pylist(), table["ids"].to_pylist(), strict=True), key=lambda x: x[0])
        return pa.table(give([table["key"][0].as_py()], [assemble(encoder(folder, vocabulary), [p[1:] for p in parts])]), names)

    cuts = rows.where(size > segment).mapInArrow(cut, "key bigint, seq int, piece int, data binary")
    encoded = cuts.repartition(task_count(spark), "key", "seq").mapInArrow(each, "key bigint, seq int, piece int, ids array<int>")
    out = rows.where(size <= segment).mapInArrow(short, result).unionByName(encoded.groupBy("key").applyInArrow(whole, result))
    return out.withColumnRenamed("key", key)
