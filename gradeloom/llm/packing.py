"""Problem 7: filling containers of fixed capacity by conflict-constrained best fit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.tokens import FOLDER, VOCABULARY, encode, one_row_each
from gradeloom.operators.ranking import running
from gradeloom.storage import task_count, written

CAPACITY = 2_048
#: Items packed together by one task; each shard leaves at most a few containers half empty.
SHARD = 20_000
#: Measured on 9,917 items of 20 sources that need 940 containers: 1 part takes 1,225 of them, 4 take 952, 8 take 942, none 940.
SOURCE_PARTS = 8


class Bins:
    """Open containers in order of their residual room; each carries bitmaps of its sources and duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.sources, self.clusters = capacity, [], [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # bit r: some container has residual r

    def _take(self, at: int, size: int, source: int, cluster: int) -> None:
        left = self.room[at] - size
        self.room[at] = left
        self.sources[at] |= source
        self.clusters[at] |= cluster
        if left:
            self.by_room[left].append(at)
            self.filled |= 1 << left

    def put(self, size: int, source: int, cluster: int) -> int:
        """The container of the item: the tightest compatible one, or a new one.

        The search starts at the least residual that holds the item and goes on to its successors. Two items
        conflict if their cluster bits meet, or if their source bits do (0: no conflict).
        """
        rest = self.filled >> size << size
        while rest:
            room = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            line = self.by_room[room]
            for i in range(len(line) - 1, -1, -1):
                at = line[i]
                if not (self.clusters[at] & cluster or self.sources[at] & source):
                    line[i] = line[-1]
                    line.pop()
                    if not line:
                        self.filled &= ~(1 << room)
                    self._take(at, size, source, cluster)
                    return at
        at = len(self.room)
        self.room.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self._take(at, size, source, cluster)
        return at


def _bits(groups: list, least: int) -> list[int]:
    """A bit for each item of a group, 0 for items without one or alone in theirs.

    A group with more items than the ``least`` containers can't be kept apart; it counts as several, as few as suffice.
    """
    count: dict = {}
    for g in groups:
        if g is not None:
            count[g] = count.get(g, 0) + 1
    number, seen, out = {}, {}, []
    for g in groups:
        if g is None or count[g] < 2:
            out.append(0)
            continue
        k = seen[g] = seen.get(g, -1) + 1
        out.append(1 << number.setdefault((g, k % -(-count[g] // least)), len(number)))
    return out


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, source_parts: int = SOURCE_PARTS) -> list[int]:
    """Container number of each item of at most ``capacity``, longest items first (equal sizes: in order).

    Items of one cluster go to different containers as far as the number of containers allows, see :func:`_bits`.
    So do items of one part of a source: a source counts as ``source_parts`` times as many parts as would be
    needed to keep it apart altogether (0: sources play no part).
    """
    least = max(1, -(-sum(sizes) // capacity))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    cluster = _bits([clusters[i] for i in order], least)
    source = _bits([sources[i] for i in order], max(1, least // source_parts)) if source_parts else [0] * len(order)
    bins, out = Bins(capacity), [0] * len(sizes)
    for i, s, c in zip(order, source, cluster, strict=True):
        out[i] = bins.put(sizes[i], s, c)
    return out


def assign(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, folder: str = FOLDER, vocabulary: str = VOCABULARY, source_parts: int = SOURCE_PARTS) -> DataFrame:
    """container_id, doc_id, part, first_token, n_tokens: where each text or part of a text goes.

    Only a text of more than ``capacity`` tokens is split, into full containers (numbered -1, -2, ... in order of doc_id, never packed) and one
    rest (part from 0 on). Null and empty texts have no tokens and need no place; repeats of a doc_id count once. Texts that
    are equal but for case and white space form a duplicate cluster and avoid each other's containers, and so do
    texts of one part of a source, see :func:`pack`. Containers are filled within shards of about ``shard`` items, dealt
    by a hash of the doc_id, so no task grows with the input; copies and sources are dealt like all others.
    """
    spark = documents.sparkSession
    rows = one_row_each(documents.select("doc_id", "text", "source"), "doc_id")
    sizes = encode(rows, "doc_id", "text", folder, vocabulary, count_only=True)
    marks = rows.where("text IS NOT NULL").select("doc_id", "source", F.xxhash64(F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("cluster"))
    items, _ = written(sizes.where("n_tokens > 0").join(marks, "doc_id").select("doc_id", "source", "cluster", "n_tokens"))
    whole = F.expr(f"CASE WHEN n_tokens > {capacity} THEN CAST(n_tokens DIV {capacity} AS INT) ELSE 0 END")
    long = running(items.where(F.col("n_tokens") > capacity).select("doc_id", whole.alias("parts")), [], [F.col("doc_id")], F.col("parts"))
    full = long.select("doc_id", "before", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    full = full.select((-1 - F.col("before") - F.col("part")).alias("container_id"), "doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.lit(capacity).alias("n_tokens"))
    rests = items.withColumn("part", whole).select("doc_id", "source", "cluster", "part", (F.col("part") * capacity).alias("first_token"), (F.col("n_tokens") - F.col("part") * capacity).alias("n_tokens")).where("n_tokens > 0")
    shards = max(1, round(items.count() / shard))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        number = table["shard"][0].as_py()
        got = pack(table["n_tokens"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), capacity, source_parts)
        return pa.table({"container_id": pa.array([(number << 32) + g for g in got], pa.int64()), **{c: table[c] for c in ("doc_id", "part", "first_token", "n_tokens")}})

    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(min(shards, task_count(spark, shards // 4)), "shard")
    return dealt.groupBy("shard").applyInArrow(fill, "container_id bigint, doc_id bigint, part int, first_token int, n_tokens int").unionByName(full)


def split_documents(assigned: DataFrame) -> DataFrame:
    """doc_id of each document that had to be split: one with a second part."""
    return assigned.where("part = 1").select("doc_id").distinct()


def fill_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, share of the room used, and the least number of containers that could do."""
    each = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).select("containers", "tokens", "fullest", F.when(F.col("containers") > 0, F.round(F.col("tokens") / (F.col("containers") * capacity), 6)).alias("used"), F.ceil(F.col("tokens") / capacity).alias("least_containers"))
