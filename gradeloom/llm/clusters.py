"""Problem 2: groups of mutually similar vectors by leaves of a projection tree, exact links and minimum labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.neighbours import distances
from gradeloom.llm.space import fit_space, matrix, pack, read_metric, refine, share, spread_over, unpack, usable
from gradeloom.storage import drop_table, written

PAIRS_AT_ONCE = 1 << 20


def _place(shared):
    """(leaf, qa_id, x, copy_of, hot, label): each row in its own leaf.

    Of copies in a batch only the row of the smallest id stays; the others have neither leaf nor vector but
    ``copy_of``, its id. Rows of a vector that may be hot are marked instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            ids, hot = batch["qa_id"].to_numpy(), np.isin(batch["h"].to_numpy(), space.hot)
            x, label = matrix(batch["v"], len(space.metric.names)), batch["label"].to_numpy()
            packed = pack(x)
            first: dict[tuple[int, bytes], int] = {}
            keys = list(zip(label.tolist(), packed, strict=True))
            for key, i in zip(keys, ids.tolist(), strict=True):
                first[key] = min(i, first.get(key, i))
            lead = np.array([first[key] for key in keys], np.int64)
            copy = (lead != ids) & ~hot
            leaf = pa.array(space.home(label, space.project(x)), pa.int64(), mask=copy)
            yield pa.RecordBatch.from_arrays(
                [leaf, batch["qa_id"], pa.array(packed, pa.binary(), mask=copy), pa.array(lead, pa.int64(), mask=~copy), pa.array(hot), batch["label"]],
                ["leaf", "qa_id", "x", "copy_of", "hot", "label"],
            )

    return run


def _visits(shared, label_of: dict[int, int], radius: float):
    """(leaf, qa_id, x, own): each row in every leaf at most ``radius`` away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            home = batch["leaf"].to_numpy()
            z, label = space.project(unpack(batch["x"], len(space.metric.names))), np.array([label_of[h] for h in home.tolist()])
            for lab in np.unique(label).tolist():
                at = np.flatnonzero(label == lab)
                r, to = space.within(lab, z[at], np.full(len(at), radius))
                rows = pa.array(at[r])
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), batch["qa_id"].take(rows), batch["x"].take(rows), pa.array(to == home[at[r]])], ["leaf", "qa_id", "x", "own"])

    return run


class _Sets:
    """Disjoint sets over 0..n-1 whose name is their smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.of[a], self.of[b]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            return
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent.get(i, i) != i:
                parent[i] = parent.get(parent[i], parent[i])
                i = parent[i]
            return i

        for i, j in pairs.tolist():
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
        table = np.arange(len(self.of))
        for i in parent:
            table[i] = root(i)
        self.of = table[self.of]


def link_leaf(metric, x: np.ndarray, z: np.ndarray, home: np.ndarray, radius: float) -> np.ndarray:
    """For each row of a leaf the smallest row of its local component; links between two rows of other leaves are theirs to find.

    Rows of one fine cell (its diagonal is the radius) are linked by the cell alone. Cells are then joined
    where two of their rows are at most the radius apart, looked for in windows on a sorted projection.
    """
    n, d = x.shape
    sets = _Sets(n)
    scaled = x * metric.factors
    cell = np.floor(scaled * (np.sqrt(d) * (1 + 1e-9) / radius)).astype(np.int64)
    _, first, inverse = np.unique(np.ascontiguousarray(cell).view(f"V{8 * d}").ravel(), return_index=True, return_inverse=True)
    sets.join(np.arange(n), first[inverse])
    axis = int(np.argmax(np.quantile(z, 0.9, axis=0) - np.quantile(z, 0.1, axis=0)))
    order = np.argsort(z[:, axis], kind="stable")
    line = z[order, axis]
    mid = np.median(z, axis=0)
    zc = z[order] - mid
    norm = (zc**2).sum(axis=1)
    slack = 1e-9 * (1 + np.abs(line).max(initial=0.0))
    queries = np.flatnonzero(home[order])
    lo = np.searchsorted(line, line[queries] - radius - slack, "left")
    hi = np.searchsorted(line, line[queries] + radius + slack, "right")
    i = 0
    while i < len(queries):
        j, a, b = i + 1, lo[i], hi[i]
        while j < len(queries) and j - i < 256 and (hi[j] - a) * (j - i + 1) <= PAIRS_AT_ONCE:
            b, j = max(b, hi[j]), j + 1
        q = queries[i:j]
        gap = norm[q][:, None] + norm[a:b][None] - 2 * (zc[q] @ zc[a:b].T)
        close = gap <= radius * radius + 1e-7 + 1e-12 * norm[q][:, None]
        of = sets.of
        close &= of[order[q]][:, None] != of[order[a:b]][None]
        qi, bi = np.nonzero(close)
        if len(qi):
            qi, bi = order[q[qi]], order[a + bi]
            near = distances(metric, x[qi], x[bi]) <= radius
            sets.join(qi[near], bi[near])
        i = j
    return sets.of


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component, over edges (a, b).

    Minimum labels are passed along the edges and each label is then replaced by its own label, until
    nothing changes; each round is a table of its own, so lost executors cost no lineage.
    """
    spark = edges.sparkSession
    both, both_path = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), keep=False)
    labels, path = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"), keep=False)
    for _ in range(max_rounds):
        passed = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(passed, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        fresh, new_path = written(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"), keep=False)
        drop_table(spark, path)
        labels, path = fresh.select("node", "root"), new_path
        if fresh.where("root <> old").isEmpty():
            break
    else:
        raise RuntimeError("labels still change; raise max_rounds")
    drop_table(spark, both_path)
    return labels


def clusters(rows: DataFrame, metric, radius: float = 0.4, least: int = 3, leaf_rows: int = 4096, sample_rows: int = 100_000, max_leaves: int | None = None) -> DataFrame:
    """cluster_id, qa_id, label of each row in a group of at least ``least`` rows of one label.

    Two rows of a label belong together if they are at most ``radius`` apart or are linked by rows each at
    most that far from the next; cluster_id is the group's smallest qa_id. ``rows`` is (qa_id, label, v) as
    :func:`gradeloom.llm.space.usable` gives it; repeats count once and no rows give no rows. Of a hot vector one
    row is compared for all its copies, which then only take its group.
    """
    spark = rows.sparkSession
    space = fit_space(rows, metric, leaf_rows, sample_rows, max_leaves)
    shared = share(spark, space)
    d, tasks = len(metric.names), spread_over(spark, space)
    label_of = space.labels()
    found, _ = written(rows.withColumn("h", F.xxhash64("label", "v")).mapInArrow(_place(shared), "leaf bigint, qa_id bigint, x binary, copy_of bigint, hot boolean, label int"))
    placed = found.where("leaf IS NOT NULL AND NOT hot").select("leaf", "qa_id", "x")
    copies = found.where("copy_of IS NOT NULL").select("qa_id", F.col("copy_of").alias("of"), "label")
    if len(space.hot):
        alike = found.where("hot")
        leads, _ = written(alike.groupBy("leaf", "x").agg(F.min("qa_id").alias("of")))  # at most sample_rows / HOT_IN_SAMPLE vectors
        placed = placed.unionByName(leads.select("leaf", F.col("of").alias("qa_id"), "x"))
    below = refine(placed, space, shared, written)
    visits = placed.mapInArrow(_visits(shared, label_of, radius), "leaf bigint, qa_id bigint, x binary, own boolean").withColumn("r", F.lit(float(radius)))
    dealt = below.descend(visits, shared, "r", "own").select("leaf", "qa_id", "home", "x").repartition(tasks, "leaf")

    def link(table: pa.Table) -> pa.Table:
        space = shared.value
        leaf = table["leaf"][0].as_py()
        ids, at = np.unique(table["qa_id"].to_numpy(), return_index=True)
        home = table["home"].to_numpy()[at]
        x = unpack(table["x"].combine_chunks(), d)[at]
        comp = ids[link_leaf(space.metric, x, space.project(x), home, radius)]
        size = np.unique(comp, return_inverse=True, return_counts=True)
        keep = size[2][size[1]] >= 2
        return pa.table({"qa_id": pa.array(ids[keep], pa.int64()), "comp": pa.array(comp[keep], pa.int64()), "label": pa.array(np.full(int(keep.sum()), label_of[leaf >> 32]), pa.int32())})

    local, _ = written(dealt.groupBy("leaf").applyInArrow(link, "qa_id bigint, comp bigint, label int"))
    # Only rows that have links in several leaves tie the leaves' components together; at most one row for each leaf of a row. A copy ties to what it copies.
    tied = local.groupBy("qa_id").agg(F.min("comp").alias("a"), F.collect_set("comp").alias("all")).where("size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    roots = components(tied)
    linked = local.groupBy("qa_id").agg(F.min("comp").alias("comp"), F.min("label").alias("label")).join(roots, F.col("comp") == F.col("node"), "left").select("qa_id", "label", F.coalesce("root", "comp").alias("root"))
    root_of = linked.select(F.col("qa_id").alias("of"), "root")
    pointers = copies.unionByName(copies.select(F.col("of").alias("qa_id"), "of", "label")).distinct()
    members = linked.unionByName(pointers.join(root_of, "of", "left").select("qa_id", "label", F.coalesce("root", "of").alias("root")))
    if len(space.hot):
        known = leads.join(root_of, "of", "left").select("leaf", "x", F.coalesce("root", "of").alias("root"))
        members = members.unionByName(alike.join(F.broadcast(known), ["leaf", "x"]).select("qa_id", "label", "root"))
    # The root is the smallest id of its group. Only small groups are looked up, so a giant one is no key of the join's right side and its left side may be split.
    rows_of, _ = written(members.groupBy("qa_id").agg(F.min("root").alias("cluster_id"), F.min("label").alias("label")))
    small = rows_of.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") < least).select("cluster_id")
    return rows_of.join(small, "cluster_id", "left_anti").select("cluster_id", "qa_id", "label")


def describe(found: DataFrame, rows: DataFrame, metric, radius: float = 0.4, typical: int = 3) -> DataFrame:
    """cluster_id, label, members, densest_cell, typical: each group's size and its most typical rows.

    The features are quantised to cells as wide as the radius and the rows of each cell are counted; the
    typical rows are the ``typical`` smallest ids of the group's densest cell (equal counts: the cell of the smaller id).
    """
    factors = F.array(*(F.lit(float(f)) for f in metric.factors))
    cell = F.xxhash64(F.zip_with("v", factors, lambda v, f: F.floor(v * f / radius)))
    cells = rows.join(found.select("qa_id", "cluster_id"), "qa_id").select("qa_id", "cluster_id", "label", cell.alias("cell")).distinct()
    counted = cells.groupBy("cluster_id", "label", "cell").agg(F.count("*").alias("n"), F.min("qa_id").alias("first"))
    best = counted.groupBy("cluster_id", "label").agg(F.sum("n").alias("members"), F.max(F.struct("n", -F.col("first"), "cell")).alias("b"))
    inside = cells.join(best.select("cluster_id", F.col("b.cell").alias("cell")), ["cluster_id", "cell"])
    # Each task keeps the first of a group before they meet, so no cell is gathered in one.
    first = inside.withColumn("r", F.expr("row_number() OVER (PARTITION BY cluster_id ORDER BY qa_id)")).where(F.col("r") <= typical)
    members = first.groupBy("cluster_id").agg(F.array_sort(F.collect_list("qa_id")).alias("typical"))
    return best.select("cluster_id", "label", "members", F.col("b.n").alias("densest_cell")).join(members, "cluster_id")


def group(features: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """The whole operator on the two tables; see :func:`clusters`."""
    metric = read_metric(weights)
    if not metric.names:
        raise ValueError("no feature has a weight above 0")
    return clusters(usable(features, metric), metric, **options)
