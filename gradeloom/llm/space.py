"""Vectors of weighted features: usable rows, a packed form, and a partition of space by projections.

Both operators on vectors rest on one fact: an orthonormal projection never lengthens a distance. Two
rows at most R apart differ by at most R on every projection, so a window of R around a query on a
sorted projection holds all its neighbours, and a row needs to meet only those leaves of the partition
whose box is at most R away from it. Nothing is lost by windows or leaves; they only save work.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECIMALS = 6


@dataclass
class Metric:
    """Features of weight above 0 with their weights and units, in the order of the feature names."""

    names: list[str]
    weights: np.ndarray
    units: np.ndarray

    @property
    def factors(self) -> np.ndarray:
        return np.sqrt(self.weights) / self.units


def read_metric(weights: DataFrame) -> Metric:
    """The table of weights has one row per feature column; features of weight 0 or null play no part."""
    rows = weights.where("weight > 0").groupBy("feature").agg(F.max("weight").alias("weight"), F.max("unit").alias("unit")).orderBy("feature").collect()
    return Metric([r.feature for r in rows], np.array([r.weight for r in rows], float), np.array([r.unit for r in rows], float))


def usable(features: DataFrame, metric: Metric, labels=(0, 1, 2)) -> DataFrame:
    """qa_id, label, v (ARRAY<DOUBLE>) of the rows with a proper label and no null or NaN feature.

    A row with an infinite feature has no finite distance to any other row and is left out as well,
    as is a row without an id. Repeats of a row are still there.
    """
    good = F.col("qa_id").isNotNull() & F.col("label").isin(*labels)
    for name in metric.names:
        c = F.col(f"`{name}`")
        good = good & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return features.where(good).select(F.col("qa_id").cast("bigint").alias("qa_id"), F.col("label").cast("int").alias("label"), F.array(*(F.col(f"`{n}`").cast("double") for n in metric.names)).alias("v"))


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes without loss: scaled 32-bit integers where the decimals allow it, else doubles."""
    scaled = np.rint(x * 10.0**DECIMALS)
    short = (np.abs(scaled) < 2**31 - 1).all(axis=1)
    short &= (np.where(short[:, None], scaled, 0) / 10.0**DECIMALS == x).all(axis=1)
    small = np.where(short[:, None], scaled, 0).astype("<i4")
    wide = np.ascontiguousarray(x, dtype="<f8")
    return [small[i].tobytes() if s else wide[i].tobytes() for i, s in enumerate(short.tolist())]


def unpack(col: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The inverse of :func:`pack`."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype="<i4")[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if n else np.zeros(0, np.uint8)
    width = np.diff(offsets)
    out = np.empty((n, d))
    for kind, bytes_each, scale in (("<i4", 4 * d, 10.0**DECIMALS), ("<f8", 8 * d, 1.0)):
        at = np.flatnonzero(width == bytes_each)
        if len(at):
            rows = data[offsets[at][:, None] + np.arange(bytes_each)]
            out[at] = np.ascontiguousarray(rows).view(kind).reshape(len(at), d) / scale
    return out


def matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(col), d)


#: Leaves of the tree that every task holds; fuller leaves are split on by trees of their own, which are rows of a table.
MAX_LEAVES = 8_192
#: Sample rows for each leaf that is to be made.
PER_LEAF = 16
#: Rows that one task takes at once when it places rows in the leaves below a full leaf.
PLACED_AT_ONCE = 500_000
#: A vector is hot if its copies are at least this many of the sample.
HOT_IN_SAMPLE = 3


@dataclass
class Tree:
    """A partition of the rotated space: inner nodes split on one projection, leaves are boxes."""

    axis: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    boxes: list[np.ndarray] = field(default_factory=list)

    def home(self, z: np.ndarray) -> np.ndarray:
        """The leaf that each point lies in."""
        out, stack = np.zeros(len(z), np.int64), [(0, np.arange(len(z)))]
        while stack:
            node, idx = stack.pop()
            if self.leaf[node] >= 0:
                out[idx] = self.leaf[node]
            elif len(idx):
                right = z[idx, self.axis[node]] > self.at[node]
                stack += [(self.low[node], idx[~right]), (self.high[node], idx[right])]
        return out

    def within(self, z: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for each leaf at most ``radius`` away from the point, its own leaf included."""
        rows, leaves = [np.zeros(0, int)], [np.zeros(0, np.int64)]
        slack = radius + 1e-9 * (1 + np.abs(z).max(axis=1, initial=0.0))
        stack = [(0, np.arange(len(z)))]
        while stack:
            node, idx = stack.pop()
            if not len(idx):
                continue
            if self.leaf[node] >= 0:
                lo, hi = self.boxes[node]
                gap = np.maximum(np.maximum(lo - z[idx], z[idx] - hi), 0)
                idx = idx[(gap**2).sum(axis=1) <= slack[idx] ** 2]
                rows.append(idx)
                leaves.append(np.full(len(idx), self.leaf[node], np.int64))
            else:
                d = z[idx, self.axis[node]] - self.at[node]
                stack += [(self.low[node], idx[d <= slack[idx]]), (self.high[node], idx[d > -slack[idx]])]
        return np.concatenate(rows), np.concatenate(leaves)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        boxes = np.stack([b for b in self.boxes if b is not None])
        np.savez(out, axis=self.axis, at=self.at, low=self.low, high=self.high, leaf=self.leaf, boxes=boxes)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Tree:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        leaf, boxes = got["leaf"].tolist(), iter(got["boxes"])
        return Tree(got["axis"].tolist(), got["at"].tolist(), got["low"].tolist(), got["high"].tolist(), leaf, [next(boxes) if x >= 0 else None for x in leaf])


@dataclass
class Space:
    """Rotation and a tree for each label; leaves are numbered through all labels."""

    metric: Metric
    rotation: np.ndarray
    centre: np.ndarray
    trees: dict[int, Tree]
    n_leaves: int
    rows: int
    leaf_rows: int
    #: Hashes of the vectors that are hot in the sample; what they flag is grouped by the vector itself.
    hot: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x * self.metric.factors - self.centre) @ self.rotation

    def home(self, label: np.ndarray, z: np.ndarray) -> np.ndarray:
        out = np.zeros(len(z), np.int64)
        for lab, tree in self.trees.items():
            idx = np.flatnonzero(label == lab)
            out[idx] = tree.home(z[idx])
        return out

    def within(self, lab: int, z: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.trees[lab].within(z, radius)

    def labels(self) -> dict[int, int]:
        return {leaf: lab for lab, tree in self.trees.items() for leaf in tree.leaf if leaf >= 0}

    def box(self, leaf: int) -> np.ndarray:
        return next(b for tree in self.trees.values() for x, b in zip(tree.leaf, tree.boxes, strict=True) if x == leaf)


def _grow(z: np.ndarray, n_leaves: int, first: int, box: np.ndarray | None = None) -> tuple[Tree, int]:
    """A tree of ``n_leaves`` leaves over a sample; fewer where the sample has equal rows only."""
    tree, d = Tree(), z.shape[1]
    todo = [(None, None, np.arange(len(z)), n_leaves, np.stack([np.full(d, -np.inf), np.full(d, np.inf)]) if box is None else box)]
    while todo:
        parent, side, idx, want, box = todo.pop()
        node = len(tree.leaf)
        if parent is not None:
            (tree.low if side == 0 else tree.high)[parent] = node
        for x, v in ((tree.axis, -1), (tree.at, 0.0), (tree.low, -1), (tree.high, -1), (tree.leaf, -1), (tree.boxes, None)):
            x.append(v)
        axis = at = None
        if want > 1 and len(idx) >= 4:
            low, mid, high = np.quantile(z[idx], [0.1, 0.5, 0.9], axis=0)
            axis = int((high - low).argmax())
            at = float(np.quantile(z[idx, axis], (want // 2) / want))
            right = z[idx, axis] > at
            if not 0 < right.sum() < len(idx):  # all but a few rows are equal there: cut at the widest axis' middle
                axis = int(np.ptp(z[idx], axis=0).argmax())
                at = float((z[idx, axis].min() + z[idx, axis].max()) / 2)
                right = z[idx, axis] > at
            if not 0 < right.sum() < len(idx):
                axis = None
        if axis is None:
            tree.leaf[node], tree.boxes[node] = first, box
            first += 1
            continue
        tree.axis[node], tree.at[node] = axis, at
        for side, part, w in ((0, idx[~right], want // 2), (1, idx[right], want - want // 2)):
            inner = box.copy()
            inner[1 - side, axis] = at
            todo.append((node, side, part, w, inner))
    return tree, first


def fit_space(rows: DataFrame, metric: Metric, leaf_rows: int = 4096, sample_rows: int = 100_000, max_leaves: int | None = None) -> Space:
    """Fits rotation and splits on a sample bounded by about ``sample_rows``; every row is then placed.

    The sample decides only where the splits lie, never which rows are found. It gives at most ``max_leaves``
    (MAX_LEAVES) leaves, as every task holds them; :func:`refine` splits those that then hold too many rows.
    """
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total, d = sum(counts.values()), len(metric.names)
    share = min(1.0, sample_rows / max(total, 1))
    picked = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("qa_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = picked.select("label", F.transform("v", lambda x: x.cast("float")).alias("v"), F.xxhash64("label", "v").alias("h"), "qa_id").toArrow() if total else None
    labels = got["label"].to_numpy() if got is not None else np.zeros(0, int)
    x = (got["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(labels), d) if d else np.zeros((len(labels), 0))) * metric.factors if got is not None else np.zeros((0, d))
    rotation, centre = np.eye(d), np.zeros(d)
    if len(x) > 4 * d > 0:
        lo, hi = np.quantile(x, [0.005, 0.995], axis=0)
        centre = np.median(x, axis=0)
        rotation = np.linalg.eigh(np.cov(np.clip(x, lo, hi).T).reshape(d, d))[1][:, ::-1]
    hot = np.zeros(0, np.int64)
    if len(labels):
        each = np.unique(np.stack([got["h"].to_numpy(), got["qa_id"].to_numpy()]), axis=1)[0]  # repeats of a row count once
        hashes, times = np.unique(each, return_counts=True)
        hot = hashes[times >= max(HOT_IN_SAMPLE, 1)] if share < 1 else hashes[times >= 4 * HOT_IN_SAMPLE]
    trees, first = {}, 0
    for lab in sorted(counts):
        z = (x[labels == lab] - centre) @ rotation
        most = max(1, (max_leaves or MAX_LEAVES) * counts[lab] // max(total, 1))
        trees[lab], first = _grow(z, max(1, min(round(counts[lab] / leaf_rows), most)), first)
    return Space(metric, np.ascontiguousarray(rotation), centre, trees, max(first, 1), total, leaf_rows, hot)


def share(spark: SparkSession, space: Space):
    """One copy for each executor: at most MAX_LEAVES boxes and sample_rows / HOT_IN_SAMPLE hashes, whatever the input's size."""
    return spark.sparkContext.broadcast(space)


@dataclass
class Below:
    """The trees below full leaves: a table (leaf, tree), and the rows of each of these leaves."""

    table: DataFrame | None
    sizes: dict[int, int]

    def descend(self, rows: DataFrame, shared, radius: str | None = None, own: str = "true") -> DataFrame:
        """Rows (leaf, qa_id, x, ...) with leaf · 2³² + the leaf of the tree below (0 where there is none), and ``home``, whether that is the row's own.

        With a column ``radius`` a row goes to every leaf at most so far away. ``own`` tells whether the leaf given is
        the row's own. A full leaf's rows are dealt to tasks by a hash of qa_id, so none takes more than about
        PLACED_AT_ONCE of them.
        """
        leaf = F.shiftleft(F.col("leaf").cast("bigint"), 32)
        if self.table is None:
            return rows.withColumn("home", F.expr(own)).withColumn("leaf", leaf)
        spark = rows.sparkSession
        salts = spark.createDataFrame([(k, -(-n // PLACED_AT_ONCE)) for k, n in self.sizes.items()], "full bigint, salts bigint")  # at most MAX_LEAVES rows
        known = rows.withColumn("home", F.expr(own)).join(F.broadcast(salts), F.col("leaf") == F.col("full"), "left")
        plain = known.where("full IS NULL").drop("full", "salts").withColumn("leaf", leaf)
        deep = known.where("full IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("qa_id"), F.col("salts"))).drop("full", "salts")
        trees = self.table.join(F.broadcast(salts), F.col("leaf") == F.col("full")).select(F.col("leaf").alias("l"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("s"), "tree")
        names = plain.columns

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return left.select(names)
            space = shared.value
            tree = Tree.from_bytes(right["tree"][0].as_py()) if right.num_rows else _grow(np.zeros((0, len(space.metric.names))), 1, 0)[0]
            z = space.project(unpack(left["x"], len(space.metric.names)))
            inner = tree.home(z)
            at, to = (np.arange(len(z)), inner) if radius is None else tree.within(z, left[radius].to_numpy())
            out = left.take(pa.array(at))
            put = {"leaf": pa.array((out["leaf"].to_numpy().astype(np.int64) << 32) + 1 + to, pa.int64()), "home": pa.array(out["home"].to_numpy(zero_copy_only=False).astype(bool) & (to == inner[at]))}
            return pa.table({n: put.get(n, out[n] if n not in put else None) for n in names})

        done = deep.groupBy("leaf", "salt").cogroup(trees.groupBy("l", "s")).applyInArrow(run, plain.schema)
        return plain.unionByName(done)


def refine(placed: DataFrame, space: Space, shared, write) -> Below:
    """Trees below the leaves that hold more than twice ``leaf_rows`` rows of ``placed`` (leaf, qa_id, x).

    Each is grown by one task from a sample of its leaf, PER_LEAF rows for each leaf to be made, and cuts it in
    pieces of about ``leaf_rows``; so leaves don't grow with the input. Rows that are all equal can't be cut.
    """
    spark = placed.sparkSession
    full = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().where(F.col("count") > 2 * space.leaf_rows).collect()}  # at most MAX_LEAVES rows
    if not full:
        return Below(None, {})
    want = spark.createDataFrame([(k, -(-2 * n // space.leaf_rows)) for k, n in full.items()], "full bigint, want bigint")
    part = min(1.0, PER_LEAF * 2 / space.leaf_rows)
    sampled = placed.join(F.broadcast(want), F.col("leaf") == F.col("full")).where(F.pmod(F.xxhash64("qa_id", F.lit(1)), F.lit(1 << 20)) < int(part * (1 << 20))).select("full", "want", "x")

    def grow(table: pa.Table) -> pa.Table:
        space = shared.value
        leaf = table["full"][0].as_py()
        z = space.project(unpack(table["x"], len(space.metric.names)))
        tree, _ = _grow(z, table["want"][0].as_py(), 0, space.box(leaf))
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([tree.to_bytes()], pa.binary())})

    grown = write(sampled.groupBy("full").applyInArrow(grow, "leaf bigint, tree binary"))[0]
    return Below(grown, full)


def spread_over(spark: SparkSession, space: Space) -> int:
    """Tasks for a stage by leaves: enough to fill the cores, and at most one for each leaf."""
    leaves = max(space.n_leaves, space.rows // space.leaf_rows)
    return max(1, min(leaves, max(4 * int(spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")), leaves // 8)))
