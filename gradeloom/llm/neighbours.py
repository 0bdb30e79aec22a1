"""Problem 1: the most similar vectors for every vector, by collision counting on sorted projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.space import Metric, fit_space, matrix, pack, read_metric, refine, share, spread_over, unpack, usable
from gradeloom.storage import written

PAIRS_AT_ONCE = 1 << 20
#: Added to the windows for the rounding of projections, and as much again for each unit of a row's own largest projection.
SLACK, ROUNDING = 5e-4, 4 * float(np.finfo(np.float32).eps)


def distances(metric: Metric, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Square root of the weighted sum of ((x - y) / unit) squared, row by row, one feature at a time."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        t = (x[:, j] - y[:, j]) / metric.units[j]
        total += metric.weights[j] * t * t
    return np.sqrt(total)


def _nearest(k: int, q: np.ndarray, ids: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by (distance to 12 decimals, id): (counts, ids, distances) in order of q."""
    d = np.round(d, 12)
    counts = np.bincount(q, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    order = np.argsort(q, kind="stable")
    q, ids, d = q[order], ids[order], d[order]
    keep = np.ones(len(q), bool)
    for i in np.flatnonzero(counts > 8 * k).tolist():  # long lists first lose what lies beyond their k-th distance
        s, e = starts[i], starts[i + 1]
        keep[s:e] = d[s:e] <= np.partition(d[s:e], k - 1)[k - 1]
    q, ids, d = q[keep], ids[keep], d[keep]
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=n))])[:-1]
    top = np.arange(len(q)) - first[q] < k
    return q[top], ids[top], d[top]


def window_search(metric: Metric, k: int, zq, xq, iq, rq, zb, xb, ib, levels, projections: int = 16, threshold: int | None = None, width: float = 1.0):
    """(query, id, distance) of the at most k nearest base rows within ``rq`` of each query.

    The base is held in sorted arrays, one for each of the ``projections`` widest. At each level (virtual
    rehashing) the windows of all queries that are still open expand to that radius; a query takes its candidates
    from the array in which its window holds the fewest rows, their collisions are counted in the windows of the other
    arrays, and those with at least ``threshold`` collisions are verified by their distance. A query is closed
    when k verified rows lie within the level's radius, as no closer row can be outside the windows.

    With ``width`` 1 and the threshold at all projections (the default) windows are as wide as the radius on unit
    projections, so each true neighbour collides everywhere and the result is exact. Narrower windows
    (``width`` below 1) with a lower threshold look at fewer rows and may miss some.
    """
    n, m = len(zq), min(projections, zq.shape[1])
    need = m if threshold is None else min(threshold, m)
    if not n or not len(zb):
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    axes = np.argsort(-(np.quantile(zb, 0.9, axis=0) - np.quantile(zb, 0.1, axis=0)), kind="stable")[:m]
    far = max(np.abs(zb).max(), np.abs(zq).max())
    kind, wide = (np.float32, ROUNDING) if far < 1e30 else (np.float64, ROUNDING * 1e-6)
    plain = np.ascontiguousarray(zb[:, axes].T.astype(kind))
    orders = np.argsort(plain, axis=1, kind="stable").astype(np.int32)
    lines = np.take_along_axis(plain, orders, axis=1)
    pq = np.ascontiguousarray(zq[:, axes].T.astype(kind))
    slack = SLACK + wide * np.abs(zq[:, axes]).max(axis=1)
    found = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))]
    todo = np.arange(n)
    spare = m - need
    for level in levels:
        if not len(todo):
            break
        radius = (np.minimum(level, rq) * width + slack).astype(kind)
        ball = np.square(np.minimum(level, rq) + slack).astype(kind)  # what the projections alone put further away isn't verified
        low = np.stack([np.searchsorted(lines[p], pq[p, todo] - radius[todo], "left") for p in range(m)])
        high = np.stack([np.searchsorted(lines[p], pq[p, todo] + radius[todo], "right") for p in range(m)])
        # A row with enough collisions can be missing from as many windows as collisions are spare, so from one array more it is taken at least once.
        chosen = np.argsort(high - low, axis=0, kind="stable")[: spare + 1]
        got = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))]
        for first in chosen:
            lo = low[first, np.arange(len(todo))]
            counts = high[first, np.arange(len(todo))] - lo
            ends = counts.cumsum()
            i = 0
            while i < len(todo):
                done = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
                c = counts[i:j]
                qi = np.repeat(todo[i:j].astype(np.int32), c)
                at = np.arange(c.sum(), dtype=np.int32) + np.repeat((lo[i:j] - (ends[i:j] - c - done)).astype(np.int32), c)
                bi = orders[np.repeat(first[i:j].astype(np.int8), c), at] if len(np.unique(first[i:j])) > 1 else orders[first[i]][at]
                count = np.zeros(len(qi), np.int8) if spare else None
                part = np.zeros(len(qi), kind)
                for p in range(m):
                    gap = pq[p][qi] - plain[p][bi]
                    part += gap * gap
                    hit = np.abs(gap) <= radius[qi]
                    if spare:
                        count += hit
                        hit = count >= p + 1 - spare
                    hit &= part <= ball[qi]
                    qi, bi, part = qi[hit], bi[hit], part[hit]
                    if spare:
                        count = count[hit]
                other = ib[bi] != iq[qi]
                qi, bi = qi[other], bi[other]
                d = distances(metric, xq[qi], xb[bi])
                near = d <= np.minimum(level, rq)[qi]
                got.append(_nearest(k, qi[near], ib[bi[near]], d[near], n))
                i = j
        q, ids, d = (np.concatenate(c) for c in zip(*got, strict=True))
        if spare:
            at = np.unique(np.stack([q, ids]), axis=1, return_index=True)[1]
            q, ids, d = _nearest(k, q[at], ids[at], d[at], n)
        full = np.bincount(q, minlength=n) >= k
        closed = full | (rq <= level) | (level == levels[-1])
        at_end = closed[q]
        found.append((q[at_end], ids[at_end], d[at_end]))
        todo = todo[~closed[todo]]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _place(shared):
    """Rows with their leaf; kind 1 marks the rows of a vector that may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            x = matrix(batch["v"], len(space.metric.names))
            leaf = space.home(batch["label"].to_numpy(), space.project(x))
            many = np.isin(batch["h"].to_numpy(), space.hot)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(many.astype(np.int8)), batch["qa_id"], pa.array(pack(x), pa.binary())], ["leaf", "kind", "qa_id", "x"])

    return run


def _distinct_rows(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table["qa_id"].to_numpy()
    ids, at = np.unique(ids, return_index=True)
    return ids, unpack(table["x"].combine_chunks(), d)[at]


def _lists(q: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[np.argsort(q, kind="stable")], kind))


def _thin_copies(ids: np.ndarray, x: np.ndarray, k: int):
    """Of each vector the k + 1 smallest ids stay; for the others their neighbours are known already."""
    _, inverse = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((ids, inverse))
    start = np.concatenate([[0], np.flatnonzero(np.diff(inverse[order])) + 1, [len(ids)]])
    size = np.diff(start)
    rank = np.arange(len(ids)) - np.repeat(start[:-1], size)
    extra = order[rank > k]
    first = np.repeat(start[:-1], size)[rank > k]
    near = order[first[:, None] + np.arange(k)] if len(extra) else np.zeros((0, k), int)
    return np.sort(order[rank <= k]), extra, near


def neighbours(
    rows: DataFrame, metric: Metric, k: int = 5, max_distance: float = 0.4, leaf_rows: int = 4096, sample_rows: int = 100_000, start: float = 0.25, projections: int = 16, threshold: int | None = None, width: float = 1.0, max_leaves: int | None = None
) -> DataFrame:
    """qa_id, neighbour, distance: the at most ``k`` nearest other rows of the same label within ``max_distance``.

    ``rows`` is (qa_id, label, v) as :func:`gradeloom.llm.space.usable` gives it; repeats of a row count
    once, equal distances go to the smaller qa_id, and no rows give no rows. Each row is searched for
    in its own leaf first; the distance of its k-th neighbour there then bounds which other leaves it
    visits, so rows of dense groups visit hardly any. The result is exact unless ``threshold`` and ``width`` say
    otherwise, see :func:`window_search`.

    Of a hot vector (many copies in the sample that fits the space) only the rows of the k + 1 smallest ids are searched for; the
    others have the k smallest of these as neighbours, and no other row can want them.
    """
    spark = rows.sparkSession
    space = fit_space(rows, metric, leaf_rows, sample_rows, max_leaves)
    shared = share(spark, space)
    d, tasks = len(metric.names), spread_over(spark, space)
    levels = [max_distance]
    while levels[0] > start * max_distance:
        levels.insert(0, levels[0] / 2)
    found, _ = written(rows.withColumn("h", F.xxhash64("label", "v")).mapInArrow(_place(shared), "leaf bigint, kind tinyint, qa_id bigint, x binary"))
    placed, copies = found.where("kind = 0").select("leaf", "qa_id", "x"), None
    if len(space.hot):
        # Each task keeps k + 1 of a vector's copies before they meet.
        hot = found.where("kind = 1").select("leaf", "x", "qa_id").distinct()
        first, _ = written(hot.withColumn("r", F.expr("row_number() OVER (PARTITION BY leaf, x ORDER BY qa_id)")).where(F.col("r") <= k + 1).drop("r"))
        placed = placed.unionByName(first)
        leaders = first.groupBy("leaf", "x").agg(F.array_sort(F.collect_set("qa_id")).alias("ids"))  # k + 1 for each of at most sample_rows / HOT_IN_SAMPLE vectors
        followers = hot.join(F.broadcast(leaders), ["leaf", "x"]).where(F.col("qa_id") > F.element_at("ids", -1))
        copies = followers.select("qa_id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(0.0).alias("distance"))
    below = refine(placed, space, shared, written)
    base = below.descend(placed, shared).select("leaf", "qa_id", "x").repartition(tasks, "leaf")
    label_of, split = space.labels(), frozenset(below.sizes)

    def at_home(table: pa.Table) -> pa.Table:
        space = shared.value
        leaf = table["leaf"][0].as_py()
        top = leaf >> 32
        ids_all, x_all = _distinct_rows(table, d)
        keep, extra, near = _thin_copies(ids_all, x_all, k)
        x, ids = x_all[keep], ids_all[keep]
        z, n = space.project(x), len(ids)
        q, found, dist = window_search(metric, k, z, x, ids, np.full(n, max_distance), z, x, ids, levels, projections, threshold, width)
        radius = np.full(n, max_distance)
        full = np.bincount(q, minlength=n) >= k
        last = np.zeros(n)
        np.maximum.at(last, q, dist)
        radius[full] = last[full]
        at, to = space.within(label_of[top], z, radius)
        away = ((to != top) | (top in split)) & (radius[at] > 0)
        at, to = at[away], to[away]
        probing = np.bincount(at, minlength=n) > 0
        packed, ne = pack(x), len(extra)
        return pa.table(
            {
                "own": pa.array(np.full(n + ne, leaf), pa.int64()),
                "qa_id": pa.array(np.concatenate([ids, ids_all[extra]]), pa.int64()),
                "x": pa.array([p if w else None for p, w in zip(packed, probing.tolist(), strict=True)] + [None] * ne, pa.binary()),
                "radius": pa.array(np.concatenate([radius, np.zeros(ne)]), pa.float64()),
                "ids": pa.concat_arrays([_lists(q, found, n, pa.int64()), pa.array(ids_all[near].tolist(), pa.list_(pa.int64()))]),
                "dist": pa.concat_arrays([_lists(q, dist, n, pa.float64()), pa.array([[0.0] * k] * ne, pa.list_(pa.float64()))]),
                "leaves": pa.concat_arrays([_lists(at, to, n, pa.int64()), pa.array([[]] * ne, pa.list_(pa.int64()))]),
            }
        )

    home, _ = written(base.groupBy("leaf").applyInArrow(at_home, "own bigint, qa_id bigint, x binary, radius double, ids array<bigint>, dist array<double>, leaves array<bigint>"))
    asked = home.where("x IS NOT NULL").select(F.explode("leaves").alias("leaf"), "own", "qa_id", "x", "radius")
    probes = below.descend(asked, shared, "radius", "false").where("leaf <> own").select("leaf", "qa_id", "x", "radius").repartition(tasks, "leaf")

    def away(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"qa_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "dist": pa.array([], pa.list_(pa.float64()))})
        if not left.num_rows or not right.num_rows:
            return none
        space = shared.value
        ids, x = _distinct_rows(left, d)
        keep = _thin_copies(ids, x, k)[0]
        ids, x = ids[keep], x[keep]
        iq, xq, rq = right["qa_id"].to_numpy(), unpack(right["x"].combine_chunks(), d), right["radius"].to_numpy()
        q, found, dist = window_search(metric, k, space.project(xq), xq, iq, rq, space.project(x), x, ids, [max_distance], projections, threshold, width)
        has = np.unique(q)
        at = np.searchsorted(has, q)
        return pa.table({"qa_id": pa.array(iq[has], pa.int64()), "ids": _lists(at, found, len(has), pa.int64()), "dist": _lists(at, dist, len(has), pa.float64())})

    far = base.groupBy("leaf").cogroup(probes.groupBy("leaf")).applyInArrow(away, "qa_id bigint, ids array<bigint>, dist array<double>")
    lists = home.where("size(ids) > 0").select("qa_id", "ids", "dist").unionByName(far)
    zipped = F.transform(F.arrays_zip("dist", "ids"), lambda s: F.struct(s["dist"].alias("distance"), s["ids"].alias("neighbour")))
    merged = lists.groupBy("qa_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(zipped)))), 1, k).alias("nb"))
    direct = merged.select("qa_id", F.explode("nb").alias("n")).select("qa_id", "n.neighbour", "n.distance")
    return direct if copies is None else direct.unionByName(copies).distinct()


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """qa_id_a < qa_id_b of each pair in which at least one is a neighbour of the other."""
    return found.select(F.least("qa_id", "neighbour").alias("qa_id_a"), F.greatest("qa_id", "neighbour").alias("qa_id_b")).distinct()


def closeness(features: DataFrame, found: DataFrame) -> DataFrame:
    """qa_id, label, neighbours, score: the score filled anew as minus the mean distance of a row's neighbours.

    One row per qa_id; rows that aren't usable or have no neighbour get 0 neighbours and a null score.
    """
    each = found.groupBy("qa_id").agg(F.count("*").alias("neighbours"), (F.lit(0.0) - F.avg("distance")).alias("score"))
    rows = features.where("qa_id IS NOT NULL").groupBy("qa_id").agg(F.max("label").alias("label"))
    return rows.join(each, "qa_id", "left").select("qa_id", "label", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "score")


def search(features: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """The whole operator on the two tables; see :func:`neighbours`."""
    metric = read_metric(weights)
    rows = usable(features, metric)
    if not metric.names:
        raise ValueError("no feature has a weight above 0")
    return neighbours(rows, metric, **options)
