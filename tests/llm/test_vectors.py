"""Neighbours and groups against brute force, with few leaves, a small sample and a vector that a third of the rows have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import clusters, neighbours, space
from gradeloom.storage import written

METRIC = space.Metric(["a", "b", "c"], np.array([1.0, 2.0, 0.5]), np.array([1.0, 0.5, 2.0]))
SCHEMA = "qa_id bigint, label int, v array<double>"
SMALL = {"leaf_rows": 32, "sample_rows": 200, "max_leaves": 4}


def _rows(n=900, hot=300, seed=0):
    rng = np.random.default_rng(seed)
    out = [(i, int(rng.integers(0, 3)), [float(round(x, 6)) for x in rng.normal(0, 0.8, 3)]) for i in range(n)]
    out += [(n + i, 1, [0.1, 0.2, 0.3]) for i in range(hot)]
    out += [(2 * n + hot + i, 0, [9.0, 9.0, 9.0 + 0.3 * i]) for i in range(4)]  # a chain of equal steps
    rng.shuffle(out)
    return out + out[:20]  # repeats


def _distance(x, y):
    return neighbours.distances(METRIC, np.array([x]), np.array([y]))[0]


def _brute(rows, k=5, radius=0.4):
    each = {i: (lab, v) for i, lab, v in rows}
    ids = sorted(each)
    x = np.array([each[i][1] for i in ids])
    near, links = set(), []
    for i, at in zip(ids, x, strict=True):
        d = np.round(neighbours.distances(METRIC, np.repeat(at[None], len(x), 0), x), 12)
        close = [(d[n], j) for n, j in enumerate(ids) if j != i and each[j][0] == each[i][0] and d[n] <= radius]
        near |= {(i, j) for _, j in sorted(close)[:k]}
        links += [(i, j) for _, j in close]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    groups: dict = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    return near, {(c, i) for c, g in groups.items() if len(g) >= 3 for i in g}


@pytest.fixture(scope="module")
def case(spark):
    rows = _rows()
    return spark.createDataFrame(rows, SCHEMA).repartition(6, F.xxhash64("qa_id", "v")), *_brute(rows)


@pytest.mark.parametrize("options", [{}, SMALL], ids=["plain", "small"])
def test_neighbours_equal_brute_force(case, options):
    df, near, _ = case
    got = neighbours.neighbours(df, METRIC, **options).collect()
    assert {(r.qa_id, r.neighbour) for r in got} == near and len(got) == len(near)


@pytest.mark.parametrize("options", [{}, SMALL], ids=["plain", "small"])
def test_groups_equal_brute_force(case, options):
    df, _, groups = case
    got = clusters.clusters(df, METRIC, **options).collect()
    assert {(r.cluster_id, r.qa_id) for r in got} == groups and len(got) == len(groups)


def test_narrow_windows_with_a_threshold_keep_recall(case):
    df, near, _ = case
    got = {(r.qa_id, r.neighbour) for r in neighbours.neighbours(df, METRIC, threshold=2, width=0.8).collect()}
    recall = len(got & near) / len(near)
    print("recall", recall)
    assert recall >= 0.9


def test_leaves_do_not_grow_with_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, 0, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(6000)], SCHEMA)
    fitted = space.fit_space(rows, METRIC, 64, 300, 8)
    shared = space.share(spark, fitted)
    assert fitted.n_leaves <= 8 and not len(fitted.hot)
    placed, _ = written(rows.withColumn("h", F.xxhash64("label", "v")).mapInArrow(neighbours._place(shared), "leaf bigint, kind tinyint, qa_id bigint, x binary"))
    below = space.refine(placed, fitted, shared, written)
    sizes = [r["count"] for r in below.descend(placed, shared).groupBy("leaf").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2 * 64


@pytest.mark.parametrize("n", [0, 1])
def test_hardly_any_rows(spark, n):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0])][:n], SCHEMA)
    assert neighbours.neighbours(df, METRIC).count() == 0 and clusters.clusters(df, METRIC).count() == 0


def test_dirty_rows_and_clashing_columns(spark):
    rows = [(1, 0, 0.0, 1, 2), (2, 0, float("nan"), 1, 2), (3, 0, None, 1, 2), (4, -1, 0.0, 1, 2), (5, None, 0.0, 1, 2), (None, 0, 0.0, 1, 2), (6, 0, float("inf"), 1, 2), (7, 0, 0.1, 1, 2), (8, 0, 0.2, 1, 2)]
    df = spark.createDataFrame(rows, "qa_id bigint, label int, a double, leaf int, x int")
    weights = spark.createDataFrame([("a", 1.0, 1.0), ("leaf", 0.0, 1.0), ("x", None, 1.0)], "feature string, weight double, unit double")
    assert {(r.qa_id, r.neighbour) for r in neighbours.search(df, weights).collect()} == {(a, b) for a in (1, 7, 8) for b in (1, 7, 8) if a != b}
    assert {(r.cluster_id, r.qa_id) for r in clusters.group(df, weights).collect()} == {(1, 1), (1, 7), (1, 8)}
    scores = {r.qa_id: r.score for r in neighbours.closeness(df, neighbours.search(df, weights)).collect()}
    assert scores[2] is None and scores[7] == pytest.approx(-0.1) and len(scores) == 8
