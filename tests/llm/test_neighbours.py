import numpy as np
import pytest

from gradeloom.llm import neighbours
from gradeloom.llm.space import Metric


@pytest.mark.parametrize("scale", [0.0, 1e4, 1e5, 1e6, 1e8])
def test_far_rows_find_their_neighbours(scale):
    rng = np.random.default_rng(1)
    one = scale * (1 + rng.random((300, 2))) + 10 * np.arange(300)[:, None]
    x = np.concatenate([one, one + [0.39999, 0.0]])
    ids, metric = np.arange(len(x)), Metric(["a", "b"], np.ones(2), np.ones(2))
    q, near, d = neighbours.window_search(metric, 5, x, x, ids, np.full(len(x), 0.4), x, x, ids, [0.1, 0.4])
    every = [(i, j) for i in ids for j in ids[(neighbours.distances(metric, np.repeat(x[i : i + 1], len(x), 0), x) <= 0.4) & (ids != i)]]
    assert sorted(zip(q.tolist(), near.tolist(), strict=True)) == every and len(every) == 600
