from datetime import datetime, timedelta

import numpy as np

from gapline.operators.regular_grid import regular_grid, smooth

T0 = datetime(2024, 1, 1)
RECORDS = "view_id bigint, record_id bigint, effective_timestamp timestamp_ntz, raw_value double, epoch int, cells string"
VIEWS = "view_id bigint, primitive string, window_start timestamp_ntz, cadence int"
DEFS = "primitive string, cadence_minutes int, expected_epochs int, value_column string"


def plain_smoother(y, n, ratio):
    """One series by dense linear algebra: the exact posterior mean and variance of the same model."""
    steps = len(y)
    f = np.array([[1.0, 1.0], [0.0, 1.0]])
    q = ratio * np.array([[1 / 3, 1 / 2], [1 / 2, 1.0]])
    cov = np.zeros((2 * steps, 2 * steps))
    p = np.diag([1e4, 1e2])
    blocks = [p]
    for _ in range(steps - 1):
        p = f @ p @ f.T + q
        blocks.append(p)
    for i in range(steps):
        a = blocks[i]
        for j in range(i, steps):
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = a
            cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = a.T
            a = a @ f.T
    seen = np.flatnonzero(n)
    h = np.zeros((len(seen), 2 * steps))
    h[np.arange(len(seen)), 2 * seen] = 1
    s = h @ cov @ h.T + np.diag(1.0 / n[seen])
    gain = cov @ h.T @ np.linalg.inv(s)
    return (gain @ y[seen])[::2], np.diag(cov - gain @ h @ cov)[::2]


def test_smoother_is_the_exact_posterior():
    rng = np.random.default_rng(4)
    n = (rng.random(30) < 0.5).astype(float)
    n[3] = 4
    y = np.where(n > 0, np.cumsum(rng.standard_normal(30)), 0.0)
    value, sd = smooth(y[None], n[None], np.zeros((1, 30)), ratios=(0.1,))
    centre = y[n > 0].mean()
    spread = np.sqrt(np.mean((y[n > 0] - centre) ** 2))
    mean, var = plain_smoother(np.where(n > 0, (y - centre) / spread, 0), n, 0.1)
    assert np.allclose(value[0], mean * spread + centre, atol=1e-5)
    assert np.allclose((sd[0] / sd[0, 0]) ** 2, var / var[0], rtol=1e-3)


def test_a_line_is_filled_as_a_line():
    y = np.arange(40.0)[None] * 2 + 5
    n = np.ones((1, 40))
    n[0, 10:25] = 0
    value, sd = smooth(np.where(n > 0, y, 0), n, np.zeros((1, 40)))
    assert np.allclose(value, y, atol=0.2)
    walk = np.cumsum(np.random.default_rng(1).standard_normal(40))[None]
    _, sd = smooth(np.where(n > 0, walk, 0), n, np.zeros((1, 40)))
    assert sd[0, 17] > 1.5 * sd[0, 5]


def test_epochs_empties_and_dirty_rows(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    inf = float("inf")
    records = [
        (1, 10, at(0), 5.0, 1, ""), (1, 10, at(0), 5.0, 1, ""), (1, 11, at(9.99), 7.0, 1, ""), (1, 12, at(10), None, 1, ""), (1, 13, at(20), float("nan"), 1, ""),
        (1, 14, at(30), inf, 1, ""), (1, 15, at(40), -3.0, 1, ""), (1, 16, at(60), 1.0, 1, ""), (1, 17, at(-1), 1.0, 1, ""), (9, 18, at(0), 1.0, 1, ""), (1, 19, None, 1.0, 1, ""), (None, 20, at(0), 1.0, 1, ""),
    ]
    views = [(1, "p", T0, 3), (1, "p", T0, 3), (2, "p", T0, 3), (3, "unknown", T0, 3), (4, "p", None, 3), (None, "p", T0, 3)]
    out = regular_grid(spark.createDataFrame(records, RECORDS), spark.createDataFrame(views, VIEWS), spark.createDataFrame([("p", 10, 6, "hr_mean")], DEFS)).collect()
    assert sorted((r.view_id, r.epoch_index) for r in out) == [(v, e) for v in (1, 2) for e in range(6)]
    one = {r.epoch_index: r for r in out if r.view_id == 1}
    assert [one[e].is_empty for e in range(6)] == [False, True, True, False, False, True]
    assert one[0].n_readings == 2 and one[0].observed == 6.0 and one[3].n_readings == 1 and one[3].observed is None
    assert all(r.filled is not None for r in one.values())
    assert all(r.is_empty and r.filled is None for r in out if r.view_id == 2)


def test_empty_tables(spark):
    assert regular_grid(spark.createDataFrame([], RECORDS), spark.createDataFrame([], VIEWS), spark.createDataFrame([], DEFS)).collect() == []
