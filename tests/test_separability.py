"""The grouped probe against plain numpy: one regression after the other."""

import hashlib

import numpy as np
import pytest

from flowlens.operators import separability
from flowlens.operators.graph import WINDOW_VECTOR


def plain_fit(x, y, penalty=1.0):
    """Balanced logistic regression with an L2 penalty, by plain damped Newton steps on the features as they are."""
    n1 = y.sum()
    s = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    scale = x.std(0)
    scale[scale == 0] = 1
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    ridge = np.append(penalty / scale ** 2, 0)

    def loss(b):
        z = a @ b
        return (s * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge @ b ** 2

    b = np.zeros(a.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a @ b)))
        gradient = a.T @ (s * (p - y)) + ridge * b
        hessian = (a * (s * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian + 1e-12 * np.eye(len(b)), gradient)
        t = 1.0
        while loss(b - t * step) > loss(b) and t > 1e-9:
            t /= 2
        b = b - t * step
        if np.abs(t * step).max() < 1e-10:
            break
    return lambda q: 1 / (1 + np.exp(-(np.hstack([q / scale, np.ones((len(q), 1))]) @ b)))


def plain_auc(y, p):
    up, down = p[y == 1], p[y == 0]
    return ((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down))


@pytest.fixture(scope="module")
def vectors(spark):
    rng, rows = np.random.default_rng(7), []
    scales = np.array([10, 8, 5, 20, 20, 3e3, 2e6, 1.5, 7])
    for cadence, shift, n in ((2, 0.4, 150), (60, 1.5, 90), (600, 0.0, 40)):
        for i in range(n):
            y = int(rng.random() < (0.3 if cadence != 600 else 0))
            x = np.abs(rng.normal(1 + shift * y, 0.5, len(WINDOW_VECTOR))) * scales
            x[7] = 0.0 if cadence == 2 else x[7]
            rows.append((cadence, f"w{i}", y, *[float(round(v, 6)) for v in x]))
    frame = spark.createDataFrame(rows, "cadence int, window string, y int, " + ", ".join(f"{c} double" for c in WINDOW_VECTOR))
    return rows, frame.cache()


def folds_of(rows):
    """Fold of each row: its place among the rows of its cadence and class, in the order of the hash of its id."""
    out = {}
    for group in {(r[0], r[2]) for r in rows}:
        own = sorted((r for r in rows if (r[0], r[2]) == group), key=lambda r: hashlib.sha256(f"42:{r[1]}".encode()).hexdigest())
        out.update({(r[0], r[1]): i % 3 for i, r in enumerate(own)})
    return out


def test_probabilities_equal_one_fit_after_the_other(spark, vectors):
    rows, frame = vectors
    got = {(r["cadence"], r["window"]): r["p"] for r in separability.held_out_scores(frame, ["cadence"], "window").collect()}
    fold = folds_of(rows)
    assert {k for k, _ in got} == {2, 60}
    for cadence in (2, 60):
        own = [r for r in rows if r[0] == cadence]
        x, y = np.array([r[3:] for r in own]), np.array([r[2] for r in own])
        side = np.array([fold[(cadence, r[1])] for r in own])
        for f in range(3):
            want = plain_fit(x[side != f], y[side != f])(x[side == f])
            mine = [got[(cadence, r[1])] for r, s in zip(own, side, strict=True) if s == f]
            assert np.allclose(mine, want, atol=1e-6)


def test_table_per_cadence(spark, vectors):
    rows, frame = vectors
    p = {(r["cadence"], r["window"]): r["p"] for r in separability.held_out_scores(frame, ["cadence"], "window").collect()}
    table = {r["cadence"]: r for r in separability.separability(frame, ["cadence"], "window").collect()}
    alone = table[600]
    assert (alone["windows"], alone["available"], alone["reason"]) == (40, False, separability.DEGENERATE)
    assert all(alone[c] is None for c in ("auc", "f1_attack", "attack_fraction", "median_edges_attack", "ratio_n_edges"))
    for cadence in (2, 60):
        own = [r for r in rows if r[0] == cadence]
        y, score = np.array([r[2] for r in own]), np.array([p[(cadence, r[1])] for r in own])
        row = table[cadence]
        assert row["available"] and row["reason"] is None and row["windows"] == len(own) and row["attack_windows"] == y.sum()
        assert row["auc"] == pytest.approx(plain_auc(y, score))
        hit = score >= 0.5
        assert row["f1_attack"] == pytest.approx(2 * (hit & (y == 1)).sum() / (hit.sum() + y.sum()))
        assert row["majority_class_accuracy"] == pytest.approx(max(y.mean(), 1 - y.mean()))
        x = np.array([r[3:] for r in own])
        for j, name in enumerate(WINDOW_VECTOR):
            low = np.median(x[y == 0, j])
            assert row[f"ratio_{name}"] == (None if low == 0 else pytest.approx(np.median(x[y == 1, j]) / low))
    assert table[60]["auc"] > table[2]["auc"] and table[2]["ratio_max_port_entropy"] is None


def test_a_class_of_one_row_and_no_rows(spark, vectors):
    rows, frame = vectors
    few = spark.createDataFrame([(1, f"w{i}", int(i == 0), *[float(i)] * 9) for i in range(6)], frame.schema)
    got = separability.held_out_scores(few, ["cadence"], "window").collect()
    assert len(got) == 6 and {r["p"] for r in got if r["window"] == "w0"} == {0.0}
    assert separability.separability(few.filter("false"), ["cadence"], "window").collect() == []
