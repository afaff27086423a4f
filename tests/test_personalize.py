"""Walk-forward calibration: shape, warm-up and update cadence."""

import numpy as np
import pandas as pd

from spendlens.operators import personalize as P


def test_first_gradient_step_by_hand():
    # Two classes, identity start, one row p = (1, 0) with label 1: softmax(1, 0) = (e, 1) / (e + 1).
    cfg = P.CalibrationConfig(n_classes=2, epochs=1, l2=0.5, learning_rate=0.1)
    out = P.refit(P.start_params(1, 2), np.array([[[1.0, 0.0]]]), np.array([[[0.0, 1.0]]]), cfg)[0]
    e = np.e / (np.e + 1)
    # d = (e, -e); weights: d x p + l2 W, offsets: d without penalty.
    assert np.allclose(out, [[1 - 0.1 * (e + 0.5), 0.0, -0.1 * e], [0.1 * e, 1 - 0.1 * 0.5, 0.1 * e]])


def test_gradient_is_clipped_by_its_joint_norm():
    cfg = P.CalibrationConfig(n_classes=2, epochs=1, l2=0.0, learning_rate=1.0, grad_clip=0.1)
    start = P.start_params(2, 2)
    moved = P.refit(start, np.array([[[1.0, 0.0]], [[0.5, 0.5]]]), np.array([[[0.0, 1.0]], [[0.5, 0.5]]]), cfg) - start
    assert np.isclose(np.linalg.norm(moved[0]), 0.1) and np.allclose(moved[1], 0)


def test_refits_start_with_the_warm_up():
    assert P.update_weeks(14, P.CalibrationConfig()) == [8, 10, 12, 14]
    assert P.update_weeks(7, P.CalibrationConfig()) == []


def test_calibrator_moves_towards_labels():
    cfg = P.CalibrationConfig()
    x = np.tile([0.7, 0.1, 0.1, 0.1], (1, 20, 1))
    y = np.tile([0.0, 0.0, 1.0, 0.0], (1, 20, 1))
    start = P.start_params(1, 4)
    assert P.calibrated(P.refit(start, x, y, cfg), x)[0, 0, 2] > P.calibrated(start, x)[0, 0, 2]


def test_walk_forward_update_counts(spark):
    n = 14
    pdf = pd.DataFrame({"user_id": 1, "week_start": pd.date_range("2020-01-06", periods=n, freq="7D").date,
                        "week_t": [f"w{i:02d}" for i in range(n)], "is_test": [0] * 10 + [1] * 4,
                        "proba_class_0": 0.4, "proba_class_1": 0.3, "proba_class_2": 0.2, "proba_class_3": 0.1,
                        "label": [1] * n})
    out = P.personalize(spark.createDataFrame(pdf), "label").orderBy("week_order").toPandas()
    assert out["week_order"].tolist() == [11, 12, 13, 14]
    # first update fires after the 8th row, then every 2 rows: updates before rows 11..14 = 2, 2, 3, 3
    assert out["update_count"].tolist() == [2, 2, 3, 3]
    assert (out["y_pred_base"] == 0).all()


def test_users_do_not_see_each_other():
    rng = np.random.default_rng(1)
    parts = []
    for u, n in enumerate([3, 9, 25, 14]):
        pr = rng.dirichlet(np.ones(4), size=n)
        parts.append(pd.DataFrame({"user_id": u, "week_start": pd.date_range("2020-01-06", periods=n, freq="7D").date,
                                   "week_t": [f"w{i:02d}" for i in range(n)], "is_test": (np.arange(n) >= n // 2).astype(int),
                                   **{f"proba_class_{i}": pr[:, i] for i in range(4)},
                                   "label": rng.integers(0, 4, size=n)}))
    cfg = P.CalibrationConfig()
    order = ["user_id", "week_order"]
    together = P._walk_many(pd.concat(parts).sample(frac=1.0, random_state=3), cfg).sort_values(order).reset_index(drop=True)
    alone = pd.concat([P._walk_many(p, cfg) for p in parts]).sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(together, alone)


def test_refit_equals_the_sums_written_out():
    rng = np.random.default_rng(5)
    cfg = P.CalibrationConfig(epochs=3)
    p, label = rng.dirichlet(np.ones(4), (6, 11)), rng.integers(0, 4, (6, 11))
    target = np.eye(4)[label]
    got, want = P.refit(P.start_params(6, 4), p, target, cfg), P.start_params(6, 4)
    for u in range(6):
        for _ in range(cfg.epochs):
            g = np.zeros((4, 5))
            for r in range(11):
                x = np.append(p[u, r], 1.0)
                e = np.exp(want[u] @ x)
                g += np.outer(e / e.sum() - target[u, r], x) / 11
            g[:, :4] += cfg.l2 * want[u][:, :4]
            want[u] = want[u] - cfg.learning_rate * min(1.0, cfg.grad_clip / np.linalg.norm(g)) * g
    assert np.allclose(got, want, rtol=0, atol=1e-12)
