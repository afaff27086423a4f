"""Per-user walk-forward calibration (L11-L13) - the one operator that runs Python
on executors.

``groupBy(user).applyInPandas`` hands each user's weekly history (bounded by the
number of weeks in the calendar span, not by transaction volume) to a small
NumPy state machine: predict first, reveal the label, buffer the last rows and
refit a softmax calibrator every few weeks after a warm-up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT_SCHEMA = ("user_id long, week_t string, week_order int, y_true int, y_pred_base int, y_pred_cal int, "
              "y_pred_blend int, confidence double, update_count int, user_total_history int")


@dataclass(frozen=True)
class CalibrationConfig:
    # Fixed values of the reference simulation.
    n_classes: int = 4
    warmup_weeks: int = 8
    update_every_weeks: int = 2
    history_cap: int = 20
    learning_rate: float = 0.05
    l2: float = 1e-3
    grad_clip: float = 5.0
    epochs: int = 20
    alpha_after_warmup: float = 0.2


def softmax(z: np.ndarray) -> np.ndarray:
    """Along the last axis, shifted by the maximum; class by class, as NumPy reduces a short last axis slowly."""
    classes = range(z.shape[-1])
    e = np.exp(z - reduce(np.maximum, [z[..., i] for i in classes])[..., None])
    return e / reduce(np.add, [e[..., i] for i in classes])[..., None]


def start_params(users: int, k: int) -> np.ndarray:
    """One (k, k + 1) matrix per user: identity weights and, in the last column, zero offsets."""
    return np.tile(np.hstack([np.eye(k), np.zeros((k, 1))]), (users, 1, 1))


def calibrated(params: np.ndarray, p: np.ndarray) -> np.ndarray:
    """L11 for all users: softmax of the affine map of each user's probabilities ``p`` (users, rows, k)."""
    return _softened(params, with_one(p))


def _softened(params: np.ndarray, x: np.ndarray) -> np.ndarray:
    return softmax(np.matmul(x, params.swapaxes(1, 2)))


def with_one(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p, np.ones(p.shape[:-1] + (1,))], axis=-1)


def refit(params: np.ndarray, p: np.ndarray, target: np.ndarray, cfg: CalibrationConfig) -> np.ndarray:
    """L12 for all users: ``epochs`` full-batch gradient steps on mean cross-entropy.

    ``target`` is one-hot.  The penalty leaves offsets alone; a user's gradient is clipped by the
    norm over weights and offsets together.
    """
    penalty = np.append(np.full(cfg.n_classes, cfg.l2), 0.0)
    x = with_one(p)
    for _ in range(max(1, cfg.epochs)):
        gradient = np.matmul((_softened(params, x) - target).swapaxes(1, 2), x) / p.shape[1] + penalty * params
        norm = np.linalg.norm(gradient.reshape(len(gradient), -1), axis=1)
        shrink = np.minimum(1.0, cfg.grad_clip / np.maximum(norm, 1e-12))
        params = params - cfg.learning_rate * shrink[:, None, None] * gradient
    return params


def update_weeks(weeks: int, cfg: CalibrationConfig) -> list[int]:
    """Numbers of seen rows after which a user refits: from the warm-up on, in the given step."""
    first = max(cfg.warmup_weeks, cfg.update_every_weeks)
    return list(range(first, weeks + 1, cfg.update_every_weeks))


def _walk_many(pdf: pd.DataFrame, cfg: CalibrationConfig) -> pd.DataFrame:
    """L13 for a group of users: predict with what earlier rows taught, row by row, test rows out.

    When a user refits depends on the number of rows seen only, so all users move together: they
    are padded to one (users, rows, classes) array, and between two refits every row is predicted
    with the same parameters.
    """
    names = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    if pdf.empty:
        return pd.DataFrame(columns=names)
    k = cfg.n_classes
    pdf = pdf.sort_values(["user_id", "week_start", "week_t"], kind="mergesort").reset_index(drop=True)
    by_user = pdf.groupby("user_id", sort=False)
    user, row = by_user.ngroup().to_numpy(), by_user.cumcount().to_numpy()
    total = by_user["user_id"].transform("size").to_numpy()
    users, rows = int(user.max()) + 1, int(total.max())
    proba, target = np.zeros((users, rows, k)), np.zeros((users, rows, k))
    proba[user, row] = pdf[[f"proba_class_{i}" for i in range(k)]].to_numpy(dtype=float)
    label = pdf["label"].to_numpy(dtype=int)
    target[user, row, label] = 1.0
    refits = update_weeks(rows, cfg)
    params, adapted = start_params(users, k), np.zeros_like(proba)
    for since, until in zip([0, *refits], [*refits, rows]):
        if since:
            seen = slice(max(0, since - cfg.history_cap), since)
            params = refit(params, proba[:, seen], target[:, seen], cfg)
        adapted[:, since:until] = calibrated(params, proba[:, since:until])
    test = np.flatnonzero(pdf["is_test"].to_numpy(dtype=int) == 1)
    u, r = user[test], row[test]
    base, cal = proba[u, r], adapted[u, r]
    alpha = np.where(r >= cfg.warmup_weeks, cfg.alpha_after_warmup, 0.0)[:, None]
    blend = (1.0 - alpha) * base + alpha * cal
    out = {
        "user_id": pdf["user_id"].to_numpy()[test].astype("int64"), "week_t": pdf["week_t"].astype(str).to_numpy()[test],
        "week_order": r + 1, "y_true": label[test], "y_pred_base": base.argmax(axis=1), "y_pred_cal": cal.argmax(axis=1),
        "y_pred_blend": blend.argmax(axis=1), "confidence": blend.max(axis=1),
        "update_count": np.searchsorted(refits, r, side="right"), "user_total_history": total[test]}
    return pd.DataFrame({c: out[c] if c in ("user_id", "week_t", "confidence") else out[c].astype("int32") for c in names})


USERS_PER_GROUP = 1000


def personalize(scored: DataFrame, label: str, cfg: CalibrationConfig | None = None,
                users_per_group: int = USERS_PER_GROUP) -> DataFrame:
    """Scored rows (user_id, week_start, week_t, is_test, proba_class_*, label) ->
    one evaluation row per test week with base, calibrated and blended predictions.

    Users are hashed into at least ``2 x defaultParallelism`` groups and into more when
    needed to keep about ``users_per_group`` users per group (the group count grows with
    the number of users, so a group stays bounded by users_per_group x weeks); each
    group runs the vectorised walk.
    """
    cfg = cfg or CalibrationConfig()
    cols = ["user_id", "week_start", "week_t", "is_test"] + [f"proba_class_{i}" for i in range(cfg.n_classes)]
    src = scored.select(*[F.col(c) for c in cols], F.col(label).cast("int").alias("label"))
    n_users = src.select("user_id").distinct().count()
    n_groups = max(1, -(-n_users // users_per_group), 2 * src.sparkSession.sparkContext.defaultParallelism)
    grp = F.pmod(F.xxhash64("user_id"), F.lit(n_groups))
    return src.groupBy(grp.alias("_g")).applyInPandas(lambda pdf: _walk_many(pdf, cfg), schema=OUT_SCHEMA)


def time_to_benefit(ev: DataFrame) -> DataFrame:
    """Per user the first test row where the running accuracy of the calibrated
    predictor exceeds the base one; medians of that row and of its update count."""
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("week_order").rowsBetween(Window.unboundedPreceding, 0)
    r = ev.select("user_id", "week_order", "update_count",
                  F.avg((F.col("y_pred_base") == F.col("y_true")).cast("double")).over(w).alias("acc_base"),
                  F.avg((F.col("y_pred_cal") == F.col("y_true")).cast("double")).over(w).alias("acc_cal"),
                  F.row_number().over(Window.partitionBy("user_id").orderBy("week_order")).alias("n"))
    first = r.groupBy("user_id").agg(F.min_by(F.struct("n", "update_count"),
                                              F.when(F.col("acc_cal") > F.col("acc_base"), F.col("n"))).alias("hit"))
    first = first.where(F.col("hit").isNotNull())
    return first.agg(F.count(F.lit(1)).alias("users_with_benefit"),
                     F.percentile(F.col("hit.n"), 0.5).alias("median_rows_to_benefit"),
                     F.percentile(F.col("hit.update_count"), 0.5).alias("median_updates_to_benefit"))
