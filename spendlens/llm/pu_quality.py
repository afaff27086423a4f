"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text suffice: with the share ``prior`` of good texts among the
unlabelled, the risk on negatives is that on unlabelled text less ``prior`` times that of calling
positives negative.  Where that difference turns negative the model overfits, and the step goes back
on it instead (Kiryo et al. 2017).  The prior is estimated from the same two samples as the smallest
ratio of unlabelled to positive mass above a score (best bin estimation, Garg et al. 2021).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spendlens.llm import textfeat
from spendlens.llm.shared import checkpointed, held_out, learnable

N_BITS = 8
THRESHOLD = 0.3
#: Byte classes whose shares are features.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&<>", "|", "!", "?", ".,;:", " \t", "\n",
           "()[]{}", "@/\\_=+-")
HIDDEN = 32


def _class_table() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for k, chars in enumerate(CLASSES):
        for c in chars:
            out[ord(c), k] = 1
    return out


TABLE = _class_table()


def features(text: str | None) -> np.ndarray:
    """Shape and repetition of a text, then shares of its hashed byte n-grams.

    The whole text counts; null is empty.
    """
    data = (text or "").encode("utf-8")
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(words))
    distinct = len(set(words))
    counts = np.zeros(256)
    for i in range(0, len(data), 1 << 20):
        counts += np.bincount(np.frombuffer(data[i:i + (1 << 20)], dtype=np.uint8), minlength=256)
    shape = [np.log1p(len(words)), distinct / n, np.log1p(distinct) / np.log1p(n),
             sum(a == b for a, b in zip(words, words[1:])) / n, min(30.0, (len(data) - counts[32]) / n),
             1 - len(set(lines)) / max(1, len(lines)), min(1.0, 20 / n)]
    return np.concatenate([shape, np.log1p(100 * (counts @ TABLE) / max(1, len(data))), 100 * textfeat.shares(data, N_BITS)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    """Standardised features, one hidden layer, one logistic output."""
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def hidden(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.params[0] + self.params[1])

    def output(self, h: np.ndarray) -> np.ndarray:
        return sigmoid(h @ self.params[2] + self.params[3])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.output(self.hidden(self.inputs(x)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 500, rate: float = 0.02,
             strength: float = 1e-4, back_off: float = 0.1, seed: int = 7) -> Model:
    """Network that minimises the non-negative unbiased risk with logistic loss.

    Adam on the whole sample, which leaves the sign of the negative risk to the data and not to a
    batch's luck.  ``back_off`` discounts the step against a negative risk under zero.
    """
    both, rng = np.vstack([pos, unl]), np.random.default_rng(seed)
    spread = both.std(axis=0)
    scale = np.where(spread > 0, 1 / np.maximum(spread, 1e-6), 0)
    scale[-(1 << N_BITS):] /= np.sqrt(1 << N_BITS) / 4      # the many n-gram shares weigh like a few shape features
    d, n_pos = both.shape[1], len(pos)
    model = Model(both.mean(axis=0), scale, [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN),
                                             rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)], prior)
    z = model.inputs(both)
    share = np.where(np.arange(len(z)) < n_pos, 1 / n_pos, 1 / len(unl))
    first, second = [np.zeros_like(q) for q in model.params], [np.zeros_like(q) for q in model.params]
    for t in range(1, steps + 1):
        h = model.hidden(z)
        s = model.output(h)
        as_negative = -np.log(np.maximum(1e-12, 1 - s)) * share
        # Gradients by the margin: of positives as such, and of the risk on negatives.
        positive = np.where(np.arange(len(z)) < n_pos, prior * (s - 1), 0)
        negative = np.where(np.arange(len(z)) < n_pos, -prior * s, s)
        if as_negative[n_pos:].sum() >= prior * as_negative[:n_pos].sum():
            g = (positive + negative) * share
        else:
            g = -back_off * negative * share
        back = np.outer(g, model.params[2]) * (1 - h * h)
        grads = [z.T @ back + strength * model.params[0], back.sum(axis=0), h.T @ g + strength * model.params[2], g.sum(keepdims=True)]
        pace = rate * min(1.0, 3 * (1 - t / (steps + 1)))
        for k, q in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * q
            second[k] = 0.999 * second[k] + 0.001 * q * q
            model.params[k] = model.params[k] - pace * first[k] / (1 - 0.9 ** t) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


def estimate_prior(pos: np.ndarray, unl: np.ndarray, confidence: float = 0.1) -> float:
    """Best bin estimate of the share of positives among ``unl``.

    A classifier of positive against unlabelled is fitted on half of either sample; on the other
    half, the mass of unlabelled over that of positives above a score is smallest where nearly
    only positives are left.
    """
    model = fit_nnpu(pos[::2], unl[::2], 0.5)
    sp, su = np.sort(model.score(pos[1::2])), np.sort(model.score(unl[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.unique(np.quantile(sp, np.linspace(0, 1, 101)))
    mass_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    mass_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    ok = mass_p > 0
    best = np.argmin((mass_u[ok] + slack) / mass_p[ok])
    return float(np.clip(mass_u[ok][best] / mass_p[ok][best], 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model | None:
    """A model from at most ``most`` trusted positives and ``most`` unlabelled texts.

    Positives are learnable documents with quality 1, the unlabelled sample is drawn from all
    learnable documents without a look at labels.  None if there is no positive or no text.
    """
    rows = docs.where(learnable(F.col("doc_id")))
    ids = checkpointed(rows.select("doc_id").distinct())
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    pos = textfeat.sample(ids.join(good, "doc_id", "left_semi"), most).select("doc_id", F.lit(1.0).alias("kind"))
    unl = textfeat.sample(ids, most).select("doc_id", F.lit(0.0).alias("kind"))
    chosen = rows.select("doc_id", "text").join(F.broadcast(pos.unionByName(unl)), "doc_id").select("kind", "text")
    y, x = textfeat.collect_features(chosen, features, "kind")
    y = y.astype(float)
    if not (y == 1).any() or not (y == 0).any():
        return None
    order = np.random.default_rng(1).permutation(len(y))
    y, x = y[order], x[order].astype(np.float64)
    pos_x, unl_x = x[y == 1], x[y == 0]
    return fit_nnpu(pos_x, unl_x, estimate_prior(pos_x, unl_x))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` of whole texts, null and empty ones too; without a model 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = np.full(len(b), 0.5)
            for i in range(0, len(b) if m else 0, 256):
                out[i:i + 256] = m.score(np.stack([features(t) for t in b["text"].iloc[i:i + 256]]))
            yield textfeat.doc_frame(b["doc_id"], score=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
