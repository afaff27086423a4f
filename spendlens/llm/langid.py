"""Language identification by hierarchical discrimination.

A text is first assigned to a language family, then one-versus-one linear support vector machines
tell the family's languages apart.  Families are told apart the same way.  All machines are linear
in the shares of hashed byte n-grams, so one pass over a text gives all margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spendlens.llm import textfeat
from spendlens.llm.shared import checkpointed, held_out, learnable

#: Languages (ISO 639-1) by family.  A language not listed is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
N_BITS = 12
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def normalise(text: str) -> bytes:
    return text.lower().encode("utf-8")


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge loss, L2) for labels -1 and 1.

    Classes weigh alike whatever their sizes.  Accelerated gradient steps of the safe length.
    """
    scale = x.std(axis=0)
    scale = np.where(scale > 0, 1 / np.maximum(scale, 1e-9), 0) / np.sqrt(x.shape[1])
    z = np.hstack([(x * scale).astype(np.float64), np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v)
    step = 1 / (2 * np.linalg.norm(z.T @ (weight * (z @ v))) + strength)
    w = ahead = np.zeros(z.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        new = ahead - step * (strength * ahead - 2 * z.T @ (weight * y * slack))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1] * scale, float(w[-1])


@dataclass
class Tree:
    """One-versus-one machines between families and within each family."""
    groups: dict[str, list[str]]
    pairs: list[tuple[str, str, str]] = field(default_factory=list)     # (node, first, second)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def margins(self, text: str) -> np.ndarray:
        return textfeat.scores(normalise(text), self.weights, N_BITS) + self.bias

    def _vote(self, node: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name with the most wins, then the largest sum of margins; and its confidence."""
        if len(names) == 1:
            return names[0], 1.0
        wins, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        sure = dict.fromkeys(names, 1.0)
        for (n, a, b), m in zip(self.pairs, margins):
            if n != node:
                continue
            p = 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
            wins[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(names, key=lambda x: (wins[x], total[x], x))
        return best, float(sure[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.groups or not LETTER.search(text):
            return UNKNOWN, 0.0
        margins = self.margins(text) if self.pairs else np.zeros(0)
        family, p = self._vote("", list(self.groups), margins)
        lang, q = self._vote(family, self.groups[family], margins)
        return lang, p * q


def fit(docs: DataFrame, per_lang: int = 500) -> Tree:
    """A tree from at most ``per_lang`` texts of each non-null language among the learnable rows.

    Texts without a letter teach nothing.  Without any labelled row the tree is empty and predicts
    'und' for everything; with one language it predicts that.
    """
    rows = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = checkpointed(rows.select("doc_id", "lang").distinct())
    langs = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    if not langs:
        return Tree({})
    samples = [textfeat.sample(ids.where(F.col("lang") == lang), per_lang) for lang in langs]
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(reduce(DataFrame.unionByName, samples)), ["doc_id", "lang"])
    y, x = textfeat.collect_features(chosen, lambda t: textfeat.shares(normalise(t), N_BITS), "lang")
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(y)):
        groups.setdefault(family_of(lang), []).append(lang)
    tree = Tree(groups)
    family = np.array([family_of(v) for v in y], dtype=object)
    machines = []
    for node, target, names in [("", family, list(groups)), *((f, y, langs) for f, langs in groups.items())]:
        for a, b in combinations(names, 2):
            some = (target == a) | (target == b)
            tree.pairs.append((node, a, b))
            machines.append(fit_svm(x[some], np.where(target[some] == a, 1.0, -1.0)))
    if machines:
        tree.weights = np.stack([w for w, _ in machines], axis=1)
        tree.bias = np.array([b for _, b in machines])
    return tree


def identify(docs: DataFrame, tree: Tree) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of whole texts; null texts and texts without letters are 'und'.

    ``score`` is the confidence in the family times that in the language, 0 for 'und'.  The model
    travels with the tasks; its size is buckets times pairs, whatever the data.
    """
    model = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [model.value.predict(t) for t in b["text"]]
            yield textfeat.doc_frame(b["doc_id"], lang_pred=[p for p, _ in out], score=[float(s) for _, s in out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
