"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is a bag of its words and of the character n-grams inside them, borders marked; each has a
row in a hashed embedding table.  The mean of the rows goes into a linear softmax over the classes,
and table and softmax are learnt together in numpy (Bojanowski et al. 2017, Joulin et al. 2017).  A
misspelling that no labelled text holds still shares most n-grams, and so their vectors, with the
word meant.

All after the table is linear, so a fitted model folds into one number per table row and class.
Scoring a text of any length averages these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spendlens.llm import textfeat
from spendlens.llm.shared import checkpointed

N_BITS = 17
ORDERS = (4, 5, 6)
THRESHOLD = 0.7
#: Bytes of a text that are hashed at once; cuts fall between words.
PIECE = 1 << 18
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _BASE, dtype=np.uint64), dtype=np.uint64)


def learnable(doc_id: Column) -> Column:
    """Rows the model may learn from: a known id whose crc32 remainder by 3 is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the decimal doc_id leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters(data: bytes) -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all bytes beyond ASCII."""
    b = np.frombuffer(data, dtype=np.uint8)
    return (b >= 128) | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` cut between words; one word of more than ``size`` bytes stays whole."""
    start = 0
    while len(data) - start > size:
        borders = np.nonzero(~_letters(data[start:start + size]))[0]
        end = start + (int(borders[-1]) if len(borders) else size)
        while end == start or (not len(borders) and end < len(data) and _letters(data[end:end + 1])[0]):
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def _rows(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    return (((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - N_BITS)).astype(np.int64)


def subwords(data: bytes) -> np.ndarray:
    """Table rows of the words of lower-cased UTF-8 ``data`` and of their n-grams.

    A word is met with a border before and after it; its n-grams hold bytes of the word and no
    border but at their ends.  The word as a whole is one more row.
    """
    padded = b" " + data + b" "
    letter = _letters(padded)
    starts = np.nonzero(letter[1:] & ~letter[:-1])[0] + 1
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    b = np.where(letter, np.frombuffer(padded, dtype=np.uint8), 32).astype(np.uint64)
    at = np.arange(len(b))
    place = at - np.maximum.accumulate(np.where(letter & ~np.append(False, letter[:-1]), at, 0))
    whole = np.where(letter, b * _POWERS[place % 64], np.uint64(0))
    out = [_rows(np.add.reduceat(whole, starts), 1)]
    borders = np.concatenate([[0], np.cumsum(~letter)])
    for n in ORDERS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        i = np.nonzero(borders[n - 1:n - 1 + m] == borders[1:1 + m])[0]
        h = np.zeros(len(i), dtype=np.uint64)
        for k in range(n):
            h += b[i + k] * _POWERS[k]
        out.append(_rows(h, n))
    return np.concatenate(out)


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8")


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a whole text in order, and the share of each; null is empty."""
    n = np.zeros(1 << N_BITS)
    for p in pieces(prepared(text)):
        n += np.bincount(subwords(p), minlength=len(n))
    rows = np.nonzero(n)[0]
    return rows, n[rows] / max(1.0, n.sum())


@dataclass
class Model:
    """``table`` row x dimension, ``classes`` dimension x class, ``bias`` by class."""
    table: np.ndarray
    classes: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Margin of class 1 over class 0 by table row, and its bias."""
        return self.table @ (self.classes[:, 1] - self.classes[:, 0]), float(self.bias[1] - self.bias[0])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_bags(rows: list[np.ndarray], shares: list[np.ndarray], label: np.ndarray, dim: int = 16, steps: int = 80,
             rate: float = 0.1, strength: float = 5e-4, seed: int = 5) -> Model:
    """Table and softmax that minimise the cross entropy of the bags, classes weighing alike.

    Adam on the whole sample.  Table rows that less than a 300th of the sample holds, or one text
    only, are left at zero.  A mean is over hundreds of subwords of which few matter, so inside the
    fit it is scaled by the root of the table's size.
    """
    rng, n, size = np.random.default_rng(seed), len(label), 1 << N_BITS
    held = np.bincount(np.concatenate(rows), minlength=size) >= max(2, n // 300)
    place = np.cumsum(held) - 1
    blocks = []                                     # of 256 texts: owners, places and weights of their subwords
    for s in range(0, n, 256):
        some = [held[r] for r in rows[s:s + 256]]
        blocks.append((np.repeat(np.arange(s, s + len(some), dtype=np.int32), [k.sum() for k in some]),
                       np.concatenate([place[r[k]] for r, k in zip(rows[s:s + 256], some)]).astype(np.int32),
                       np.concatenate([w[k] for w, k in zip(shares[s:s + 256], some)]).astype(np.float32) * np.float32(np.sqrt(size))))
    n_rows = int(held.sum())
    want = np.eye(2)[label]
    importance = (0.5 / np.maximum(1, want.sum(axis=0)))[label][:, None]
    params = [rng.normal(0, 1 / dim, (n_rows, dim)), rng.normal(0, 1 / np.sqrt(dim), (dim, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        table, classes, bias = params
        folded, z, pull = table @ classes, np.tile(bias, (n, 1)), np.zeros((n_rows, 2))
        for owner, at, weight in blocks:
            a, b = (int(owner[0]), int(owner[-1]) + 1) if len(owner) else (0, 0)
            for c in range(2):
                z[a:b, c] += np.bincount(owner - a, weight * folded[at, c], minlength=b - a)
        miss = (softmax(z) - want) * importance
        for owner, at, weight in blocks:
            for c in range(2):
                pull[:, c] += np.bincount(at, weight * miss[owner, c], minlength=n_rows)
        grads = [pull @ classes.T + strength * table, table.T @ pull + strength * classes, miss.sum(axis=0)]
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - pace * first[k] / (1 - 0.9 ** t) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    table = np.zeros((size, dim))
    table[held] = params[0] * np.sqrt(size)
    return Model(table, params[1], params[2])


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000) -> Model | None:
    """A model from at most ``most`` labelled texts of either class among the learnable rows.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic; null labels teach nothing, and an id
    with both labels teaches both.  The sample is the first ids by a hash.  Bags of its whole texts
    are made on the executors; only they come to the driver.  None unless both classes occur.
    """
    ids = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    ids = checkpointed(ids.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    chosen = textfeat.sample(ids.where("label = 0"), most).unionByName(textfeat.sample(ids.where("label = 1"), most))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [bag(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r.astype(np.int32).tobytes() for r, _ in bags], pa.binary()),
                                              pa.array([w.astype(np.float32).tobytes() for _, w in bags], pa.binary())], ["label", "rows", "shares"])

    got = texts.mapInArrow(run, "label int, rows binary, shares binary").toArrow()
    found = sorted(zip(*(got.column(c).to_pylist() for c in ("label", "rows", "shares"))))      # rows arrive in any order
    label = np.array([x[0] for x in found], dtype=np.int64)
    if not (label == 0).any() or not (label == 1).any():
        return None
    return fit_bags([np.frombuffer(x[1], np.int32) for x in found], [np.frombuffer(x[2], np.float32) for x in found], label)


def margin(text: str | None, weights: np.ndarray, bias: float) -> float:
    """Margin of class 1: the mean of the weights of a whole text's subwords, plus the bias."""
    total, n = 0.0, 0
    for p in pieces(prepared(text)):
        rows = subwords(p)
        total, n = total + float(weights[rows].sum()), n + len(rows)
    return total / max(1, n) + bias


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)``: how likely each whole text is toxic.

    Null and empty texts, and texts without a word, are scored by the bias alone; without a model
    every score is 0.5.  Rows stay apart whatever their ids; other columns of ``docs`` are ignored,
    and an empty table gives no rows.  The weights that travel with the tasks have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.folded() if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            z = np.array([margin(t.as_py(), *held) for t in b.column("text")] if held else [0.0] * b.num_rows, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
