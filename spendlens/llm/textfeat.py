"""Hashed byte n-gram features of whole texts, for linear models trained on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ORDERS = (2, 3)
#: Odd multipliers that spread n-gram codes over the buckets, one per order.
SPREAD = {2: 0x9E3779B1, 3: 0x85EBCA6B}


def grams(buffer: bytes, n_bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte n-grams of ``buffer`` for each order, by position."""
    b = np.frombuffer(buffer, dtype=np.uint8).astype(np.uint32)
    for order in ORDERS:
        m = len(b) - order + 1
        if m <= 0:
            yield np.zeros(0, dtype=np.uint32)
            continue
        code = b[:m].copy()
        for k in range(1, order):
            code = (code << np.uint32(8)) | b[k:m + k]
        yield ((code + np.uint32(1)) * np.uint32(SPREAD[order])) >> np.uint32(32 - n_bits)


def pieces(data: bytes, size: int = 1 << 19) -> Iterator[bytes]:
    """A text in pieces that overlap so that every n-gram lies whole in exactly one."""
    keep = max(ORDERS) - 1
    if len(data) <= size:
        yield data
        return
    for i in range(0, len(data) - keep, size):
        yield data[i:i + size + keep]


def shares(data: bytes, n_bits: int) -> np.ndarray:
    """Share of each bucket among the n-grams of a text (zeros for a text without any)."""
    out = np.zeros(1 << n_bits)
    for p in pieces(data):
        # Shorter orders would count the overlap twice but for the cut to the longest one's positions.
        m = max(0, len(p) - max(ORDERS) + 1)
        for g in grams(p, n_bits):
            out += np.bincount(g[:m], minlength=len(out))
    return out / max(1.0, out.sum())


def scores(data: bytes, weights: np.ndarray, n_bits: int) -> np.ndarray:
    """``shares(data) @ weights`` without building the shares of long tables."""
    out, n = np.zeros(weights.shape[1]), 0
    for p in pieces(data):
        m = max(0, len(p) - max(ORDERS) + 1)
        for g in grams(p, n_bits):
            g = g[:m]
            out += np.bincount(g, minlength=len(weights)) @ weights if m > len(weights) else weights[g].sum(axis=0)
            n += len(g)
    return out / max(1, n)


def sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``ids``, the first by a hash of their ``doc_id``.

    Every task keeps its own first rows, so no more than ``most`` of each meet in one place.  The
    result has a proven size and may be broadcast.
    """
    return ids.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)


def collect_features(rows: DataFrame, features, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Labels and feature vectors of a bounded sample ``rows(text, label)`` for fitting on the driver.

    ``features`` maps a text to a vector; it runs on the executors, and whole texts stay there.
    """
    kind = "string" if dict(rows.dtypes)[label] == "string" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, type=pa.binary())], names=["label", "x"])

    table = rows.select("text", F.col(label).cast(kind).alias("label")).mapInArrow(run, f"label {kind}, x binary").toArrow()
    labels = np.array(table.column("label").to_pylist(), dtype=object if kind == "string" else float)
    raw = table.column("x").to_pylist()
    order = sorted(range(len(raw)), key=lambda i: (str(labels[i]), raw[i]))     # rows arrive in any order
    x = np.stack([np.frombuffer(raw[i], dtype=np.float32) for i in order]) if raw else np.zeros((0, 0), np.float32)
    return labels[order], x


def doc_frame(doc_id: pd.Series, **columns) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc_id.astype("Int64")} | columns)
