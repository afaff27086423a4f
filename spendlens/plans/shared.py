"""Intermediates that many queries branch from (the dense grid, weekly frames,
tuned thresholds) are computed once per session and data folder.

Frames are persisted MEMORY_AND_DISK: a lost executor recomputes its partitions
from lineage, so the cache never changes results.
"""

from __future__ import annotations

from pyspark import StorageLevel

_MEMO: dict = {}


def _key(spark, name, sf_dir):
    return (spark.sparkContext.applicationId, name, sf_dir)


def frame(spark, name: str, sf_dir: str, build):
    k = _key(spark, name, sf_dir)
    if k not in _MEMO:
        _MEMO[k] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _MEMO[k]


def value(spark, name: str, sf_dir: str, build):
    k = _key(spark, name, sf_dir)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def clear(keep_models: bool = False) -> None:
    """Drop memoised intermediates; ``keep_models`` keeps fitted models (saved artefacts)."""
    for k in list(_MEMO):
        if keep_models and k[1].startswith("model_"):
            continue
        v = _MEMO.pop(k)
        if hasattr(v, "unpersist"):
            try:
                v.unpersist()
            except Exception:  # noqa: BLE001
                pass
