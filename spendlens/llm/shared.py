"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spendlens.session import checkpointed, ensure_checkpoint_dir as shared_folder

__all__ = ["SEPARATORS", "checkpointed", "held_out", "learnable", "named", "packed", "shared_folder", "words"]

#: Word separators of the digest contracts: space and the ASCII controls tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def named(column: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(columns: list[str]) -> Column:
    """A struct of the caller's columns, in which no name can meet one of an operator's own; fields by ``getField``."""
    return F.struct(*[named(c) for c in columns])


def words(text: Column) -> Column:
    """Maximal runs of non-separator characters of ``text`` in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the decimal doc_id is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from: a known id whose crc32 remainder by 5 is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))
