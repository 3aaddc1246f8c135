"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.storage import SALTS, checkpointed, find_package, join_spread, quoted, shared_dir, shared_path, table, unused, written

__all__ = ["SALTS", "ascii_lower", "checkpointed", "find_package", "join_spread", "quoted", "shared_dir", "shared_path", "table", "unused", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take lower(), which is the same there and faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))
