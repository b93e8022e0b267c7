"""Pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_USER = "unknown"


def pseudonym(text: Column) -> Column:
    """Lowercase hex SHA-256; a missing value hashes like the word ``unknown``."""
    return F.sha2(F.coalesce(text, F.lit(MISSING_USER)), 256)
