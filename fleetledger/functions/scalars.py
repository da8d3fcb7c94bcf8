"""Scalar helpers: digests and fields of JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    """Lower-case hex; null stays null."""
    return F.sha2(content.cast("binary"), 256)


def json_field(document: Column, path: str) -> Column:
    """The field at a JSON path such as $.a.b as a string; null if the document is broken or lacks it."""
    return F.get_json_object(document, path)
