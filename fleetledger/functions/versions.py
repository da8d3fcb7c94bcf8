"""Versions as arrays of numbers, which Spark compares element by element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """'1.10.2' to [1,10,2]. A part that is no number of 64 bits is null in the key: see parsed(). A null version has a null key."""
    # a pattern that Java splits by without a regular expression; the array is cast as one, in compiled code
    return F.split(version, r"\.").try_cast("array<bigint>")


def parsed(key: Column) -> Column:
    """False for keys with a part that is no number; such versions have no place in the order."""
    return ~F.exists(key, lambda x: x.isNull())
