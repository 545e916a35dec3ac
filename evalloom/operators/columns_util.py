"""Small array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_without(array: Column, index: int) -> Column:
    """The array less the element at a zero-based index."""
    return F.concat(F.slice(array, 1, index) if index else F.slice(array, 1, 0), F.slice(array, F.lit(index + 2), F.greatest(F.size(array) - (index + 1), F.lit(0))))
