"""Vector columns: unit length, sparse clean-up, dot product of one row's two vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelgrid.functions.text import let


def norm2(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(c: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is."""
    wide = F.transform(c, lambda x: x.cast("double"))
    return let(norm2(c), lambda n: F.transform(wide, lambda x: F.when(n > 0, x / n).otherwise(x)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def clean_sparse(c: Column) -> Column:
    """Entries of a term map without zeros, ordered by index."""
    kept = F.map_filter(c, lambda _, w: w != 0)
    return F.array_sort(F.map_entries(kept))
