"""Vector arithmetic on ARRAY columns, in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(as_double(vector), F.lit(0.0), lambda total, x: total + x * x)
    )


def l2_normalize(vector: Column) -> Column:
    """Vector divided by its length; a zero vector is left as it is."""
    length = norm(vector)
    safe = F.when(length > 0, length).otherwise(F.lit(1.0))
    # The length is computed once per row: it enters the lambda as a field, not as an expression.
    packed = F.array(F.struct(as_double(vector).alias("v"), safe.alias("s")))
    unit = F.transform(packed, lambda p: F.transform(p["v"], lambda x: x / p["s"]))
    return unit[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, inner_product(a, b) / lengths).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)
