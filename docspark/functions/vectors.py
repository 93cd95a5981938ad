"""Vector arithmetic on array<float> columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 where sizes differ or either vector is (nearly) zero."""
    na, nb = squared_norm(a), squared_norm(b)
    return F.when((F.size(a) != F.size(b)) | (na <= TINY) | (nb <= TINY), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(na) / F.sqrt(nb))
