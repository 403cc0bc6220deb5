"""Vector functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def stub_vector(text: Column, dim: int) -> Column:
    """A deterministic vector of a text: the bytes of its digest over 127.5, less 1, repeated to the length."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
