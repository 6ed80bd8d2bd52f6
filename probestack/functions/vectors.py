"""Array arithmetic on columns. Vectors are arrays of float or double; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def part(v: Column | str, layer: Column | int, width: int) -> Column:
    """The layer-th run of width components (layers from 0)."""
    at = F.lit(layer) if isinstance(layer, int) else layer
    return F.slice(_col(v), at * width + 1, width)


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))


def dense(m: Column, keys: list[str]) -> Column:
    """Values of a map in the order of keys, 0 where one is missing."""
    return F.array(*[F.coalesce(F.try_element_at(m, F.lit(k)).cast("double"), F.lit(0.0)) for k in keys])


def let(value: Column, body) -> Column:
    """body of value, computed once: inside a lambda an expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def standardised(v: Column | str, epsilon: float = 1e-5) -> Column:
    """(x - mean) / sqrt(variance + epsilon) over one vector."""
    d = as_double(v)
    centred = let(total(d) / F.size(d), lambda mean: F.transform(d, lambda x: x - mean))
    return let(centred, lambda c: let(F.sqrt(dot(c, c) / F.size(c) + epsilon), lambda s: F.transform(c, lambda x: x / s)))
