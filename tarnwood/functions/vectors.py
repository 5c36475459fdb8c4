"""Vectors as ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where the lengths differ."""
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero or the lengths differ."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


def constant(values: list[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(x)) for x in values])


def parse_vector(text: Column) -> Column:
    """``'[1,2,3]'`` to a vector; quotes and brackets may be missing, anything else is null."""
    bare = F.regexp_replace(F.trim(text), r"^['\"]?\[?|\]?['\"]?$", "")
    return F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<float>")


def format_vector(v: Column) -> Column:
    """A vector as ``'[1,2.5]'``: whole numbers without a decimal point."""
    shown = F.transform(v, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", ""))
    return F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))


def mean_vector(rows, key: str, vector: str = "embedding"):
    """Element-wise mean of each key's vectors, not normalised again: (``key``, ``embedding``)."""
    spread = rows.select(key, F.posexplode(vector).alias("place", "value"))
    means = spread.groupBy(key, "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    gathered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("all"))
    return gathered.select(key, F.transform("all", lambda x: x["value"]).alias("embedding"))
