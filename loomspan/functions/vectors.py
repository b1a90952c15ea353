"""Vector arithmetic over arrays, in double precision, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Widths up to which a vector is indexed whole, and as half precision.
FULL_WIDTH, HALF_WIDTH = 2000, 4000


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def distance(kind: str, a: Column, b: Column) -> Column:
    """cosine distance, l2, or the negated inner product: smaller is nearer."""
    if kind not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown distance {kind!r}; choose one of cosine, l2, ip")
    return {"cosine": lambda: 1 - cosine(a, b), "l2": lambda: l2(a, b), "ip": lambda: -dot(a, b)}[kind]()


def usable(v: Column, width: int) -> Column:
    """Of this width, without null, NaN or infinity, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == width) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def normalized(v: Column) -> Column:
    size = norm(v)
    return F.when(size > 0, F.transform(doubles(v), lambda x: x / size)).otherwise(doubles(v))


def truncated(v: Column, width: int) -> Column:
    """The first components, scaled to length 1 again; vectors of exactly this width stay as they are."""
    return F.when(F.size(v) == width, doubles(v)).when(F.size(v) > width, normalized(F.slice(v, 1, width)))


def signs(v: Column, width: int) -> Column:
    """Binary quantisation: one bit a component (set where positive), packed into words of 32."""
    words = []
    for w in range(math.ceil(width / 32)):
        part = F.slice(v, 32 * w + 1, 32)
        words.append(F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("int"), lambda s, x: s + x)


def tight_radius(n: Column, threshold: float) -> Column:
    """Mean distance to the centroid of n members whose pairs are all at the threshold."""
    return 1 - F.sqrt((1 + (n - 1) * threshold) / n)


def needs_model(radius: Column, n: Column, threshold: float) -> Column:
    """Whether a group is loose enough for a model to confirm it: its farthest member lies beyond the tight radius."""
    return F.lit(True) if threshold >= 1 else radius > tight_radius(n, threshold)


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, n, mean``: the normalised mean of each group's vectors.

    Components are averaged in parallel (group, position), so no task holds a group. Members without a vector are
    left out; ``records.complete_means`` gives means of groups that lack none.
    """
    parts = df.select(group, F.posexplode(doubles(F.col(vector))).alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(group, "n", normalized(F.col("mean")).alias("mean"))


def plan_storage(width: int, shortens: bool) -> tuple[int, str, str]:
    """Stored width, storage and index kind of a model's vectors."""
    if width <= 0:
        raise ValueError("width must be positive")
    if width <= FULL_WIDTH:
        return width, "vector", "whole"
    if width <= HALF_WIDTH:
        return width, "half", "whole"
    return (HALF_WIDTH, "half", "whole") if shortens else (width, "vector", "binary")
