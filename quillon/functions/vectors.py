"""Vector and sequence expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least norm that a vector is divided by.
EPS = 1e-12


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2(x: Column) -> Column:
    """Unit vector; vectors shorter than EPS are divided by EPS."""
    return F.transform(x, lambda v: v / F.greatest(norm(x), F.lit(EPS)))


def resize(x: Column, dim: int) -> Column:
    """The first ``dim`` places, zeros where there are fewer."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def middle(x: Column, y: Column) -> Column:
    """Mean of two unit vectors."""
    return F.zip_with(l2(x), l2(y), lambda a, b: (a + b) / 2)


def weighted(x: Column, w: float) -> Column:
    return F.transform(l2(x), lambda v: v * F.lit(w))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (F.greatest(norm(x), F.lit(EPS)) * F.greatest(norm(y), F.lit(EPS)))


def common_prefix(x: Column, y: Column) -> Column:
    """Places in which two code lists agree before they first differ."""
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    step = lambda s, same: F.struct((s["on"] & same).alias("on"), (s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False))), start, step, lambda s: s["n"])


def code_text(codes: Column) -> Column:
    return F.array_join(codes.cast("array<string>"), "-")


def offset_codes(codes: Column, sizes: list[int]) -> Column:
    """Tokens that differ between positions: each code plus the sizes of the positions before."""
    codes = F.when(F.size(codes) == len(sizes), codes).otherwise(F.raise_error(F.concat(F.lit(f"codes of {len(sizes)} positions are wanted, not "), F.size(codes).cast("string"))).cast("array<int>"))
    offsets = F.array(*[F.lit(sum(sizes[:i])) for i in range(len(sizes))])
    return F.zip_with(codes, offsets, lambda c, o: c + o)


def tail(x: Column, n: int) -> Column:
    """The last n places; all if n is 0 or less."""
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n)) if n > 0 else x


def padded(x: Column, n: int, filler: int) -> Column:
    """The last n places with fillers before them up to n."""
    last = tail(x, n)
    return F.concat(F.array_repeat(F.lit(filler).cast("long"), F.lit(n) - F.size(last)), last.cast("array<long>"))
