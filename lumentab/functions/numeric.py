"""Column helpers for pixel and tensor arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(col: Column | str) -> Column:
    """Round to six places; the sum with 0.0 drops negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, 6) + F.lit(0.0)


def saturate(col: Column) -> Column:
    """Round half to even and clamp to the uint8 range."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(col))).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(
        num.cast("double") / F.when(den == 0, F.lit(1.0)).otherwise(den.cast("double"))
    )


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def relu(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0))


def hash_uniform(seed: int | str, *parts: Column | str) -> Column:
    """Reproducible uniform number in [0, 1) from 40 bits of an md5 digest.

    The value depends only on the seed and the row's own keys, so a recomputed
    partition yields the same numbers.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equally long numeric arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def literal_array(values, kind: str = "double") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also when body loops over an array.

    A column used inside a lambda is otherwise evaluated again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
