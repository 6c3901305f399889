"""Hash bits, Hamming distance and hex forms of 64-bit image hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lumentab.functions.numeric import let


def median(values: Column) -> Column:
    """Median of a numeric array: mean of the two middle values when even."""
    return let(
        F.sort_array(values),
        lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2,
    )


def fold_bits(bits: Column) -> Column:
    """Pack an array of booleans into a signed 64-bit number, first bit highest."""
    return F.aggregate(
        bits,
        F.lit(0).cast("bigint"),
        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
    )


def coefficient_bits(values: Column) -> Column:
    """Bit per coefficient: greater than the median of all but the first."""
    return let(
        median(F.slice(values, 2, F.size(values) - 1)),
        lambda m: fold_bits(F.transform(values, lambda v: v > m)),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def from_hex16(text: Column) -> Column:
    """Signed 64-bit number of a 16-digit hex text."""
    high = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(text, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)
