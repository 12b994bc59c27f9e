"""Expressions on pixel arrays (row-major ARRAY<INT>) and checksums."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from framewell.functions.boxes import idiv

ADLER_MOD = 65521


def count_where(luma: Column, test) -> Column:
    """Number of pixels that pass a test."""
    one, none = F.lit(1), F.lit(0)
    return F.aggregate(luma, none, lambda s, x: s + F.when(test(x), one).otherwise(none))


def total(luma: Column) -> Column:
    return F.aggregate(luma, F.lit(0).cast("long"), lambda s, x: s + x)


def total_squares(luma: Column) -> Column:
    return F.aggregate(luma, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)


@F.pandas_udf(ArrayType(StructType().add("value", "integer").add("n", "long")))
def level_counts(planes: pd.Series) -> pd.Series:
    """Values of a plane with their number of pixels, in order of value; null for a null plane."""

    def one(plane) -> list[dict] | None:
        if plane is None:
            return None
        values, counts = np.unique(np.asarray(plane), return_counts=True)
        return [{"value": v, "n": n} for v, n in zip(values.tolist(), counts.tolist())]

    return planes.map(one)


@F.pandas_udf(BinaryType())
def level_vector(planes: pd.Series) -> pd.Series:
    """Number of pixels of each value from 0 to 255, as 256 little-endian 32-bit integers."""
    sizes = np.array([0 if p is None else len(p) for p in planes])
    values = np.concatenate([np.zeros(0, dtype=np.int64), *(p for p in planes if p is not None)]).astype(np.int64)
    place = np.repeat(np.arange(sizes.size), sizes) * 256 + values
    counts = np.bincount(place, minlength=256 * sizes.size).astype("<u4").reshape(-1, 256)
    return pd.Series([row.tobytes() for row in counts], dtype=object)


def row_arrays(luma: Column, width: int, height: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(luma, r * width + 1, F.lit(width)))


def column_sums(luma: Column, width: int, height: int) -> Column:
    zeros = F.array_repeat(F.lit(0).cast("long"), width)
    return F.aggregate(row_arrays(luma, width, height), zeros, lambda s, r: F.zip_with(s, r, lambda a, b: a + b))


def row_sums(luma: Column, width: int, height: int) -> Column:
    return F.transform(row_arrays(luma, width, height), total)


def adler32(values: Column) -> Column:
    """Adler-32 of an array of byte values, both sums started at 0, as eight hexadecimal digits.

    The second sum counts the first byte once per byte of the array, the next once less, and so on.
    """
    n = F.size(values)
    low = F.pmod(total(values), F.lit(ADLER_MOD))
    weighted = F.transform(values, lambda x, i: x.cast("long") * (n - i))
    high = F.pmod(total(weighted), F.lit(ADLER_MOD))
    return F.lpad(F.hex(high * 65536 + low), 8, "0")


@F.pandas_udf(StringType())
def adler32_bytes(data: pd.Series) -> pd.Series:
    """Adler-32 of binary data with both sums started at 0."""
    return data.map(lambda b: None if b is None else f"{zlib.adler32(b, 0):08X}")


def pcm_bytes(samples: Column) -> Column:
    """16-bit samples as an array of byte values, low byte first."""
    return F.flatten(
        F.transform(samples, lambda s: F.array(s.bitwiseAND(255), F.shiftright(s, 8).bitwiseAND(255)))
    )


def digits(luma: Column) -> Column:
    """Pixel values as a binary string of one byte each."""
    return F.unhex(F.array_join(F.transform(luma, lambda y: F.lpad(F.hex(y), 2, "0")), ""))


def kth_smallest(values: Column, k: Column) -> Column:
    """The k-th smallest value, k from 1; 0 for k = 0."""
    return F.when(k < 1, F.lit(0)).otherwise(F.get(F.sort_array(values), k - 1))


def share_position(n: Column, percent: int) -> Column:
    """n * percent / 100 rounded to the nearest whole number, halves to even."""
    return F.rint(n * F.lit(percent) / F.lit(100.0)).cast("int")


def even_up(v: Column) -> Column:
    return (v + 1).bitwiseAND(-2)


def half(v: Column) -> Column:
    return idiv(v, 2)
