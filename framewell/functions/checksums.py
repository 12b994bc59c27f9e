"""Checksums of a concatenation from those of its parts and the number of bytes after each part."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from framewell.functions.pixels import adler32_bytes

#: The modulus of Adler-32 and the reflected polynomial of CRC-32.
ADLER_BASE, CRC_POLYNOMIAL = 65521, 0xEDB88320


def _times(images: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of the single bits, applied to all values."""
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where((crc >> np.uint32(bit)) & np.uint32(1), images[bit], np.uint32(0))
    return out


@functools.cache
def _zero_bytes() -> list[np.ndarray]:
    """The maps that 1, 2, 4, 8 ... zero bytes after a text do to its CRC-32, each the one before taken twice."""
    images = np.array([CRC_POLYNOMIAL, *(1 << b for b in range(31))], dtype=np.uint32)  # one zero bit
    for _ in range(3):
        images = _times(images, images)
    maps = [images]
    for _ in range(62):
        maps.append(_times(maps[-1], maps[-1]))
    return maps


@F.pandas_udf(LongType())
def crc32_before(crc: pd.Series, after: pd.Series) -> pd.Series:
    """What a part with this CRC-32 adds to that of the whole, by exclusive or, with ``after`` bytes behind it."""
    out, rest = crc.to_numpy().astype(np.uint32), after.to_numpy().astype(np.int64)
    for images in _zero_bytes():
        if not rest.any():
            break
        odd = np.flatnonzero(rest & 1)
        out[odd] = _times(images, out[odd])
        rest = rest >> 1
    return pd.Series(out.astype(np.int64))


def adler_sums(data: Column) -> tuple[Column, Column]:
    """Both sums of Adler-32 over the bytes of a part, from zero on: of the bytes, and of these sums."""
    digits = adler32_bytes(data)
    return tuple(F.conv(F.substring(digits, start, 4), 16, 10).cast("long") for start in (5, 1))


def adler_before(first: Column, second: Column, after: Column) -> Column:
    """What a part adds to the second sum of the whole."""
    return (second + after % ADLER_BASE * first) % ADLER_BASE
