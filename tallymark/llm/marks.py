"""A set of 64-bit values as a bit field of fixed size, made in Spark and sent to tasks.

The field says "no" only of values that are not in the set. Its size does not
depend on the data: the driver gets ``bits`` / 8 bytes, whatever the table holds.
Where the field is too full to tell values apart, tasks pass on more rows, and
the exact join behind it does more work, but results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

PAGE = 32768  # bits in one bitmap of Spark's bitmap functions


def bit_field(values: DataFrame, column: str, bits: int = 1 << 26) -> np.ndarray:
    """Bit ``v mod bits`` is set for each value v of ``column``."""
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    pages = (
        values.groupBy(F.bitmap_bucket_number(place).alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        .collect()  # at most bits / PAGE rows
    )
    field = np.zeros(bits // 8, np.uint8)
    for page, bitmap in pages:
        field[(page - 1) * (PAGE // 8) : page * (PAGE // 8)] = np.frombuffer(bitmap, np.uint8)
    return field


def field_bits(values: int) -> int:
    """Places of a bit field for so many values: 8 to 32 MB."""
    return min(max(1 << 26, 1 << (8 * values).bit_length()), 1 << 28)


def may_hold(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit ``values`` may be in the set."""
    place = values & np.uint64(field.size * 8 - 1)
    return (field[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
