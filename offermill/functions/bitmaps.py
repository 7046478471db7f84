"""Single bits of the bitmaps that ``bitmap_construct_agg`` makes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_bit(bitmap: Column, number: Column) -> Column:
    """Whether the bit of a number is set in the bitmap of its bucket."""
    at = F.bitmap_bit_position(number)
    byte = F.ascii(F.decode(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1
