"""Numbers as bytes: unsigned, of 4 or 8 bytes, the greatest byte first (network order) or the least."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.tokens import once

_WIDE = "decimal(20,0)"


def from_big_endian(value: Column) -> Column:
    """The unsigned number that 4 or 8 bytes are, as a decimal of 20 digits; an error for any other length, null for null."""
    size = F.octet_length(value)
    checked = F.when(size.isin(4, 8) | value.isNull(), F.hex(value)).otherwise(F.raise_error(F.concat(F.lit("a number of as many bytes: "), size.cast("string"))))
    return F.conv(checked, 16, 10).cast(_WIDE)


def to_big_endian(number: Column, size: int = 8) -> Column:
    """The lowest ``size`` bytes of a whole number, the greatest first."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("bigint")), 16, "0"), F.lit(2 * size)))


def reverse_bytes(value: Column) -> Column:
    """The bytes in the other order."""
    pairs = once(F.hex(value), lambda digits: F.transform(F.sequence(F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(1), F.lit(-2)), lambda i: F.substring(digits, i, F.lit(2))))
    return F.when(F.octet_length(value) > 0, F.unhex(F.array_join(pairs, ""))).otherwise(value)


def wrapping_sum(number: Column) -> Column:
    """The sum of unsigned 64-bit numbers as such a number: beyond 2^64 it begins anew."""
    return F.pmod(F.sum(number.cast("decimal(20,0)")), F.lit(Decimal(1 << 64))).cast(_WIDE)
