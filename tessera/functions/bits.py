"""64-bit perceptual hashes kept as the raw bits of a long."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def median_hash(values: Column) -> Column:
    """Bits ``value > median``, first value in the highest bit, of an array of 64 doubles; the median of an even count is the middle two's mean."""
    ordered = F.array_sort(values)
    median = (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2
    return F.aggregate(values, F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR((v > median).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(h: Column, distance: int) -> Column:
    """``distance + 1`` bands as (number, key): hashes no further apart agree in one of them at least."""
    count = distance + 1
    edges = [64 * k // count for k in range(count + 1)]
    parts = []
    for k in range(count):
        width = edges[k + 1] - edges[k]
        mask = -1 if width == 64 else (1 << width) - 1
        parts.append(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*parts)


def _bytes_of(value: Column, width: int = 4) -> Column:
    """Hexadecimal digits of a 32-bit number, its lowest byte first."""
    digits = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 8 * width))), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])


def pack_int32(values: Column) -> Column:
    """Little-endian 32-bit numbers as one binary value."""
    return F.unhex(F.array_join(F.transform(values, lambda x: _bytes_of(x)), ""))


def unpack_int32(blob: Column) -> Column:
    """The numbers of such a value; a length that is no multiple of 4 is an error."""
    digits = F.hex(blob)
    one = lambda k: F.conv(F.concat(*[F.substring(digits, k * 8 + 2 * b + 1, 2) for b in (3, 2, 1, 0)]), 16, 10).cast("long")
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int")
    count = F.length(blob) / 4
    whole = F.when(F.length(blob) % 4 == 0, count.cast("int")).otherwise(F.raise_error(F.lit("a blob has not whole numbers")).cast("int"))
    return F.when(whole == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), whole - 1), lambda k: signed(one(k))))
