"""Unsigned 64-bit arithmetic on BIGINT columns: the same bits, read as two's complement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
SIGN = -(1 << 63)
#: Seeds of the two hash families.
BLOOM_SEED, MINHASH_SEED = 0x83984A98FD448A39, 0xEA59F2718F8069A6
#: The finalizer's shifts and multipliers.
FINALIZER = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))


def signed(value: int) -> int:
    value &= MASK
    return value - (1 << 64) if value >> 63 else value


def mix64_int(value: int) -> int:
    value &= MASK
    for shift, factor in FINALIZER:
        value ^= value >> shift
        value = value * (factor or 1) & MASK
    return value


def family_int(value: int, seed: int, i: int) -> int:
    return mix64_int(value ^ mix64_int(seed ^ i))


def seeds(seed: int, n: int) -> list[int]:
    """Constants of the first ``n`` functions of a family, as signed longs."""
    return [signed(mix64_int(seed ^ i)) for i in range(n)]


def lit(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def multiply(x: Column, factor: int) -> Column:
    """``x * factor`` modulo 2**64.  The factor is cut into 16-bit limbs, so no product overflows."""
    c = [factor >> 16 * k & 0xFFFF for k in range(4)]
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)

    def part(v: Column, k: int) -> Column:
        return F.shiftleft((v * F.lit(c[k])).bitwiseAND(F.lit(0xFFFF)), 16)

    bottom = low * F.lit(c[0]) + part(low, 1)
    top = F.shiftrightunsigned(bottom, 32) + F.shiftrightunsigned(low * F.lit(c[1]), 16) + high * F.lit(c[0]) + low * F.lit(c[2]) + part(low, 3) + part(high, 1)
    return F.shiftleft(top.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(bottom.bitwiseAND(F.lit(0xFFFFFFFF)))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _folded(shift: int) -> Callable[[Column], Column]:
    return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift))


def _times(factor: int) -> Callable[[Column], Column]:
    return lambda v: multiply(v, factor)


def mix64(x: Column) -> Column:
    for shift, factor in FINALIZER:
        x = _bound(x, _folded(shift))
        x = _bound(x, _times(factor)) if factor else x
    return x


def mixed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``mix64`` of the column ``name`` in its place.

    A projection for each step keeps the expression small, so all of it is compiled: this is the form for
    many rows.
    """
    for shift, factor in FINALIZER:
        x = F.col(name)
        df = df.withColumn(name, x.bitwiseXOR(F.shiftrightunsigned(x, shift)))
        df = df.withColumn(name, multiply(x, factor)) if factor else df
    return df


def modulo(x: Column, n: int) -> Column:
    """Unsigned remainder."""
    return (F.shiftrightunsigned(x, 1) % F.lit(n) * F.lit(2) + x.bitwiseAND(F.lit(1))) % F.lit(n)


def ordered(x: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of ``x``; its own inverse."""
    return x.bitwiseXOR(F.lit(SIGN).cast("long"))


def hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def from_hex16(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def bit_length(x: Column) -> Column:
    """Bits of a non-negative number; 0 of zero."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))
