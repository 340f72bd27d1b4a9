"""Hash expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FNV-1 64-bit offset basis (as a signed long) and the low part of its prime 2^40 + 435.
FNV_OFFSET = -3750763034362895579
FNV_LOW = 435
MASK32 = 0xFFFFFFFF


def byte_array(text: Column) -> Column:
    """The UTF-8 bytes of a string as integers."""
    hexed = F.hex(F.encode(text, "utf-8"))
    return F.transform(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))


def fnv1_64(text: Column) -> Column:
    """FNV-1: multiply, then xor. Done in 32-bit halves, so that ANSI overflow checks never fire."""

    def step(h: Column, b: Column) -> Column:
        low, high = h.bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(h, 32)
        product = low * FNV_LOW
        carry = (high * FNV_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(MASK32))
        return F.shiftleft(carry, 32).bitwiseOR(product.bitwiseAND(F.lit(MASK32))).bitwiseXOR(b)

    return F.aggregate(byte_array(text), F.lit(FNV_OFFSET).cast("long"), step)


def seeded_md5(text: Column, seed: int | Column) -> Column:
    """Unsigned 64-bit hash as DECIMAL(20,0): the first 8 bytes of md5(text followed by a 32-byte seed).

    The seed is its number as 4 big-endian bytes, then zeros."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    seed_hex = F.concat(F.lpad(F.hex(seed), 8, "0"), F.lit("00" * 28))
    digest = F.md5(F.concat(F.encode(text, "utf-8"), F.unhex(seed_hex)))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def seeded_position(text: Column, seed: int | Column, m: int) -> Column:
    return (seeded_md5(text, seed) % F.lit(m)).cast("long")
