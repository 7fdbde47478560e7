"""Scalar functions: text to values, natural order, bits, checksums, SQL parameters."""

from __future__ import annotations

import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def to_bool(c: Column) -> Column:
    """True for texts that start with y, t or 1."""
    return F.coalesce(c.rlike("^[yYtT1]"), F.lit(False))


def hex_to_uint32(c: Column) -> Column:
    """Hexadecimal digits (0x allowed) as a number; 0 for anything else and beyond 32 bits."""
    d = F.regexp_replace(c, "^0[xX]", "")
    return F.when(d.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(d, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def natural_key(c: Column) -> Column:
    """A text whose plain order is the natural one: case ignored, whole numbers and fractions by value, dotted versions part by part.

    Digits get their length in front, so longer numbers come later. A fraction's trailing zeros don't count where one dot only
    stands in the number. Numbers with a minus after anything but a letter or digit are ordered as written.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    plain = F.regexp_replace(low, r"(?<=\d),(?=\d)", "")
    # A number with a single dot has a fraction: its zeros at the end go, and it is kept apart from the whole part.
    trimmed = F.regexp_replace(plain, r"(?<![\d.])(\d*)\.(\d*?)0*(?![\d.])", "$1.$2")
    marked = F.regexp_replace(trimmed, r"(?<![\d.])(\d*)\.(\d+)(?![\d.])", "0$1\u0001$2\u0002")
    marked = F.regexp_replace(marked, "(?<![\\d.\u0001])(\\d+)\\.?(?![\\d.\u0001])", "$1\u0001\u0002")
    parts = F.regexp_extract_all(marked, F.lit("(\u0001\\d*\u0002|\\d+|[^\\d\u0001]+)"), 1)

    def key(p):
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


def read_bits(bits: Column, offset: int, count: int) -> Column:
    """count bits from offset on, first bit highest, of an array of byte values."""
    out = F.lit(0).cast("long")
    for i in range(offset, offset + count):
        byte = F.get(bits, F.lit(i // 8)).cast("long")
        out = F.shiftleft(out, 1) + F.shiftright(byte, 7 - i % 8).bitwiseAND(F.lit(1).cast("long"))
    return out


def sign_extended(v: Column, count: int) -> Column:
    return F.when(v >= (1 << (count - 1)), v - (1 << count)).otherwise(v)


def read_bits_signed(bits: Column, offset: int, count: int) -> Column:
    return sign_extended(read_bits(bits, offset, count), count)


def bytes_of(data: Column) -> Column:
    """Values 0 to 255 of a binary column."""
    h = F.hex(data)
    n = F.octet_length(data)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def crc16(data: Column, start: int = 0) -> Column:
    """CRC with the polynomial 0x1021, each row from the same start, from the highest bit of each byte on; null for null."""

    @F.pandas_udf("int")
    def crc(rows: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else binascii.crc_hqx(b, start) for b in rows], dtype="Int32")

    return crc(data.cast("binary"))


#: Base32 letters as Python's digits to the base of 32.
_BASE32 = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv")


def base32_bytes(text: str | None) -> list[int]:
    digits = "".join(c for c in (text or "").upper() if "A" <= c <= "Z" or "2" <= c <= "7").translate(_BASE32)
    n, over = divmod(5 * len(digits), 8)
    return list((int(digits, 32) >> over).to_bytes(n, "big")) if n else []


def from_base32(c: Column) -> Column:
    """Bytes of a Base32 text as an array of values; characters outside the alphabet are skipped, incomplete bytes dropped."""

    @F.pandas_udf("array<int>")
    def decoded(rows: pd.Series) -> pd.Series:
        return pd.Series([base32_bytes(x) for x in rows], dtype=object)

    return decoded(c)


def strip_decoration(c: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """Without the longest fitting prefix and suffix, once each, unless nothing would be left."""
    import re

    out = c
    for texts, pattern in ((prefixes, "^(?:{})(?=.)"), (suffixes, "(?<=.)(?:{})$")):
        if texts:
            alternatives = "|".join(re.escape(t) for t in sorted(texts, key=len, reverse=True))
            out = F.regexp_replace(out, pattern.format(alternatives), "")
    return out


def unique_name(name: str, taken: set[str]) -> str:
    """name, or name with the first of _2, _3... that isn't taken."""
    i, out = 2, name
    while out in taken:
        out, i = f"{name}_{i}", i + 1
    return out


def write_bits(bits: Column, offset: int, count: int, value: Column) -> Column:
    """An array of byte values with count bits from offset on, first bit highest, replaced by a whole number's lowest bits."""

    def byte(old: Column, j: Column) -> Column:
        out = old
        for k in range(offset // 8, (offset + count - 1) // 8 + 1):
            inside = [i for i in range(8 * k, 8 * k + 8) if offset <= i < offset + count]
            mask = sum(1 << (7 - i % 8) for i in inside)
            up = 7 - inside[-1] % 8  # how far the number's bits stand above the byte's lowest
            part = F.shiftleft(F.shiftright(value.cast("long"), offset + count - 1 - inside[-1]).bitwiseAND(F.lit((1 << len(inside)) - 1)), up)
            out = F.when(j == k, old.cast("long").bitwiseAND(F.lit(255 - mask)).bitwiseOR(part).cast("int")).otherwise(out)
        return out

    return F.transform(bits, byte) if count else bits


def linear(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The line through two points at x; y0 where both have the same place."""
    return F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (x - x0) / F.when(x0 != x1, x1 - x0))


def bilinear(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column, v00: Column, v10: Column, v01: Column, v11: Column) -> Column:
    """Between the four corners' values: along x at both ends of y, then along y."""
    return linear(y, y0, y1, linear(x, x0, x1, v00, v10), linear(x, x0, x1, v01, v11))
