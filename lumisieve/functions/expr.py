"""Native column expressions on coefficients (arrays of 256) and hashes (64 hex digits, four words)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import DIHEDRALS, LUMA, QUALITY_DIVISOR

WORDS = ("w0", "w1", "w2", "w3")


def luma(red: Column, green: Column, blue: Column) -> Column:
    return red * LUMA[0] + green * LUMA[1] + blue * LUMA[2]


def lower_median(values: Column) -> Column:
    """The 128th least of 256 values: an element, never a mean."""
    return F.array_sort(values)[127]


def middle(values: Column) -> Column:
    """The mean of the 128th and 129th of 256 values: another threshold with the same bits, where these two differ."""
    s = F.array_sort(values)
    return (s[127] + s[128]) / 2


def margin(values: Column) -> Column:
    """Gap between the values on both sides of the threshold; a tiny one makes bits depend on rounding."""
    s = F.array_sort(values)
    return s[128] - s[127]


def gradient_sum(values: Column) -> Column:
    """Sum of absolute differences of neighbours, down and across."""
    down = F.aggregate(F.sequence(F.lit(0), F.lit(239)), F.lit(0.0), lambda a, i: a + F.abs(values[i + 16] - values[i]))
    across = F.aggregate(F.sequence(F.lit(0), F.lit(254)), F.lit(0.0), lambda a, i: a + F.when(i % 16 != 15, F.abs(values[i + 1] - values[i])).otherwise(0.0))
    return down + across


def quality(gradient: Column) -> Column:
    return F.least(gradient / QUALITY_DIVISOR, F.lit(1.0))


def bits(values: Column, threshold: Column) -> Column:
    """256 characters 0 or 1, coefficient 255 first: the hash as it is printed in binary."""
    # the threshold is repeated, not named inside the function, where a sort that it comes from would run for every element
    each = F.zip_with(values, F.array_repeat(threshold, F.size(values)), lambda v, t: F.when(v > t, F.lit("1")).otherwise(F.lit("0")))
    return F.array_join(F.reverse(each), "")


def bits_to_hex(binary: Column) -> Column:
    """64 lower-case hex digits of 256 binary ones."""
    word = lambda k: F.lpad(F.lower(F.conv(F.substring(binary, 32 * k + 1, 32), 2, 16)), 8, "0")
    return F.concat(*(word(k) for k in range(8)))


def pack(values: Column, threshold: Column) -> Column:
    """The hash: bit i of a 256-bit number is whether coefficient i exceeds the threshold, as hex."""
    return bits_to_hex(bits(values, threshold))


def hex_to_bits(hashed: Column) -> Column:
    word = lambda k: F.lpad(F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 2), 32, "0")
    return F.concat(*(word(k) for k in range(8)))


def words(hashed: Column) -> list[Column]:
    """Four signed 64-bit words, most significant first."""
    return [F.conv(F.substring(hashed, 16 * k + 1, 16), 16, -10).cast("long").alias(w) for k, w in enumerate(WORDS)]


def words_to_hex(parts: list[Column]) -> Column:
    """64 lower-case hex digits of four signed 64-bit words."""
    return F.lower(F.concat(*(F.lpad(F.hex(w), 16, "0") for w in parts)))


def hamming(left: list[Column], right: list[Column]) -> Column:
    parts = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right)]
    return sum(parts[1:], parts[0])


def transpose(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: values[((i % 16) * 16 + F.floor(i / 16)).cast("int")])


def negate_alt_cols(values: Column, odd: bool = False) -> Column:
    return F.transform(values, lambda v, i: F.when(i % 2 == int(odd), -v).otherwise(v))


def negate_alt_rows(values: Column, odd: bool = False) -> Column:
    return F.transform(values, lambda v, i: F.when(F.floor(i / 16) % 2 == int(odd), -v).otherwise(v))


def negate_off_diagonals(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.when((i % 16 + F.floor(i / 16)) % 2 == 1, -v).otherwise(v))


def dihedral(values: Column, ord_: int) -> Column:
    transposed, cols, rows = DIHEDRALS[ord_][3]
    out = transpose(values) if transposed else values
    out = negate_alt_cols(out) if cols else out
    return negate_alt_rows(out) if rows else out
