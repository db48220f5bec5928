"""Bit algebra over frames as Column expressions: everything stays inside generated code.

A payload is ``words``: an array of longs, each 8 bytes little-endian. Positions and lengths may be Columns, so one
plan decodes any catalog; with literals they fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canloom.model import EFF_BIT

TWO_64 = "18446744073709551616"
U64 = "decimal(20,0)"


def col_of(x: Column | int | bool | float | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def normalize_id(arb_id: Column, is_extended: Column) -> Column:
    """The id with bit 31 set for an extended one; applying it again changes nothing."""
    return arb_id.bitwiseOR(F.when(is_extended, F.lit(EFF_BIT)).otherwise(F.lit(0)).cast("long"))


def word_at(words: Column, index: Column | int) -> Column:
    """The word, 0 past the end."""
    return F.coalesce(F.try_element_at(words, (col_of(index) + 1).cast("int")), F.lit(0).cast("long"))


def swap_bytes(word: Column) -> Column:
    """The eight bytes in reverse order."""
    out = None
    for i in range(8):
        byte = F.shiftrightunsigned(word, 8 * i).bitwiseAND(F.lit(255).cast("long"))
        part = F.shiftleft(byte, 56 - 8 * i)
        out = part if out is None else out.bitwiseOR(part)
    return out


def _shift(f: str, x: Column, n: Column) -> Column:
    return F.call_function(f, x, n.cast("int"))


def low_bits(x: Column, length: Column | int) -> Column:
    """x cut to its lowest ``length`` bits (1 to 64)."""
    return x.bitwiseAND(_shift("shiftrightunsigned", F.lit(-1).cast("long"), 64 - col_of(length)))


def extract_little(words: Column, position: Column | int, length: Column | int) -> Column:
    """``length`` bits up from ``position``, the low bit first, as the pattern of a long."""
    position = col_of(position)
    index, shift = F.floor(position / 64), position % 64
    low = _shift("shiftrightunsigned", word_at(words, index), shift)
    high = F.when(shift > 0, _shift("shiftleft", word_at(words, index + 1), 64 - shift)).otherwise(F.lit(0).cast("long"))
    return low_bits(low.bitwiseOR(high), length)


def big_words(words: Column) -> Column:
    """The words with their bytes in reverse order: what ``extract_big`` reads. Make it a column once for each frame."""
    return F.transform(words, swap_bytes)


def extract_big(big: Column, position: Column | int, length: Column | int) -> Column:
    """``length`` bits on from ``position`` of the stream whose bytes run high bit first; ``big`` as of ``big_words``."""
    position, length = col_of(position), col_of(length)
    index, shift = F.floor(position / 64), position % 64
    high = _shift("shiftleft", word_at(big, index), shift)
    low = F.when(shift > 0, _shift("shiftrightunsigned", word_at(big, index + 1), 64 - shift)).otherwise(F.lit(0).cast("long"))
    return _shift("shiftrightunsigned", high.bitwiseOR(low), 64 - length)


def extract(words: Column, big: Column, position: Column | int, length: Column | int, little: Column | bool) -> Column:
    if isinstance(little, bool):
        return extract_little(words, position, length) if little else extract_big(big, position, length)
    return F.when(little, extract_little(words, position, length)).otherwise(extract_big(big, position, length))


def sign_extend(value: Column, length: Column | int) -> Column:
    n = 64 - col_of(length)
    return _shift("shiftright", _shift("shiftleft", value, n), n)


def unsigned(value: Column) -> Column:
    """The pattern of a long as an unsigned number, decimal(20,0)."""
    wide = value.cast(U64)
    return F.when(value < 0, (wide + F.lit(TWO_64).cast(U64)).cast(U64)).otherwise(wide)


def integer_long(bits: Column, length: Column | int, is_signed: Column | bool) -> Column:
    """Extracted bits as a long: signed ones extended, others as they are (negative means 2**63 and more)."""
    if isinstance(is_signed, bool):
        return sign_extend(bits, length) if is_signed else bits
    return F.when(is_signed, sign_extend(bits, length)).otherwise(bits)


def beyond_long(number: Column, is_signed: Column | bool) -> Column:
    """Whether a long of ``integer_long`` stands for an unsigned number of 2**63 or more."""
    return (number < 0) & ~col_of(is_signed)


def integer_value(bits: Column, length: Column | int, is_signed: Column | bool) -> Column:
    """Extracted bits as a number, decimal(20,0)."""
    number = integer_long(bits, length, is_signed)
    return F.when(beyond_long(number, is_signed), unsigned(number)).otherwise(number.cast(U64))


def integer_double(bits: Column, length: Column | int, is_signed: Column | bool) -> Column:
    """Extracted bits as a double; decimals are used for numbers beyond a long alone."""
    number = integer_long(bits, length, is_signed)
    return F.when(beyond_long(number, is_signed), unsigned(number).cast("double")).otherwise(number.cast("double"))


def unsigned_double(number: Column) -> Column:
    """The pattern of a long as an unsigned number in doubles, rounded once: half of it, the lost bit kept, and twice that."""
    half = F.shiftrightunsigned(number, 1).bitwiseOR(number.bitwiseAND(F.lit(1).cast("long")))
    return half.cast("double") * F.lit(2.0)


def float32_value(bits: Column) -> Column:
    """The double that IEEE single bits stand for, by arithmetic that is exact."""
    sign = F.when(F.shiftrightunsigned(bits, 31).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    e = F.shiftrightunsigned(bits, 23).bitwiseAND(F.lit(255).cast("long"))
    m = bits.bitwiseAND(F.lit(0x7FFFFF).cast("long"))
    return _float(sign, e, m, 255, 127, 23)


def float64_value(bits: Column) -> Column:
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    e = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047).cast("long"))
    m = bits.bitwiseAND(F.lit((1 << 52) - 1).cast("long"))
    return _float(sign, e, m, 2047, 1023, 52)


def _float(sign: Column, e: Column, m: Column, top: int, bias: int, width: int) -> Column:
    mantissa = m.cast("double")
    return (
        F.when((e == top) & (m != 0), F.lit(float("nan")))
        .when(e == top, sign * F.lit(float("inf")))
        .when(e == 0, sign * mantissa * F.lit(2.0 ** (1 - bias - width)))
        .otherwise(sign * (F.lit(1.0) + mantissa * F.lit(2.0**-width)) * F.pow(F.lit(2.0), (e - bias).cast("double")))
    )


def float_fields(bits: Column, length: Column) -> tuple[Column, Column]:
    """Exponent and mantissa of IEEE single (length 32) or double bits."""
    single = length == 32
    e = F.when(single, F.shiftrightunsigned(bits, 23).bitwiseAND(F.lit(255).cast("long"))).otherwise(F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047).cast("long")))
    return e, bits.bitwiseAND(F.when(single, F.lit((1 << 23) - 1).cast("long")).otherwise(F.lit((1 << 52) - 1).cast("long")))


def float_of(bits: Column, length: Column, e: Column, m: Column) -> Column:
    """``float_value`` from the fields, in one formula for both widths; powers of two are exact."""
    single = length == 32
    negative = F.when(single, F.shiftrightunsigned(bits, 31).bitwiseAND(F.lit(1).cast("long")) == 1).otherwise(bits < 0)
    fraction = m.cast("double") * F.when(single, F.lit(2.0**-23)).otherwise(F.lit(2.0**-52))
    power = F.pow(F.lit(2.0), (F.greatest(e, F.lit(1).cast("long")) - F.when(single, F.lit(127)).otherwise(F.lit(1023))).cast("double"))
    size = F.when(e == F.when(single, F.lit(255)).otherwise(F.lit(2047)), F.when(m != 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise((fraction + F.when(e == 0, F.lit(0.0)).otherwise(F.lit(1.0))) * power)
    return F.when(negative, -size).otherwise(size)


def float_value(bits: Column, length: Column | int) -> Column:
    length = col_of(length)
    return F.when(length == 32, float32_value(bits)).otherwise(float64_value(bits))


def physical(raw: Column, scale: Column | float, offset: Column | float, as_double: Column | None = None) -> Column:
    """raw * scale + offset in doubles; where these could round twice, exactly in decimals with one rounding at the end.

    Below 2**53 both ways are exact for integral factors, so deciding by row equals deciding by signal. ``as_double`` is
    raw as a double, where it is at hand.
    """
    scale, offset = col_of(scale), col_of(offset)
    number = raw.cast("double") if as_double is None else as_double
    integral = (scale == F.rint(scale)) & (offset == F.rint(offset)) & (F.abs(scale) < 1e15) & (F.abs(offset) < 1e15)
    large = F.abs(number) * F.abs(scale) + F.abs(offset) >= F.lit(2.0**53)
    exact = (raw.cast(U64) * scale.cast("decimal(16,0)") + offset.cast("decimal(16,0)")).cast("double")
    return F.when(large & integral, exact).otherwise(number * scale + offset)


def words_of(data: Column, n_words: int) -> Column:
    """words of a binary, by byte patterns (for sources that don't bring words)."""
    def word(i: int) -> Column:
        chunk = F.rpad(F.substring(data, 8 * i + 1, 8), 8, F.unhex(F.lit("00")))
        return swap_bytes(F.conv(F.hex(chunk), 16, -10).cast("long"))

    return F.array(*(word(i) for i in range(n_words)))


def padded(data: Column, width: int | Column) -> Column:
    """A payload cut or padded with zero bytes on the right to ``width`` bytes."""
    if isinstance(width, int):
        return F.rpad(data, width, F.unhex(F.lit("00")))
    return F.call_function("rpad", data, width.cast("int"), F.unhex(F.lit("00")))


def clean_text(text: Column) -> Column:
    """Text without trailing NULs, as fixed-width text is compared."""
    return F.regexp_replace(text, "\\x00+$", "")


def display_name(path: Column) -> Column:
    """File name with its folder in full-width brackets."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.concat(F.element_at(parts, -1), F.lit("（"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.lit("）"))


def size_text(size: Column) -> Column:
    """Bytes as people read them: B, KB, MB or GB with one decimal from KB on."""
    n = size.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", size.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .otherwise(F.format_string("%.1f GB", n / 1024**3))
    )


def overall_percent(index: Column | int, total: Column | int, inner: Column | float) -> Column:
    """Share of a batch that is done: file ``index`` (from 0) of ``total`` is at ``inner`` percent."""
    return (col_of(index) + col_of(inner) / 100) / col_of(total) * 100
