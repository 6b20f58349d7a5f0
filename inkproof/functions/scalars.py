"""Scalar checks shared by rules and scores. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted ways to write a date, in the order in which they are tried.
DATE_PATTERNS = (
    "yyyy-M-d",
    "d/M/yyyy",
    "M/d/yyyy",
    "d-M-yyyy",
    "yyyy/M/d",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)

# What a text needs for a pattern to read it, besides its separator; other tries fail for sure, and a failed try is dear.
_YEAR_FIRST, _YEAR_LAST = r"^[+-]?[0-9]{4}", r"[0-9]{4}\z"
_NEEDS = {
    "yyyy-M-d": _YEAR_FIRST,
    "d/M/yyyy": r"/0*([1-9]|1[0-2])/.*" + _YEAR_LAST,
    "M/d/yyyy": r"^0*([1-9]|1[0-2])/.*" + _YEAR_LAST,
    "d-M-yyyy": _YEAR_LAST,
    "yyyy/M/d": _YEAR_FIRST,
    "d MMM yyyy": r"^[^,]*" + _YEAR_LAST,
    "d MMMM yyyy": r"^[^,]*" + _YEAR_LAST,
    "MMM d, yyyy": r"^[^,]{1,5} .*" + _YEAR_LAST,
    "MMMM d, yyyy": _YEAR_LAST,
}

#: Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (any Unicode) at either end. A text that starts and ends with visible ASCII is as it is; trimming is dear."""
    seen = lambda at: F.substring(c, at, 1).between(F.lit("!"), F.lit("~"))
    return F.when(seen(1) & seen(-1), c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def key(c: Column) -> Column:
    """How names and numbers are compared: stripped, in lower case."""
    return F.lower(strip(c))


def falsy(c: Column) -> Column:
    """Null or empty; a blank text is neither."""
    return c.isNull() | (c == "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c) == "")


def present(c: Column, kind: str) -> Column:
    """Not null, and for texts not blank, for arrays not empty. ``kind``: text, number or array."""
    if kind == "text":
        return ~blank(c)
    return c.isNotNull() & (F.size(c) > 0) if kind == "array" else c.isNotNull()


def parse_date(c: Column) -> Column:
    """The timestamp (without zone) of the first pattern that reads the whole text, or null.

    A pattern is tried only on texts that have its separator and what else it needs, as a failed try is dear.
    """
    text = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    sign = lambda p: next(x for x in ",-/ " if x in p)
    fits = lambda p: F.contains(text, F.lit(sign(p))) & text.rlike(_NEEDS[p])
    tries = (F.when(fits(p), F.try_to_timestamp(text, F.lit(p))) for p in DATE_PATTERNS)
    return F.coalesce(*tries).cast("timestamp_ntz")


def whole_days(later: Column, earlier: Column) -> Column:
    """The days between two times, rounded down (also below zero)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000))


def iso_currency(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).rlike("^[A-Z]{3}$"), F.lit(False))


def money(c: Column) -> Column:
    """Two decimals, never an exponent; a number that is too large for that, or none, as Spark writes it."""
    return F.coalesce(c.try_cast("decimal(38,2)").cast("string"), c.cast("string"))


def _trimmed(text: Column) -> Column:
    """A decimal text without trailing zeros and point."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def six_digits(c: Column) -> Column:
    """A number to six significant digits without trailing zeros, with an exponent outside 1e-4 to 1e6; infinities and no numbers as Spark writes them."""
    size = F.abs(c)
    wide = F.when(size >= F.lit(float("inf")), c.cast("string")).when(size == 0, F.lit("0"))  # no number is greater than any other
    for e in range(-4, 6):
        top = 10.0 ** (e + 1) - 0.5 * 10.0 ** (e - 5)  # from here on it rounds up to one more digit
        wide = wide.when((size < top) & (size >= 10.0**-4), _trimmed(c.try_cast(f"decimal(38,{5 - e})").cast("string")))
    e = F.floor(F.log10(size)).cast("int")
    e = F.when(F.round(size / F.pow(F.lit(10.0), e), 5) >= 10, e + 1).otherwise(e)
    mantissa = _trimmed((c / F.pow(F.lit(10.0), e)).try_cast("decimal(38,5)").cast("string"))
    return wide.otherwise(F.concat(mantissa, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), 2, "0")))


def grounded_text(value: Column, source: Column, low: Column | None = None) -> Column:
    """The stripped value occurs in the source, whatever the case; never in a null or empty source. ``low``: the source in lower case, if it is there."""
    found = F.contains(F.lower(source) if low is None else low, key(value))
    return F.coalesce(~blank(value) & ~falsy(source) & found, F.lit(False))


def grounded_number(value: Column, source: Column, low: Column | None = None) -> Column:
    """One of the ways to write the number occurs in the source."""
    low = F.lower(source) if low is None else low
    whole = F.when(value == F.rint(value), value.try_cast("decimal(38,0)").cast("string"))
    has = lambda form: F.coalesce(F.contains(low, form), F.lit(False))
    return F.coalesce(value.isNotNull() & ~falsy(source) & (has(money(value)) | has(whole) | has(six_digits(value))), F.lit(False))
