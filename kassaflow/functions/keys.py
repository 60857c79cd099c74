"""Scalar column functions: calendar keys, lenient numbers, canonical ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's float() reads and an integer conversion then accepts.
NUMERIC = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def month_key(ts: Column | str) -> Column:
    """``YYYY-MM``; null for null."""
    return F.date_format(_c(ts), "yyyy-MM")


def half_year_key(ts: Column | str) -> Column:
    """``YYYY-H1`` (January to June) or ``YYYY-H2``; null for null."""
    c = _c(ts)
    return F.when(c.isNotNull(), F.concat(F.date_format(c, "yyyy"), F.when(F.month(c) <= 6, F.lit("-H1")).otherwise(F.lit("-H2"))))


def empty_to_null(c: Column | str) -> Column:
    """The empty string is the only null of the text format."""
    return F.nullif(_c(c), F.lit(""))


def lenient_double(c: Column | str) -> Column:
    """A number from text, or null; no suffixes such as ``75d``."""
    t = F.trim(_c(c).cast("string"))
    return F.when(t.rlike(NUMERIC), t.try_cast("double"))


def lenient_long(c: Column | str) -> Column:
    """A plain integer from text, or null."""
    t = F.trim(_c(c).cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))


def whole_number_text(c: Column | str) -> Column:
    """The whole number that a text denotes, as text: ``123.0`` -> ``123``, `` 7`` -> ``7``.

    Fractions are cut towards zero. Null for null, empty and non-numeric text
    and for numbers beyond 37 digits. Digits that fit a bigint stay exact.
    """
    c = _c(c)
    t = F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}$", "")
    exact = F.when(t.rlike(r"^[+-]?[0-9]{1,15}(?:\.0*)?$"), F.regexp_extract(t, r"^\+?(-?[0-9]+)", 1).try_cast("long").cast("string"))
    cut = F.when(t.rlike(NUMERIC), F.when(t.try_cast("double") < 0, F.ceil(t.try_cast("double").try_cast("decimal(38,1)"))).otherwise(F.floor(t.try_cast("double").try_cast("decimal(38,1)"))).cast("string"))
    # most ids are plain already; the branches behind run for the others only
    return F.when(c.rlike(r"^(?:0|[1-9][0-9]{0,14})\z"), c).otherwise(F.coalesce(exact, cut))


def canonical_id(c: Column | str) -> Column:
    """``whole_number_text`` that leaves text which denotes no number as it is."""
    return F.coalesce(whole_number_text(c), _c(c))


def folded_name(c: Column | str) -> Column:
    """Trimmed, whitespace runs as one space, lower case; null if nothing is left."""
    # one kind of space first; only names with runs of it meet a regular expression
    one = F.translate(_c(c), _SPACES, " " * len(_SPACES))
    return F.nullif(F.lower(F.trim(F.when(F.contains(one, F.lit("  ")), F.regexp_replace(one, " {2,}", " ")).otherwise(one))), F.lit(""))


def money(c: Column | str) -> Column:
    """decimal(18,2): sums of it don't depend on the order of the rows."""
    return _c(c).try_cast("decimal(18,2)")


def round_half_up(c: Column | str, places: int = 2) -> Column:
    return F.round(_c(c), places)


def fixed_places(c: Column | str, places: int = 2) -> Column:
    """Text with a fixed number of places, rounded half up; null stays null. Decimals and integers stay exact."""
    # a decimal takes the places as a decimal; NaN and numbers beyond 36 digits can't be one
    exact = F.round(_c(c), places).try_cast(f"decimal(38,{places})").cast("string")
    return F.when(_c(c).isNotNull(), F.coalesce(exact, F.format_string(f"%.{places}f", _c(c).try_cast("double"))))


def name_or_key(name: Column | str, key: Column | str) -> Column:
    return F.coalesce(_c(name), _c(key))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
