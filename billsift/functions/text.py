"""Text, date and number cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billsift.schemas import SEVERITIES

NUMBER_TYPE = "decimal(38,6)"


# Every character that counts as white space at the ends of a cell.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove all leading and trailing white space (plain ``trim`` removes only blanks)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def clean(col: Column) -> Column:
    return strip(F.coalesce(col.cast("string"), F.lit("")))


def is_blank(col: Column) -> Column:
    return clean(col) == ""


def parse_date(col: Column) -> Column:
    """ISO first, then day/month/year, then month/day/year; anything else is null."""
    raw = clean(col)
    iso = F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(raw, "yyyy-M-d"))
    slashed = raw.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    day_first = F.when(slashed, F.try_to_date(raw, "d/M/yyyy"))
    month_first = F.when(slashed, F.try_to_date(raw, "M/d/yyyy"))
    return F.coalesce(iso, day_first, month_first)


def parse_number(col: Column) -> Column:
    """Decimal value of a cell after dropping ``,`` and ``%``; null when unusable.

    The decimal cast refuses digit separators, type suffixes, inf and nan by itself.
    """
    return strip(F.translate(F.coalesce(col, F.lit("")), ",%", "")).try_cast(NUMBER_TYPE)


def product_or_default(col: Column) -> Column:
    cleaned = clean(col)
    return F.when(cleaned == "", F.lit("General")).otherwise(cleaned)


def file_base_name(col: Column) -> Column:
    """Last path element without control characters, at most 255 long, never empty."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), r"/+$", ""), r"^.*/", "")
    safe = strip(F.regexp_replace(strip(base), "[\\x00-\\x1f\\x7f]", ""))
    return F.substring(F.when(safe == "", F.lit("upload")).otherwise(safe), 1, 255)


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def days_pending(as_of, col: Column) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), col)


def severity_rank(col: Column) -> Column:
    """0 for CRITICAL to 3 for INFO; unknown severities sort last as 9."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col)
    return F.when(position > 0, position - 1).otherwise(F.lit(9)).cast("int")


def casefold(col: Column) -> Column:
    """Upper before lower folds letters such as the sharp s the way casefold does.

    The optimizer would shorten lower(upper(x)) to lower(x), which is not the same
    here; the translation in between changes nothing and keeps both.
    """
    return F.lower(F.translate(F.upper(col), "\t", "\t"))


def float_text(col: Column) -> Column:
    """A decimal as its shortest text with at least one digit after the point."""
    return F.regexp_replace(
        F.regexp_replace(col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0"
    )


def match_id_in(message: Column) -> Column:
    """Partner id kept inside an old stored message, null when there is none."""
    found = F.regexp_extract(message, r"match_id=(\d+)", 1)
    return F.when(found != "", found).cast("bigint")


def similarity_in(message: Column) -> Column:
    found = F.regexp_extract(message, r"similarity=([\d.]+)", 1)
    return F.when(found != "", found).try_cast("double")
