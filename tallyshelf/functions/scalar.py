"""Row-wise expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.schema import UNKNOWN_CUSTOMER

# Every white-space character of Unicode (the blank alone is what trim removes).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(c: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


# English month names by their first three letters, four characters apart.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _iso_date(text: Column) -> Column:
    """The date in front of a text rearranged to year-month-day; other texts stay as they are."""
    slashed = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})(?=\D|$)", "$1-$2-$3")
    slashed = F.regexp_replace(slashed, r"^(\d{1,2})/(\d{1,2})/(\d{4})(?=\D|$)", "$3-$1-$2")
    # two digits: 69 and later are of the last century
    slashed = F.regexp_replace(slashed, r"^(\d{1,2})/(\d{1,2})/([0-5]\d|6[0-8])(?=\D|$)", "20$3-$1-$2")
    slashed = F.regexp_replace(slashed, r"^(\d{1,2})/(\d{1,2})/(69|[7-9]\d)(?=\D|$)", "19$3-$1-$2")
    pattern = r"^(?:(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*\.?[ ,-]+|([A-Za-z]{3})[A-Za-z]*\.? +(\d{1,2}),? +)(\d{4})(?=\D|$)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    place = F.instr(F.lit(MONTHS), F.lower(F.concat(part(2), part(3))))
    month = ((place + 3) / 4).cast("int").cast("string")
    rest = F.regexp_replace(text, pattern, "")
    named = F.when((place > 0) & (place % 4 == 1), F.concat(part(5), F.lit("-"), month, F.lit("-"), part(1), part(4), rest))
    return F.when(F.contains(text, F.lit("/")), slashed).when(text.rlike("[A-Za-z]{3}"), named).otherwise(text)


def _whole_day_clock(text: Column) -> Column:
    """A clock with AM or PM at the end turned into 24 hours."""
    pattern = r"(?i)(\d{1,2})(:\d{2}(?::\d{2}(?:\.\d+)?)?) ?([ap])\.?m\.?$"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    late = F.lower(F.regexp_extract(text, pattern, 3)) == "p"
    moved = F.when(hour.between(1, 12), hour % 12 + F.when(late, 12).otherwise(0))
    clock = F.concat(F.lpad(moved.cast("string"), 2, "0"), F.regexp_extract(text, pattern, 2))
    return F.when(text.rlike(pattern), F.concat(F.regexp_replace(text, pattern, ""), clock)).otherwise(text)


def _bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed once, however often it is used: the expression stays small."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def parse_timestamp(c: Column, data_type: T.DataType, formats: Sequence[str] = ()) -> Column:
    """Timestamp without zone; text that is no date becomes null instead of an error.

    Text may be ISO (``2010-12-01[ T]08:26[:00[.000]]``, date alone included), year first or month first with slashes
    (``2010/12/01``, ``12/1/2010 8:26``, ``12/1/10 8:26``), or have an English month name (``1 Dec 2010``,
    ``December 1, 2010``); a clock may end in AM or PM. Such text is rearranged and one cast reads all: a failed cast
    costs nothing, whereas a failed pattern raises and catches an exception for every row. ``formats`` replaces
    this by explicit patterns, tried in order.
    """
    if isinstance(data_type, T.StringType):
        text = strip_text(c)
        if formats:
            c = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
        else:
            plain = text.try_cast("timestamp_ntz")
            unusual = text.rlike("[/A-Za-z]")
            moved = _bound(_bound(text, _whole_day_clock), _iso_date)
            c = F.when(unusual, F.coalesce(plain, moved.try_cast("timestamp_ntz"))).otherwise(plain)
    return c.cast("timestamp_ntz")


def text_before_dot(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def as_text(c: Column, data_type: T.DataType) -> Column:
    """Text of a value; whole doubles print without exponent or fraction."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(c == F.floor(c), c.try_cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def customer_text(c: Column, data_type: T.DataType) -> Column:
    """Customer key as text: missing and empty become UNKNOWN, then the part before the first dot."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # a cast to bigint truncates, as cutting the text at the dot does
        c = F.nanvl(c, F.lit(None).cast(data_type)).try_cast("bigint")
    text = c.cast("string")
    return text_before_dot(F.when(text.isNull() | (text == ""), UNKNOWN_CUSTOMER).otherwise(text))


def starts_cancelled(invoice: Column) -> Column:
    return F.coalesce(F.startswith(invoice.cast("string"), F.lit("C")), F.lit(False))


def date_parts(ts: Column) -> dict[str, Column]:
    """Seven integer date parts; Monday is day 0 and weeks are ISO weeks."""
    return {
        "OrderYear": F.year(ts),
        "OrderMonth": F.month(ts),
        "OrderDay": F.dayofmonth(ts),
        "OrderDayOfWeek": F.weekday(ts),
        "OrderHour": F.hour(ts),
        "OrderWeekOfYear": F.weekofyear(ts),
        "OrderQuarter": F.quarter(ts),
    }


def matches_term(c: Column, term: str, literal: bool = False) -> Column:
    """Case-insensitive search; ``term`` is a (Java) regular expression unless ``literal``."""
    text = c.cast("string")
    hit = F.contains(F.lower(text), F.lit(term.lower())) if literal else F.rlike(text, F.lit("(?iu)" + term))
    return F.coalesce(hit, F.lit(False))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def money_text(c: Column) -> Column:
    return F.format_number(c, 2)
