"""Scalar functions with the result semantics of the database being left.

All are Column expressions; none runs Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format elements of the source database and their Spark letters, longest first.
DATE_ELEMENTS = [
    ("YYYY", "yyyy"), ("HH24", "HH"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"), ("DY", "E"),
    ("TZH:TZM", "xxx"),
]
# Korean weekday names, Sunday first.
KOREAN_DAYS = ["일", "월", "화", "수", "목", "금", "토"]


def nvl(value: Column, default) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def nvl2(value: Column, if_set: Column, if_null: Column) -> Column:
    return F.when(value.isNotNull(), if_set).otherwise(if_null)


def decode(value: Column, *pairs) -> Column:
    """``decode(v, s1, r1, ..., [default])``; a null search value matches null."""
    searches, default = (pairs[:-1], pairs[-1]) if len(pairs) % 2 else (pairs, None)
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for search, result in zip(searches[::2], searches[1::2]):
        cond = value.eqNullSafe(wrap(search))
        out = (out if out is not None else F).when(cond, wrap(result))
    return out.otherwise(wrap(default))


def concat_ignoring_null(*parts) -> Column:
    """String concatenation in which null adds nothing; all null gives null."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    joined = F.concat(*(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.nullif(joined, F.lit(""))


def greatest(*cols: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cols)), F.greatest(*cols))


def least(*cols: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cols)), F.least(*cols))


def date_pattern(pattern: str) -> str:
    for theirs, ours in DATE_ELEMENTS:
        pattern = pattern.replace(theirs, ours)
    return pattern


def to_char_date(value: Column, pattern: str = "YYYY-MM-DD") -> Column:
    return F.date_format(value, date_pattern(pattern))


def to_date(text: Column, pattern: str = "YYYY-MM-DD") -> Column:
    return F.to_date(text, date_pattern(pattern))


def to_timestamp(text: Column, pattern: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    """Text as a point in time without zone; fields the pattern lacks are the first of their kind."""
    return F.to_timestamp_ntz(text, F.lit(date_pattern(pattern)))


def korean_day(value: Column) -> Column:
    return F.element_at(F.array(*(F.lit(d) for d in KOREAN_DAYS)), F.dayofweek(value))


def trunc_number(value: Column) -> Column:
    """Cut the fraction, toward zero."""
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))


def round_half_up(value: Column, places: int = 0) -> Column:
    """Round half away from zero; a negative ``places`` rounds to tens, hundreds, ..."""
    return F.round(value, places)


def like_anywhere(text: Column, part: str) -> Column:
    """LIKE '%' || part || '%' without an escape character: % and _ in ``part`` are wildcards."""
    return text.like("%" + part.replace("\\", "\\\\") + "%")


def add_months(value: Column, months: int) -> Column:
    """The last day of a month stays the last day of the month reached."""
    moved = F.add_months(value, months)
    return F.when(F.to_date(value) == F.last_day(value), F.last_day(moved)).otherwise(moved)


def add_months_at(value: Column, months: int) -> Column:
    """The same for a point in time, which keeps its time of day."""
    at = value.cast("timestamp_ntz")
    return add_months(F.to_date(at), months).cast("timestamp_ntz") + (at - F.to_date(at).cast("timestamp_ntz"))


def variance(value: Column) -> Column:
    """Sample variance, 0 for a single row."""
    return F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.var_samp(value))


def instr(text: Column, part: str) -> Column:
    return F.instr(text, part).cast("bigint")


def substr(text: Column, start: int, length: int | Column) -> Column:
    return F.substring(text, F.lit(start), length if isinstance(length, Column) else F.lit(length))


def raw_to_text(raw: Column) -> Column:
    return F.decode(raw, "utf-8")


def text_to_raw(text: Column) -> Column:
    return F.encode(text, "utf-8")


def _grouped_digits(rounded: Column, whole_digits: int, cents: bool) -> Column:
    """Thousands groups without padding; '#' signs when the value is wider than the format."""
    width = whole_digits + (whole_digits - 1) // 3 + (3 if cents else 0) + 1
    text = F.format_number(rounded, 2 if cents else 0)
    if cents:
        text = F.regexp_replace(text, r"^(-?)0\.", "$1.")
    return F.when(F.abs(rounded) >= F.lit(10**whole_digits).cast("decimal(38,0)"), F.lit("#" * width)).otherwise(text)


def format_amount(amount: Column, currency: str = "KRW") -> Column:
    """Money as text; null counts as 0."""
    value = F.coalesce(amount.cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))
    if currency in ("KRW", "JPY"):
        return _grouped_digits(F.round(value, 0), 12 if currency == "KRW" else 9, cents=False)
    text = _grouped_digits(F.round(value, 2), 9, cents=True)
    return F.concat(F.lit("$"), text) if currency == "USD" else F.concat(text, F.lit(f" {currency}"))


def mask_string(text: Column, show: int = 3) -> Column:
    """Keep the first ``show`` characters, star the rest; short text stays as it is."""
    return F.when(F.length(text) <= show, text).otherwise(
        F.concat(F.substring(text, 1, show), F.repeat(F.lit("*"), F.length(text) - show))
    )


def calc_age(birth: Column, as_of: Column) -> Column:
    return trunc_number(F.months_between(as_of, birth, False) / 12).cast("bigint")


def business_days(start: Column, end: Column) -> Column:
    """Monday-to-Friday days from ``start`` to ``end`` inclusive; 0 when reversed, null counts as reversed.

    Whole weeks are counted by arithmetic, so the length of the span costs nothing.
    """
    days = F.datediff(end, start) + 1
    first = F.weekday(start)
    rest = days % 7
    # days of the last, partial week that fall on Saturday (5) or Sunday (6)
    last = first + rest - 1
    weekend = F.greatest(F.least(last, F.lit(6)) - F.greatest(first, F.lit(5)) + 1, F.lit(0)) + F.greatest(
        F.least(last - 7, F.lit(6)) - 4, F.lit(0)
    )
    count = F.floor(days / 7) * 5 + rest - F.when(rest > 0, weekend).otherwise(0)
    return F.when(days > 0, count).otherwise(F.lit(0)).cast("bigint")
