"""Strict equality of two cells: no tolerance, no trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _floating(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _too_wide(a: T.DataType, b: T.DataType) -> bool:
    """Whether no decimal holds the digits of both: a comparison would then round the finer one."""
    places = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (20, 0) for t in (a, b)]
    return max(p[0] for p in places) + max(p[1] for p in places) > 38


def cells_equal(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> Column:
    """True when both are null or hold the same value; never null.

    Numbers compare as numbers whatever their width, booleans are not numbers,
    and everything else of differing types compares by its exact text.  A
    decimal equals a float if each, cast to the other's type, gives the other:
    0.1 equals the double written 0.1, and 0.10000000000000000001 does not.
    """
    if _numeric(left_type) and _numeric(right_type):
        if not _floating(left_type) and not _floating(right_type) and _too_wide(left_type, right_type):
            return _plain_number(left, left_type).eqNullSafe(_plain_number(right, right_type))
        if _floating(left_type) == _floating(right_type):
            return left.eqNullSafe(right)
        exact, loose = (right, left) if _floating(left_type) else (left, right)
        if isinstance(right_type if _floating(left_type) else left_type, T.IntegralType):
            # both directions, or 2^53 + 1 would equal 2^53
            return exact.cast("double").eqNullSafe(loose.cast("double")) & exact.cast("bigint").eqNullSafe(
                loose.try_cast("bigint")
            )
        dtype = right_type if _floating(left_type) else left_type
        return exact.cast("double").eqNullSafe(loose.cast("double")) & exact.eqNullSafe(loose.cast("double").try_cast(dtype))
    if isinstance(left_type, T.MapType) or isinstance(right_type, T.MapType):
        return cell_text(left, left_type).eqNullSafe(cell_text(right, right_type))
    if left_type == right_type or (isinstance(left_type, T.StringType) and isinstance(right_type, T.StringType)):
        return left.eqNullSafe(right)
    return cell_text(left, left_type).eqNullSafe(cell_text(right, right_type))


def _plain_number(value: Column, dtype: T.DataType) -> Column:
    """Text of a whole number or decimal without trailing zeros: equal numbers of any precision and scale have equal texts."""
    if not isinstance(dtype, T.DecimalType) or dtype.scale <= 0:
        return value.cast("string")
    return F.when(value == 0, F.lit("0")).otherwise(F.regexp_replace(F.rtrim(value.cast("string"), F.lit("0")), r"\.$", ""))


def _zero_is_zero(value: Column) -> Column:
    """-0.0 as 0.0, which it equals."""
    return value.cast("double") + F.lit(0.0)


def canonical(value: Column, own: T.DataType, other: T.DataType) -> Column:
    """A cell in a form that is equal on both sides exactly where ``cells_equal`` holds.

    Both sides must be built with each other's types.  It is the value itself
    where the types agree, and text (or a wider number) otherwise.
    """
    if _numeric(own) and _numeric(other) and own != other:
        if _floating(own) and _floating(other):
            return _zero_is_zero(value)
        if _floating(own) or _floating(other):
            exact = other if _floating(own) else own
            exact = T.LongType() if isinstance(exact, T.IntegralType) else exact
            fits = F.coalesce(_plain_number(value.try_cast(exact), exact), F.lit(""))
            return F.when(value.isNotNull(), F.concat(_zero_is_zero(value).cast("string"), F.lit("|"), fits))
        if isinstance(own, T.IntegralType) and isinstance(other, T.IntegralType):
            return value.cast("bigint")
        return _plain_number(value, own)
    if own == other and not isinstance(own, (T.MapType, T.VariantType)):
        return value
    return cell_text(value, own)


def grouped_cell(value: Column, own: T.DataType, other: T.DataType) -> Column:
    """A cell as (v): grouping by it puts together what ``cells_equal`` calls equal."""
    return F.struct(canonical(value, own, other).alias("v"))


def hashable(value: Column, own: T.DataType, other: T.DataType) -> list[Column]:
    """What to hash of a cell, so that unequal cells have unequal hashes (but for chance).

    Hashes skip nulls, also those inside arrays and structs, and text alone
    may lose where one element ends or what a time has behind milliseconds:
    nested values are hashed as JSON with nulls and as printed.
    """
    cell = canonical(value, own, other)
    if own == other and isinstance(own, (T.ArrayType, T.StructType)):
        return [F.to_json(F.struct(cell.alias("v")), {"ignoreNullFields": "false"}), cell.cast("string")]
    return [cell]


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """The cell as text, for reports and for comparing unlike types."""
    if isinstance(dtype, (T.MapType, T.ArrayType, T.StructType)):
        return F.to_json(value)
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    return value.cast("string")
