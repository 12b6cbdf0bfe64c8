"""Rows at given places of an ordered table, without ordering the table.

A quantile sketch of the leading sort column says about where the wanted
places are.  Rows are then counted exactly between the values it names; only
the windows that hold a wanted place have their sort columns fetched, ordered
and numbered, starting from the exact number of rows before the window.  The
other columns are read for the chosen rows alone.

What is moved is a few rows around each wanted place, with the sort columns
only.  Many rows of one leading value make one wide window, which is ordered in
as many tasks as it needs.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.operators.ordered import Order, global_index
from cutover.session import stage

#: The sketch finds a place up to one in so many rows.
ACCURACY = 100_000
#: Bytes of text that the sketch looks at.
TEXT_BYTES = 6

Places = Sequence[tuple[int, int]]

c = F.col


def _named(order: Order) -> list[tuple[str, bool]]:
    return [(o, False) if isinstance(o, str) else (o[0], o[1] == "desc") for o in order]


def image(value: Column, dtype: T.DataType) -> Column:
    """A double that never falls where the value rises; unequal values may share one, and null stays null."""
    if isinstance(dtype, T.BooleanType):
        value = value.cast("int")
    elif isinstance(dtype, T.DateType):
        value = F.unix_date(value)
    elif isinstance(dtype, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(dtype, T.TimestampNTZType):
        value = F.unix_date(F.to_date(value)).cast("long") * 86400 + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
    elif isinstance(dtype, (T.StringType, T.BinaryType)):
        head = F.hex(F.substring(value.cast("binary"), 1, TEXT_BYTES))
        value = F.conv(F.rpad(head, 2 * TEXT_BYTES, "0"), 16, 10)
    elif not isinstance(dtype, T.NumericType):
        return F.when(value.isNotNull(), F.lit(0.0))
    number = value.cast("double")
    # NaN sorts behind all numbers
    return F.when(F.isnan(number), F.lit(math.inf)).otherwise(number)


def _windows(places: Places, filled: int, before: int, values: Callable[[list[float]], list[float]]) -> list[tuple[float, float]]:
    """Ranges of images that should hold the places, apart from one another and rising.

    ``filled`` rows have an image; ``before`` rows without one come ahead of them.
    """
    slack = filled / ACCURACY + 2
    spans: list[tuple[float, float]] = []
    if not filled:
        return []
    for first, last in places:
        lo, hi = first - before - slack, last - before + slack
        if hi < 0 or lo > filled - 1:
            continue
        spans.append((lo / filled, (hi + 1) / filled))
    asked = sorted({x for span in spans for x in span if 0 < x < 1})
    at = dict(zip(asked, values(asked)))
    out: list[tuple[float, float]] = []
    for lo, hi in spans:
        low, high = at.get(lo, -math.inf), at.get(hi, math.inf)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _wanted_in(places: Places, start: int, rows: int) -> bool:
    """Whether a wanted place is among ``rows`` rows from ``start`` on; places rise and don't overlap."""
    at = bisect_left(places, start, key=lambda p: p[1])
    return at < len(places) and places[at][0] < start + rows


def numbered_rows(df: DataFrame, order: Order, places: Callable[[int], Places], keep: Callable[[int], Callable[[Column], Column]]) -> tuple[DataFrame, int]:
    """The rows at the wanted places with their place ``_i`` from 0, and the number of all rows.

    ``places`` gives, for the number of rows, ranges of places (first and last)
    in rising order, and ``keep`` the condition on a place.  How many ranges
    there are must not grow with the table.  ``order`` must be total.
    """
    if not order:
        raise ValueError("places need a total order; name the columns that give one")
    spark, names = df.sparkSession, _named(order)
    lead, falling = names[0]
    seen = image(c(lead), df.schema[lead].dataType)
    marked = df.withColumn("_v", -seen if falling else seen)
    n, filled = marked.agg(F.count(F.lit(1)), F.count("_v")).first()
    before = n - filled if falling else 0
    wanted = [p for p in places(n) if p[0] < n] if n else []
    if not wanted:
        return df.limit(0).withColumn("_i", F.lit(0).cast("long")), n

    def values(fractions: list[float]) -> list[float]:
        # one literal for all of them
        shares = F.from_json(F.lit(json.dumps(fractions)), "array<double>")
        return list(marked.agg(F.percentile_approx("_v", shares, ACCURACY)).first()[0]) if fractions else []

    cuts = sorted({x for lo, hi in _windows(wanted, filled, before, values) for x in (lo, math.nextafter(hi, math.inf)) if math.isfinite(x)})
    if cuts:
        marked = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_v", outputCol="_b", handleInvalid="keep").transform(marked)
    else:
        marked = marked.withColumn("_b", F.lit(0.0))
    empty = -1 if falling else len(cuts) + 1
    marked = marked.withColumn("_b", F.when(c("_v").isNull(), F.lit(empty)).otherwise(c("_b").cast("int")))

    # exact numbers decide which parts hold a wanted place, whatever the sketch has said
    sizes = {r._b: r.n for r in marked.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts, start, fetched = [], 0, 0
    for b in sorted(sizes):
        if _wanted_in(wanted, start, sizes[b]):
            parts.append((b, start - fetched))
            fetched += sizes[b]
        start += sizes[b]
    shifts = F.broadcast(spark.createDataFrame(parts, "_b int, _shift long"))  # a few rows per wanted range
    keys = [x for x, _ in names]
    near = global_index(marked.join(shifts, "_b").select("_b", "_shift", *keys), ["_b", *order], "_g")
    near = near.select(*keys, (c("_g") + c("_shift")).alias("_i"))
    chosen = near.filter(keep(n)(c("_i")))
    if {x.lower() for x in keys} >= {x.lower() for x in df.columns}:
        return chosen.select(*df.columns, "_i"), n
    return _whole_rows(df, keys, near, stage(chosen, "chosen-places")), n


def _whole_rows(df: DataFrame, keys: Sequence[str], near: DataFrame, chosen: DataFrame) -> DataFrame:
    """All columns of the rows at the chosen places; rows with equal keys are told apart by their number."""
    marks = [f"_k{i}" for i in range(len(keys))]
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[m]) for k, m in zip(keys, marks)))
    wanted = chosen.select(*(c(k).alias(m) for k, m in zip(keys, marks))).distinct()
    first = near.join(wanted, same(near, wanted), "left_semi").groupBy(*keys).agg(F.min("_i").alias("_first"))
    first = first.select(*(c(k).alias(m) for k, m in zip(keys, marks)), "_first")
    copies = chosen.join(first, same(chosen, first)).select(*marks, "_i", (c("_i") - c("_first") + 1).alias("_copy"))
    rest = [x for x in df.columns if x.lower() not in {k.lower() for k in keys}]
    by = W.partitionBy(*keys).orderBy(F.xxhash64(*rest))
    rows = df.join(wanted, same(df, wanted), "left_semi").withColumn("_n", F.row_number().over(by))
    return rows.join(copies, same(rows, copies) & (rows["_n"] == copies["_copy"])).select(*(rows[x] for x in df.columns), "_i")
