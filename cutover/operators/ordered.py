"""Global and per-group ordering without funnelling a group into one task.

A plain ``Window`` sends each group to one task; a group holding a third of the
table, or no ``partitionBy`` at all, then decides the run time.  Here rows are
range-partitioned by (group, order, tie-break), so a large group is cut into
segments of about equal size.  Windows run inside a segment, and what a segment
must know of its neighbours travels in an edge table holding at most two rows
per segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutover.session import stage

Order = Sequence[str | tuple[str, str]]


def _names(order: Order) -> list[str]:
    return [o if isinstance(o, str) else o[0] for o in order]


def sort_columns(order: Order) -> list[Column]:
    """Sort keys with the source database's null position: last when ascending, first when descending."""
    out = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        out.append(F.col(name).desc_nulls_first() if direction == "desc" else F.col(name).asc_nulls_last())
    return out


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _segmented(df: DataFrame, sort: Sequence[Column]) -> DataFrame:
    """Range-partition and sort; store each row's segment and position in it."""
    ranged = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id puts the partition in the upper bits, the row in the lower 33.
    return (
        stage(ranged, "ordered")
        .withColumn("_seg", F.shiftrightunsigned("_at", 33))
        .withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    )


def global_index(df: DataFrame, order: Order, name: str = "row_index") -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order``, which must be a total order.

    One range shuffle.  The offsets broadcast at the end have one row per partition.
    """
    if not order:
        raise ValueError("a row index needs a total order; name the columns that give one")
    seg = _segmented(df, sort_columns(order))
    offsets = (
        seg.groupBy("_seg").count()
        .withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("_seg", "_before")
    )
    return (
        seg.join(F.broadcast(offsets), "_seg")
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_seg", "_pos", "_at", "_before")
    )


def _ntile(rn: Column, total: Column, buckets: int) -> Column:
    base = F.floor(total / F.lit(buckets)).cast("bigint")
    wide = total % F.lit(buckets)
    head = wide * (base + 1)
    return F.when(rn <= head, F.floor((rn - 1) / (base + 1)) + 1).otherwise(
        wide + F.floor((rn - head - 1) / F.greatest(base, F.lit(1))) + 1
    ).cast("bigint")


def _derive(kind: str, arg, rn: Column, rank: Column, dense: Column, upto: Column, total: Column) -> Column:
    if kind == "row_number":
        return rn
    if kind == "rank":
        return rank
    if kind == "dense_rank":
        return dense
    if kind == "percent_rank":
        return F.when(total > 1, (rank - 1) / (total - 1)).otherwise(F.lit(0.0)).cast("double")
    if kind == "cume_dist":
        return (upto / total).cast("double")
    if kind == "ntile":
        return _ntile(rn, total, arg)
    if kind == "count":
        return total
    raise ValueError(f"unknown window column {kind}")


def ranked(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Order,
    tie_break: Sequence[str],
    columns: Mapping[str, tuple],
    split: bool = True,
) -> DataFrame:
    """Add window columns that hold for groups of any size.

    Groups are cut into segments, so one that holds a third of all rows is no
    task's burden.  ``split=False`` is for groups that are small by what they
    are, such as the lines of an order: an ordinary window, nothing written.

    ``columns`` maps an output name to one of ``("row_number",)``, ``("rank",)``,
    ``("dense_rank",)``, ``("percent_rank",)``, ``("cume_dist",)``, ``("ntile", k)``,
    ``("count",)``, ``("lag", c)``, ``("lead", c)``, ``("running_sum", c)``,
    ``("total", c)``.
    ``tie_break`` completes ``order_by`` to a total order.
    """
    if partition_by and not split:
        return _plain(df, partition_by, order_by, tie_break, columns)
    return _by_segment(df, partition_by, order_by, tie_break, columns)


def _plain(df, partition_by, order_by, tie_break, columns) -> DataFrame:
    whole = W.partitionBy(*partition_by)
    by_value = whole.orderBy(*sort_columns(order_by))
    by_row = whole.orderBy(*sort_columns([*order_by, *tie_break]))
    out = []
    for name, (kind, *arg) in columns.items():
        if kind in ("lag", "lead"):
            col = getattr(F, kind)(arg[0]).over(by_row)
        elif kind == "running_sum":
            col = F.sum(arg[0]).over(by_row.rowsBetween(W.unboundedPreceding, W.currentRow))
        elif kind == "total":
            col = F.sum(arg[0]).over(whole)
        elif kind == "ntile":
            col = F.ntile(arg[0]).over(by_row)
        elif kind == "row_number":
            col = F.row_number().over(by_row)
        elif kind == "count":
            col = F.count(F.lit(1)).over(whole)
        else:
            col = getattr(F, kind)().over(by_value)
        if kind in ("row_number", "rank", "dense_rank", "ntile"):
            col = col.cast("bigint")
        out.append(col.alias(name))
    return df.select("*", *out)


def _by_segment(df, partition_by, order_by, tie_break, columns) -> DataFrame:
    group = list(partition_by)
    value_names = _names(order_by)
    kinds = {kind for kind, *_ in columns.values()}
    carried = sorted({arg[0] for kind, *arg in columns.values() if kind in ("lag", "lead")})
    summed = sorted({arg[0] for kind, *arg in columns.values() if kind in ("running_sum", "total")})
    seg = _segmented(df, sort_columns([*group, *order_by, *tie_break]))

    edges = _edges(seg, group, value_names, kinds, carried, summed)
    local = _local(seg, group, order_by, kinds, carried, summed)
    joined = local.alias("l").join(
        F.broadcast(edges.alias("e")),
        _all([F.col("l._seg") == F.col("e._seg"), *(same(F.col(f"l.{g}"), F.col(f"e.{g}")) for g in group)]),
        "left",
    )

    value = F.struct(*(F.col(f"l.{v}") for v in value_names))
    before = F.coalesce(F.col("e.before"), F.lit(0))
    rn = before + F.col("l._rn")
    total = F.coalesce(F.col("e.total"), F.col("l._n"))
    rank = dense = upto = None
    if kinds & {"rank", "percent_rank"}:
        rank = F.when(
            F.col("e.rank_from").isNotNull() & same(value, F.col("e.first_value")), F.col("e.rank_from")
        ).otherwise(before + F.col("l._rank"))
    if "dense_rank" in kinds:
        dense = F.coalesce(F.col("e.dense_before"), F.lit(0)) + F.col("l._dense")
    if "cume_dist" in kinds:
        upto = F.when(
            F.col("e.upto").isNotNull() & same(value, F.col("e.last_value")), F.col("e.upto")
        ).otherwise(before + F.col("l._upto"))

    out = []
    for name, (kind, *arg) in columns.items():
        if kind == "lag":
            col = F.when(F.col("l._rn") == 1, F.col(f"e.prev_{arg[0]}")).otherwise(F.col(f"l._lag_{arg[0]}"))
        elif kind == "lead":
            col = F.when(F.col("l._rn") == F.col("l._n"), F.col(f"e.next_{arg[0]}")).otherwise(F.col(f"l._lead_{arg[0]}"))
        elif kind == "running_sum":
            carry, here = F.col(f"e.sum_before_{arg[0]}"), F.col(f"l._run_{arg[0]}")
            col = F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
        elif kind == "total":
            col = F.when(F.col("e.total").isNotNull(), F.col(f"e.sum_all_{arg[0]}")).otherwise(F.col(f"l._all_{arg[0]}"))
        else:
            col = _derive(kind, arg[0] if arg else None, rn, rank, dense, upto, total)
        out.append(col.alias(name))
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), *out)


def _local(seg, group, order_by, kinds, carried, summed) -> DataFrame:
    """Window columns inside one segment of one group."""
    whole = W.partitionBy("_seg", *group)
    by_row = whole.orderBy("_at")
    by_value = whole.orderBy(*sort_columns(order_by))
    cols = [F.row_number().over(by_row).cast("bigint").alias("_rn"), F.count(F.lit(1)).over(whole).alias("_n")]
    if kinds & {"rank", "percent_rank"}:
        cols.append(F.rank().over(by_value).cast("bigint").alias("_rank"))
    if "dense_rank" in kinds:
        cols.append(F.dense_rank().over(by_value).cast("bigint").alias("_dense"))
    if "cume_dist" in kinds:
        cols.append(F.count(F.lit(1)).over(by_value.rangeBetween(W.unboundedPreceding, W.currentRow)).alias("_upto"))
    for c in carried:
        cols += [F.lag(c).over(by_row).alias(f"_lag_{c}"), F.lead(c).over(by_row).alias(f"_lead_{c}")]
    for c in summed:
        if "running_sum" in kinds:
            cols.append(F.sum(c).over(by_row.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(f"_run_{c}"))
        if "total" in kinds:
            cols.append(F.sum(c).over(whole).alias(f"_all_{c}"))
    return seg.select("*", *cols)


def _rows_at(seg: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows at the given positions, which are a few per segment."""
    return seg.join(F.broadcast(marks.distinct()), "_at")


def _touching(seg, group) -> DataFrame:
    """Rows of the groups that may go on in another segment: the first and the last of each."""
    if not group:
        return seg
    keys = ["_seg", *group]
    ends = seg.groupBy("_seg").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    wanted = _rows_at(seg.select(*keys, "_at"), ends.select(F.explode(F.array("lo", "hi")).alias("_at"))).select(*keys).distinct()
    return seg.alias("s").join(F.broadcast(wanted.alias("t")), _all([same(F.col(f"s.{k}"), F.col(f"t.{k}")) for k in keys]), "left_semi")


def _edges(seg, group, value_names, kinds, carried, summed) -> DataFrame:
    """What a group's segment must know of the group's other segments.

    At most two rows per segment, whatever the number of groups.  Positions are
    aggregated first and the rows there looked up after, which keeps the
    aggregates over all rows in hash form.
    """
    keys = ["_seg", *group]
    value = F.struct(*(F.col(v) for v in value_names))
    rows = _touching(seg, group).withColumn("_value", value)
    # both are written, being small and used several times: the rows are then read once for each
    ends = stage(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi"), *(F.sum(c).alias(f"sum_{c}") for c in summed)), "edges")
    there = stage(_rows_at(seg.select("_at", value.alias("_value"), *(F.struct(c).alias(f"_box_{c}") for c in carried)),
                           ends.select(F.explode(F.array("lo", "hi")).alias("_at"))), "edge-rows")
    at = lambda end, label: there.select(
        F.col("_at").alias(end), F.col("_value").alias(f"{label}_value"), *(F.col(f"_box_{c}").alias(f"{label}_{c}") for c in carried))
    # ends and the rows found there hold a few rows per segment
    parts = ends.join(F.broadcast(at("lo", "first")), "lo").join(F.broadcast(at("hi", "last")), "hi")
    by_value = bool(kinds & {"rank", "percent_rank", "dense_rank", "cume_dist"})
    if by_value:
        bounds = parts.select(*keys, "first_value", "last_value")
        on = [same(F.col(f"r.{k}"), F.col(f"p.{k}")) for k in keys]
        # counting values costs a shuffle of them, so only where a rank needs it
        distinct = F.count_distinct("_value") if "dense_rank" in kinds else F.lit(0).cast("bigint")
        runs = rows.alias("r").join(F.broadcast(bounds.alias("p")), _all(on)).select("r.*", "first_value", "last_value").groupBy(*keys).agg(
            F.count_if(same(F.col("_value"), F.col("first_value"))).alias("first_rows"),
            F.count_if(same(F.col("_value"), F.col("last_value"))).alias("last_rows"),
            distinct.alias("values"),
        )
        # both sides hold at most two rows per segment
        parts = parts.alias("p").join(F.broadcast(runs.alias("r")), _all(on)).select("p.*", "first_rows", "last_rows", "values")
    else:
        nothing = F.lit(0).cast("bigint")
        parts = parts.select("*", nothing.alias("first_rows"), nothing.alias("last_rows"), nothing.alias("values"))
    by_seg = W.partitionBy(*group).orderBy("_seg")
    earlier = by_seg.rowsBetween(W.unboundedPreceding, -1)
    upto_here = by_seg.rowsBetween(W.unboundedPreceding, W.currentRow)
    later = by_seg.rowsBetween(1, W.unboundedFollowing)
    whole = W.partitionBy(*group)
    mixed = ~same(F.col("first_value"), F.col("last_value"))

    linked = parts.select(
        "*",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("total"),
        (F.lag("_seg").over(by_seg).isNotNull() & same(F.lag("last_value").over(by_seg), F.col("first_value"))).alias("joins_prev"),
        (F.lead("_seg").over(by_seg).isNotNull() & same(F.lead("first_value").over(by_seg), F.col("last_value"))).alias("joins_next"),
    ).select(
        "*",
        # a run of equal values starts (ends) here unless the whole part continues its neighbour's run
        F.when(mixed | ~F.col("joins_prev"), F.col("before") + F.col("n") - F.col("last_rows") + 1).alias("run_from"),
        F.when(mixed | ~F.col("joins_next"), F.col("before") + F.col("first_rows")).alias("run_upto"),
    )
    return linked.select(
        "_seg", *group, "before", "total", "first_value", "last_value",
        (F.coalesce(F.sum("values").over(earlier), F.lit(0)) - F.sum(F.col("joins_prev").cast("bigint")).over(upto_here)).alias("dense_before"),
        F.when(F.col("joins_prev"), F.last("run_from", ignorenulls=True).over(earlier)).alias("rank_from"),
        F.when(F.col("joins_next"), F.first("run_upto", ignorenulls=True).over(later)).alias("upto"),
        *(F.lag(f"last_{c}").over(by_seg)[c].alias(f"prev_{c}") for c in carried),
        *(F.lead(f"first_{c}").over(by_seg)[c].alias(f"next_{c}") for c in carried),
        *(F.sum(f"sum_{c}").over(earlier).alias(f"sum_before_{c}") for c in summed),
        *(F.sum(f"sum_{c}").over(whole).alias(f"sum_all_{c}") for c in summed),
    )


def top_per_group(df: DataFrame, partition_by: Sequence[str], order_by: Order, k: int = 1) -> DataFrame:
    """First ``k`` rows of each group; Spark prunes to k rows per task before the shuffle."""
    w = W.partitionBy(*partition_by).orderBy(*sort_columns(order_by))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def page(df: DataFrame, order: Order, start_row: int, end_row: int, name: str = "rnum", deep: bool = False) -> DataFrame:
    """Rows ``start_row..end_row`` (1-based, inclusive) of the ordered result, numbered.

    A page is a top-k, which brings ``end_row`` rows of every task to a single
    one; for a reader far down the result, ``deep`` indexes the rows instead.
    """
    if deep:
        rows = global_index(df, order, name).filter(F.col(name).between(start_row - 1, end_row - 1))
        return rows.withColumn(name, F.col(name) + 1)
    rows = df.orderBy(*sort_columns(order)).offset(start_row - 1).limit(end_row - start_row + 1)
    # the window below sees one page at most
    return rows.withColumn(name, F.row_number().over(W.orderBy(*sort_columns(order))).cast("bigint") + F.lit(start_row - 1))


def listagg_parts(
    df: DataFrame,
    group: Sequence[str],
    items: Mapping[str, str],
    order_by: Order,
    tie_break: Sequence[str],
    separator: str = ", ",
    part_rows: int = 10_000,
    split: bool = True,
) -> DataFrame:
    """Ordered string aggregation, long groups continued in numbered parts.

    ``items`` maps output names to the columns to list.  A group of up to
    ``part_rows`` items gives one row, ``part_no`` 1; a longer one goes on in
    part 2, 3, ...  No item is dropped and no task ever holds more than one part.
    """
    numbered = ranked(df, group, order_by, tie_break, {"_item_no": ("row_number",)}, split)
    parts = numbered.withColumn("part_no", F.floor((F.col("_item_no") - 1) / part_rows) + 1)
    listed = F.array_sort(F.collect_list(F.struct("_item_no", *(F.col(c).alias(f"_{o}") for o, c in items.items()))))
    return parts.groupBy(*group, "part_no").agg(listed.alias("_listed")).select(
        *group,
        F.col("part_no").cast("bigint").alias("part_no"),
        F.size("_listed").cast("bigint").alias("items"),
        *(
            F.array_join(F.col("_listed").getField(f"_{o}"), separator).alias(o)
            for o in items
        ),
    )
