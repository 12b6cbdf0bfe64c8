"""Digests of rows, keys and buckets of keys: what two tables differ in, found without moving their rows.

A row's digest is two 64-bit hashes of its cells, in a form in which equal
cells of both sides are equal.  Digests add up, so a key, or a bucket of keys,
has one too: the number of its rows and the sums of the halves of their hashes,
source less target.  All of them zero means the same rows with the same number
of copies, up to a chance of about 2^-128 for a key.

The comparison goes down from buckets to keys, and from keys to cells, only
where digests differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cutover.functions.equality import hashable
from cutover.session import stage

#: Buckets of keys; a task sends at most one digest for each.
BUCKETS = 1 << 16
_LOW = (1 << 32) - 1
_SUMS = ("_d0", "_d1", "_d2", "_d3")

c = F.col


def shared_columns(source: DataFrame, target: DataFrame, skip: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(source name, target name) of the columns both sides have, in source order."""
    theirs = {x.lower(): x for x in target.columns}
    skipped = {x.lower() for x in skip}
    return [(x, theirs[x.lower()]) for x in source.columns if x.lower() in theirs and x.lower() not in skipped]


def _halves(cells: Sequence[Column]) -> list[Column]:
    """Two hashes of the cells as four numbers below 2^32, whose sums stay within a long for 2^31 rows."""
    if not cells:
        return [F.lit(0).cast("bigint") for _ in _SUMS]
    # a hash passes nulls over, so where they are is hashed as well
    marks = [reduce(lambda a, b: a + b, (F.when(x.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, x in enumerate(cells[at : at + 60])))
             for at in range(0, len(cells), 60)]
    hashes = [F.xxhash64(*marks, *cells), F.xxhash64(F.lit("second"), *cells, *marks)]
    return [half for h in hashes for half in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]


def _sided(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, row counts and digests of both sides, the target's counted as negative."""
    theirs = {x.lower(): x for x in target.columns}
    st, tt = source.schema, target.schema
    shared = shared_columns(source, target, keys)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    s = _halves([h for x, y in shared for h in hashable(c(x), st[x].dataType, tt[y].dataType)])
    t = _halves([h for x, y in shared for h in hashable(c(y), tt[y].dataType, st[x].dataType)])
    return source.select(*(c(k) for k in keys), one.alias("sn"), none.alias("tn"), *(h.alias(n) for h, n in zip(s, _SUMS))).unionAll(
        target.select(*(c(theirs[k.lower()]).alias(k) for k in keys), none.alias("sn"), one.alias("tn"), *((-h).alias(n) for h, n in zip(t, _SUMS))))


def _met(sided: DataFrame, *by: Column | str) -> DataFrame:
    return sided.groupBy(*by).agg(*(F.sum(n).alias(n) for n in ("sn", "tn", *_SUMS)))


def _alike() -> Column:
    return reduce(lambda a, b: a & b, (c(n) == 0 for n in _SUMS))


def bucket_digests(source: DataFrame, target: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, sn, tn, alike): rows of each side in a bucket of keys, and whether both sides hold the same rows."""
    sided = _sided(source, target, keys).withColumn("bucket", _bucket(keys, buckets))
    return _met(sided, "bucket").select("bucket", "sn", "tn", (_alike() & (c("sn") == c("tn"))).alias("alike"))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def key_digests(source: DataFrame, target: DataFrame, keys: Sequence[str], buckets: DataFrame | None = None, n_buckets: int = BUCKETS) -> DataFrame:
    """(keys, sn, tn, alike) for each key of either side, or of the given ``buckets``.

    One shuffle of digests; copies of a key add up before it.
    """
    sided = _sided(source, target, keys)
    if buckets is not None:
        sided = sided.withColumn("bucket", _bucket(keys, n_buckets)).join(buckets.select("bucket"), "bucket", "left_semi")
    return _met(sided, *keys).select(*keys, "sn", "tn", _alike().alias("alike"))


def change_of() -> Column:
    """What has happened to a key, from its digest; null where nothing has."""
    return (F.when((c("sn") > 1) | (c("tn") > 1), "duplicate_key").when(c("tn") == 0, "missing_in_target")
            .when(c("sn") == 0, "extra_in_target").when(~c("alike"), "changed"))


def changed_keys(source: DataFrame, target: DataFrame, keys: Sequence[str], unique: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The keys with a finding as (keys, sn, tn, alike, change), written once, and the rows of both sides.

    ``unique`` says that repeated keys need no report where both sides have the
    same rows.  Then digests of buckets are compared first, and only the keys of
    buckets that differ are looked at; equal tables move nothing but digests of
    buckets, and are not read again.
    """
    if not unique:
        seen = Observation()
        digests = key_digests(source, target, keys).observe(seen, F.sum("sn").alias("sn"), F.sum("tn").alias("tn"))
        found = stage(digests.withColumn("change", change_of()).filter("change is not null"), "changed-keys")
        rows = seen.get
        return found, {"source_rows": rows["sn"] or 0, "target_rows": rows["tn"] or 0}
    buckets = stage(bucket_digests(source, target, keys), "bucket-digests")
    rows = buckets.agg(F.sum("sn").alias("sn"), F.sum("tn").alias("tn"), F.count_if(~c("alike")).alias("differ")).first()
    counts = {"source_rows": rows.sn or 0, "target_rows": rows.tn or 0}
    differing = buckets.filter(~c("alike")) if rows.differ else buckets.limit(0)
    digests = key_digests(source, target, keys, differing) if rows.differ else key_digests(source.limit(0), target.limit(0), keys)
    return stage(digests.withColumn("change", change_of()).filter("change is not null"), "changed-keys"), counts


def rows_of_keys(df: DataFrame, names: Sequence[str], wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys, called ``names`` here, are among the wanted ones; null equals null."""
    marked = wanted.select(*(c(k).alias(f"_w{i}") for i, k in enumerate(keys)))
    on = reduce(lambda a, b: a & b, (df[n].eqNullSafe(marked[f"_w{i}"]) for i, n in enumerate(names)))
    return df.join(marked, on, "left_semi")
