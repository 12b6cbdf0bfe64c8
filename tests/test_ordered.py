import random

import pytest
from pyspark.sql import functions as F

from cutover.operators import ordered as O

WANT = {
    "rn": ("row_number",), "rk": ("rank",), "dr": ("dense_rank",), "pr": ("percent_rank",), "cd": ("cume_dist",),
    "nt": ("ntile", 4), "n": ("count",), "lg": ("lag", "x"), "ld": ("lead", "x"), "rs": ("running_sum", "x"),
    "tot": ("total", "x"),
}


def brute(rows, desc):
    """Window columns by definition, one group at a time, in plain Python."""
    groups = {}
    for g, v, k, x in rows:
        groups.setdefault(g, []).append((v, k, x))
    out = {}
    for g, items in groups.items():
        if desc:
            items.sort(key=lambda t: (t[0] is not None, -(t[0] or 0), t[1]))
        else:
            items.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1]))
        values = [t[0] for t in items]
        n, run = len(items), None
        q, r = divmod(n, 4)
        sizes = [q + 1] * r + [q] * (4 - r)
        tiles = [b + 1 for b, s in enumerate(sizes) for _ in range(s)]
        seen = []
        whole = sum(t[2] for t in items if t[2] is not None) if any(t[2] is not None for t in items) else None
        for i, (v, k, x) in enumerate(items):
            if not seen or seen[-1] != v:
                seen.append(v)
            first = values.index(v)
            last = n - 1 - values[::-1].index(v)
            if x is not None:
                run = (run or 0) + x
            out[(g, k)] = (
                i + 1, first + 1, len(seen), first / (n - 1) if n > 1 else 0.0, (last + 1) / n, tiles[i], n,
                items[i - 1][2] if i else None, items[i + 1][2] if i + 1 < n else None, run, whole,
            )
    return out


def rows_with_hot_group(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        g = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "z"])
        v = 5 if rng.random() < 0.4 else rng.choice([None, *range(12)])
        rows.append((g, v, k, None if rng.random() < 0.1 else rng.randrange(100)))
    return rows


@pytest.mark.parametrize("seed,desc,group,split", [
    (1, True, ["g"], True), (2, False, ["g"], True), (3, True, [], True), (4, False, [], True), (5, True, ["g"], False),
])
def test_ranked_equals_definition(many_segments, seed, desc, group, split):
    rows = rows_with_hot_group(seed)
    if not group:
        rows = [("all", *r[1:]) for r in rows]
    df = many_segments.createDataFrame(rows, "g string, v int, k long, x long").repartition(5)
    got = O.ranked(df, group, [("v", "desc" if desc else "asc")], ["k"], WANT, split=split)
    result = {(r["g"], r["k"]): tuple(r[c] for c in WANT) for r in got.collect()}
    expected = brute(rows, desc)
    assert result.keys() == expected.keys()
    for key in expected:
        assert result[key] == pytest.approx(expected[key]), key


def test_ranked_one_value_everywhere(many_segments):
    df = many_segments.range(500).select(F.lit("g").alias("g"), F.lit(1).alias("v"), F.col("id").alias("k"), F.lit(1).cast("long").alias("x"))
    got = O.ranked(df, ["g"], ["v"], ["k"], WANT).collect()
    assert {r.rk for r in got} == {1} and {r.dr for r in got} == {1} and {r.cd for r in got} == {1.0}
    assert sorted(r.rn for r in got) == list(range(1, 501))
    assert all(r.rs == r.rn for r in got)


def test_global_index_is_gap_free(many_segments):
    df = many_segments.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = O.global_index(df, ["k"]).collect()
    assert all(r.k == r.row_index for r in got) and len(got) == 1000
    with pytest.raises(ValueError):
        O.global_index(df, [])


def test_page_and_top(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [(r.k, r.rnum) for r in O.page(df, [("k", "desc")], 11, 13).orderBy("rnum").collect()] == [(89, 11), (88, 12), (87, 13)]
    assert [(r.k, r.rnum) for r in O.page(spark.range(3000).withColumnRenamed("id", "k"), ["k"], 2001, 2002, deep=True).orderBy("rnum").collect()] == [(2000, 2001), (2001, 2002)]
    top = O.top_per_group(df.withColumn("g", F.col("k") % 3), ["g"], [("k", "desc")], 1)
    assert sorted(r.k for r in top.collect()) == [97, 98, 99]


@pytest.mark.parametrize("split", [True, False])
def test_listagg_continues_in_parts(many_segments, split):
    df = many_segments.range(25).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("s"), F.col("id").alias("k"))
    got = O.listagg_parts(df, ["g"], {"ids": "s"}, [("k", "asc")], [], part_rows=10, split=split).orderBy("part_no").collect()
    assert [r.items for r in got] == [10, 10, 5]
    assert ", ".join(r.ids for r in got) == ", ".join(str(i) for i in range(25))
