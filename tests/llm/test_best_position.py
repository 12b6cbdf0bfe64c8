"""Ranked search against a plain scan, the stopping rule, and odd rows."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutover.llm import best_position
from cutover.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import check  # noqa: E402

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(docs, items, k=20):
    counts = [(d, Counter(best_position.terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries: dict = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(best_position.terms_of(text))
    out = set()
    for item, words in queries.items():
        scored = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in words.items() if t in c)
            if s > 0:
                scored.append((-s, -1 if d is None else d, d))
        out |= {(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def found(spark, docs, items, **more):
    out = best_position.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return [tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("entries", [100, 500_000])
def test_agrees_with_a_scan(spark, monkeypatch, entries):
    monkeypatch.setattr(best_position, "SHARD_ENTRIES", entries)
    rng = random.Random(entries)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # ties beyond the k-th place
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(20)] + [(50, docs[3][1])]
    got = found(spark, docs, items)
    assert len(got) == len(set(got)) and set(got) == plain(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(best_position, "BLOCK_WORDS", 5)
    docs = [(i, f"a{i % 3} b{i % 5} c{i % 7} common") for i in range(50)]
    items = [(i, f"a{i % 3} b{i % 4} common") for i in range(12)]
    assert set(found(spark, docs, items, k=5)) == plain(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ,;! "), (None, "apple Pear"), (5, "APPLE pear"), (5, "apple pear"), (6, "äpfel Äpfel"), (7, "apple " * 20_000), (8, "none")]
    items = [(None, "apple"), (1, None), (2, ""), (3, "pear"), (3, "Apple"), (4, "äpfel"), (5, "nowhere")]
    got = found(spark, docs, items)
    assert sorted(got, key=repr) == sorted(plain_rows(docs, items), key=repr)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def plain_rows(docs, items):
    """Like ``plain``, but two documents with one id stay two rows."""
    marked = [(k, t) for k, (d, t) in enumerate(sorted(docs, key=lambda r: -1 if r[0] is None else r[0]))]
    ids = sorted((r[0] for r in docs), key=lambda d: -1 if d is None else d)
    return [(item, rank, ids[d], s) for item, rank, d, s in plain(marked, items)]


def test_clashing_columns(spark):
    docs, items = [(1, "a b"), (2, "a")], [(7, "a b b")]
    more = {c: F.lit("x") for c in ("doc", "item", "_text", "n", "terms", "rank", "score", "shard", "block", "w", "term", "times")}
    out = best_position.ranked(spark.createDataFrame(docs, DOCS).withColumns(more), spark.createDataFrame(items, ITEMS).withColumns(more))
    assert {tuple(r) for r in out.collect()} == plain(docs, items) and out.columns == ["item_id", "rank", "doc_id", "score"]


def shard_of(lists):
    rows = [(t, d, u) for t, entries in enumerate(lists) for d, u in entries]
    t, d, u = (np.array(x, np.int64) for x in zip(*rows))
    return best_position.Shard(t, d, u, len(lists), int(d.max()) + 1)


def test_stops_early_but_not_at_ties():
    # the best documents stand first in both lists; the rest is far below
    lists = [[(d, 1000 - d if d < 8 else 10) for d in range(5000)], [(d, 900 - d if d < 8 else 10) for d in range(5000)]]
    docs, scores, read = shard_of(lists).best(np.array([0, 1]), np.array([1, 1]), 3, step=4)
    assert docs.tolist() == [0, 1, 2] and scores.tolist() == [1900, 1898, 1896] and read <= 32
    # all documents tie: the smallest ids win, whatever is read first
    lists = [[(d, 7) for d in range(100)], [(d, 7) for d in range(100)]]
    docs, _, _ = shard_of(lists).best(np.array([0, 1]), np.array([1, 1]), 3, step=4)
    assert docs.tolist() == [0, 1, 2]


def test_direct_access_moves_the_best_position():
    # the second list's order is the first's: direct accesses mark its top as seen before it is read
    lists = [[(d, 100 - d) for d in range(60)], [(d, 50 if d < 30 else 1) for d in range(60)]]
    docs, scores, read = shard_of(lists).best(np.array([0, 1]), np.array([3, 1]), 2, step=8)
    assert docs.tolist() == [0, 1] and scores.tolist() == [350, 347] and read == 16


def test_query_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    out = QUERIES["op13_ranked_search"](spark, folder)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    result = check.connect(folder).execute(ORACLES["op13_ranked_search"])
    assert check.rows_of(out.columns, out.collect()) == check.rows_of([d[0] for d in result.description], result.fetchall())
