"""Near-duplicates against all pairs, and the order-free parts of the forest."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cutover.llm import near_forest


def _sets(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def brute_force(texts, size, percent):
    """Number of shingles and component of each text, by comparing all pairs."""
    sets, root = [_sets(t, size) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def corpus(seed, groups, copies, length, changes):
    pick = random.Random(seed)
    word = lambda: pick.choice(["the", "of", "and", *(f"w{pick.randint(0, 400)}" for _ in range(4))])
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(pick.randint(1, length))]
        for _ in range(pick.randint(1, copies)):
            own = list(base)
            for _ in range(pick.randint(0, changes)):
                own[pick.randrange(len(own))] = word().upper()
            texts.append(" ".join(own))
    pick.shuffle(texts)
    return [*texts, None, "", " \n", "one", "One", "one two"]


@pytest.mark.parametrize("case", [(1, 60, 6, 120, 8, 2), (2, 3, 150, 90, 9, 2), (3, 40, 8, 200, 6, 5)])
def test_components_by_brute_force(spark, case):
    seed, groups, copies, length, changes, size = case
    texts = corpus(seed, groups, copies, length, changes)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r.doc_id: r for r in near_forest.near_duplicates(docs, size, 80).collect()}
    want = brute_force(texts, size, 80)
    assert [(out[k].n_shingles, out[k].component_id) for k in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.values())


def test_neighbours_across_tasks(many_segments):
    """Candidates are the same whether the rows lie in one task or in many."""
    spark = many_segments
    texts = corpus(7, 80, 5, 100, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = near_forest.sketches(docs, 2).filter("_d1 IS NOT NULL").groupBy("_d1", "_d2").agg(F.min("_id").alias("_rep"), F.first("n_shingles").alias("n_shingles"), F.first("_sig").alias("_sig")).cache()
    found = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(set(map(tuple, near_forest.candidates(classes, 80, 6).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] and found[0]


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(300, 200), (300, 250), (200, 299)] + [(5, 5), (7, 6)]
    out = dict(near_forest.components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert all(out[k] == 0 for k in range(1, 61)) and all(out[k] == 100 for k in range(101, 180))
    assert out[300] == out[250] == out[299] == 200 and near_forest.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_trees_grow_with_the_corpus():
    assert near_forest.trees_for(1) <= near_forest.trees_for(10**5) < near_forest.trees_for(10**9)


def test_word_hashes_tell_words_apart():
    from cutover.llm.common import word_hashes

    words = [f"{a}{b}{c}" for a in "abé" for b in "0123456789" for c in "0123456789"] + ["x" * k for k in range(1, 200)] + ["ab", "ba", "AB", "aab", "aba", "baa"]
    assert len(set(word_hashes(" ".join(words), False).tolist())) == len(set(words))
    assert len(set(word_hashes(" ".join(words), True).tolist())) == len({w.lower() for w in words})
