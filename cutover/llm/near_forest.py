"""Near-duplicates by an LSH forest over MinHash signatures.

1. Documents with equal shingle sets become one class, wherever they are.
2. Each tree of the forest sorts the classes by signature values in an order of
   its own.  Neighbours in that order share the longest prefixes, so how deep
   two of them must agree adapts to how dense the region is.  The next
   ``NEIGHBOURS`` rows that share at least ``LEAST_PREFIX`` values are
   candidates; the sort is by range, so a dense region spreads over tasks.
3. Candidates whose signatures agree far too little are dropped; the others
   join classes to clusters.  The most alike candidates of each class are
   confirmed on their full sets, which gives components.
4. A cluster may hold several components then.  The classes outside its largest
   one are compared with all of the cluster, exactly and in blocks of at most
   ``BLOCK`` classes a side, so no link inside a cluster is left to chance and
   no pair is ever made a row.
5. Components are found by hooking and pointer jumping over written tables.

The number of trees follows from the number of classes so that a pair right at
the threshold is missed by all of them with a probability of about ``MISS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.llm.common import shingle_hashes, with_columns_by_batch, without, word_hashes
from cutover.session import stage

SHINGLE, PERCENT = 5, 80
VALUES, PREFIX = 128, 8
NEIGHBOURS, LEAST_PREFIX = 4, 2
#: Two unrelated documents agree in about one of so many signature values.
UNRELATED = 32
MISS = 1e-4
#: Candidates pass if at least so many of the short signature's 64 four-bit values agree:
#: at similarity 0.8 that fails once in about 10^6 pairs.
SHORT, LEAST_AGREEING = 64, 37
#: Classes of a cluster that are compared with as many others in one group, and shingles at a time.
BLOCK, COLUMNS = 1024, 4096

SKETCH_DDL = "n_shingles long, _d1 long, _d2 long, _sig binary"
_rng = np.random.default_rng(31)
_A = _rng.integers(1, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the whole text is one if it has fewer words, none if it has no word."""
    words = word_hashes(text or "", fold=True)
    if not len(words):
        return words
    if len(words) < size:
        return shingle_hashes(words, len(words)) ^ np.uint64(0x5DEECE66D)
    return np.unique(shingle_hashes(words, size))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each of ``VALUES`` permutations of the hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 4096):
            part = x[None, at : at + 4096] * _A[:, None] + _B[:, None]
            part ^= part >> np.uint32(15)
            np.minimum(out, (part * np.uint32(0x85EBCA6B)).min(1), out=out)
    return out


def trees_for(classes: int) -> int:
    """Trees needed: a pair must agree about as deep as unrelated classes fill a region."""
    depth = max(2.0, math.log(max(classes, 2)) / math.log(UNRELATED))
    return math.ceil(math.log(MISS) / math.log(1 - (PERCENT / 100) ** depth))


def orders(trees: int) -> np.ndarray:
    """Which signature values each tree sorts by."""
    rng = np.random.default_rng(17)
    return np.stack([rng.permutation(VALUES)[:PREFIX] for _ in range(trees)])


def sketches(df: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _h, n_shingles, _d1, _d2, _sig) of each row; digest and signature are null for an empty set."""

    def rows(texts: list) -> list[tuple]:
        out = []
        for t in texts:
            s = shingle_set(t, size)
            if not len(s):
                out.append((0, None, None, None))
                continue
            d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            out.append((len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), signature(s).tobytes()))
        return out

    named = df.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).cast("string").alias("_t"))
    return with_columns_by_batch(named, SKETCH_DDL, rows, ("_t",), drop=("_t",))


def _forest_rows(trees: int):
    picks = orders(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("_sig").to_pylist()), np.uint32).reshape(n, VALUES)
            low = (sig[:, :SHORT] & np.uint32(15)).astype(np.uint8)
            short = pa.array([x.tobytes() for x in low[:, 0::2] << 4 | low[:, 1::2]], pa.binary())
            for tree, pick in enumerate(picks):
                path = sig[:, pick].astype(">u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, tree, np.int32)), pa.array([x.tobytes() for x in path], pa.binary()), batch.column("_rep"), batch.column("n_shingles"), short],
                    names=["tree", "path", "id", "n", "short"])

    return run


_ROW_DDL = "tree int, path binary, id long, n long, short binary"
_PAIR_DDL = "x long, y long, agree int, edge int, tree int, path binary, id long, n long, short binary, last boolean, k int"
_BITS = np.array([(v >> 4 == 0) + (v & 15 == 0) for v in range(256)], np.uint8)


def _close(tree: np.ndarray, path: np.ndarray, ids: np.ndarray, n: np.ndarray, short: np.ndarray, new: int, percent: int) -> tuple[np.ndarray, ...]:
    """Candidate pairs of sorted rows, of which at least one is among the last ``new`` rows."""
    found = []
    for step in range(1, NEIGHBOURS + 1):
        b = np.arange(max(step, len(ids) - new), len(ids))
        a = b - step
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = (tree[a] == tree[b]) & (path[a, :LEAST_PREFIX] == path[b, :LEAST_PREFIX]).all(1) & (100 * small >= percent * large)
        a, b = a[ok], b[ok]
        agree = _BITS[short[a] ^ short[b]].sum(1, dtype=np.int32)
        ok = agree >= LEAST_AGREEING
        found.append((ids[a[ok]], ids[b[ok]], agree[ok]))
    a, b, agree = (np.concatenate(v) for v in zip(*found, strict=True))
    return np.minimum(a, b), np.maximum(a, b), agree


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    return (
        batch.column("tree").to_numpy(), np.frombuffer(b"".join(batch.column("path").to_pylist()), ">u4").reshape(n, PREFIX), batch.column("id").to_numpy(),
        batch.column("n").to_numpy(), np.frombuffer(b"".join(batch.column("short").to_pylist()), np.uint8).reshape(n, SHORT // 2))


def _neighbours(percent: int):
    """Pairs within a task's sorted rows, and its first and last rows, for pairs across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[np.ndarray, ...] | None = None
        first: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _columns(batch)
            if len(first) < NEIGHBOURS:
                first += [tuple(c[k] for c in cols) for k in range(min(NEIGHBOURS - len(first), len(cols[0])))]
            joined = cols if held is None else tuple(np.concatenate([h, c]) for h, c in zip(held, cols, strict=True))
            x, y, agree = _close(*joined, new=len(cols[0]), percent=percent)
            yield _pairs(x, y, agree)
            held = tuple(c[-NEIGHBOURS:] for c in joined)
        if held is not None:
            yield _edges([tuple(c[k] for c in held) for k in range(len(held[0]))], part + 1, True)
            yield _edges(first, part, False)

    return run


def _pairs(x: np.ndarray, y: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    rest = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(agree, pa.int32()), *rest], names=["x", "y", "agree", "edge", "tree", "path", "id", "n", "short", "last", "k"])


def _edges(rows: list[tuple], edge: int, last: bool) -> pa.RecordBatch:
    n = len(rows)
    values = [
        pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array([int(r[0]) for r in rows], pa.int32()),
        pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([int(r[2]) for r in rows], pa.int64()), pa.array([int(r[3]) for r in rows], pa.int64()),
        pa.array([r[4].tobytes() for r in rows], pa.binary()), pa.array([last] * n, pa.bool_()), pa.array(range(n), pa.int32())]
    return pa.RecordBatch.from_arrays(values, names=["x", "y", "agree", "edge", "tree", "path", "id", "n", "short", "last", "k"])


def candidates(classes: DataFrame, percent: int, trees: int) -> DataFrame:
    """(x, y, agree) with x < y: neighbours in some tree's order whose short signatures agree enough."""
    rows = classes.select("_rep", "n_shingles", "_sig").mapInArrow(_forest_rows(trees), _ROW_DDL)
    keys = ("tree", "path", "id")
    near = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_neighbours(percent), _PAIR_DDL), "near-neighbours")
    pairs = near.filter("x IS NOT NULL").select("x", "y", "agree")

    def across(table: pa.Table) -> pa.Table:
        """The last rows of one task and the first ones of the next: a fixed number."""
        t = table.sort_by([("last", "descending"), ("k", "ascending")]).combine_chunks()
        cols = _columns(t.to_batches()[0])
        x, y, agree = _close(*cols, new=int(np.sum(~t.column("last").to_numpy(zero_copy_only=False))), percent=percent)
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "agree": pa.array(agree, pa.int32())})

    seams = near.filter("edge IS NOT NULL").groupBy("edge").applyInArrow(across, "x long, y long, agree int")
    return pairs.union(seams).filter("x < y").groupBy("x", "y").agg(F.max("agree").alias("agree"))


def _packed_set(text: str | None, size: int) -> bytes:
    """The set as sorted 40-bit hashes."""
    h = np.unique(shingle_set(text, size) >> np.uint64(24))
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are alike enough."""
    left = sets.select(F.col("_rep").alias("x"), F.col("set").alias("of_x"))
    right = sets.select(F.col("_rep").alias("y"), F.col("set").alias("of_y"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("of_x"), batch.column("of_y"), strict=True):
                a, b = _unpacked(a.as_py()), _unpacked(b.as_py())
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return both.select("x", "y", "of_x", "of_y").mapInArrow(run, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the ends of edges (x, y): the smallest id that can be reached.

    Every vertex hooks on to its smallest neighbour; pointers are followed by
    doubling; the edges between different roots go on to the next turn.  Each
    turn is written, and vertices that are their own root are left out of the
    pointers.
    """
    edges = stage(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct(), "near-edges")
    roots = None
    while not edges.isEmpty():
        hooks = stage(edges.groupBy("x").agg(F.min("y").alias("y")), "near-hooks")
        while True:
            up = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            jumped = stage(hooks.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "near-hooks")
            hooks = jumped.select("x", "y")
            if jumped.filter("moved").isEmpty():
                break
        root = hooks.select(F.col("x").alias("_v"), F.col("y").alias("_r"))
        if roots is None:
            roots = hooks.select(F.col("x").alias("id"), F.col("y").alias("root"))
        else:
            old = roots.join(root, F.col("root") == F.col("_v"), "left").select("id", F.coalesce("_r", "root").alias("root"))
            roots = stage(old.union(hooks.join(roots, F.col("x") == F.col("id"), "left_anti").select("x", "y")), "near-roots")
        moved = edges.join(root, F.col("x") == F.col("_v"), "left").select(F.coalesce("_r", "x").alias("x"), "y")
        moved = moved.join(root, F.col("y") == F.col("_v"), "left").select("x", F.coalesce("_r", "y").alias("y"))
        edges = stage(moved.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "near-edges")
    return edges.select(F.col("x").alias("id"), F.col("y").alias("root")) if roots is None else roots


def _most_alike(pairs: DataFrame) -> DataFrame:
    """For each class, the candidate that agrees most, and the smallest one that agrees about as much as the threshold asks for."""
    ends = pairs.select(F.col("x").alias("id"), F.col("y").alias("other"), "agree").union(pairs.select("y", "x", "agree"))
    best = ends.groupBy("id").agg(F.max(F.struct("agree", -F.col("other"))).alias("best"), F.min(F.when(F.col("agree") >= SHORT * 81 // 100, F.col("other"))).alias("least"))
    picked = best.select("id", F.explode(F.array(-F.col("best")["col2"], F.col("least"))).alias("other")).filter("other IS NOT NULL")
    return picked.select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y")).distinct()


def _members(ends: DataFrame, clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, cluster, component) of each class that has a candidate."""
    of = lambda df, name: df.select(F.col("id").alias("_rep"), F.col("root").alias(f"_{name}"))
    found = ends.join(of(clusters, "cluster"), "_rep", "left").join(of(roots, "component"), "_rep", "left")
    return found.select(F.col("_rep").alias("id"), F.coalesce("_cluster", "_rep").alias("cluster"), F.coalesce("_component", "_rep").alias("component"))


def _links_of_outliers(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): components of a cluster that some link joins, other than within the largest component."""
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    # of clusters with several components: the largest one, and how many classes are in and outside of it
    split = sizes.groupBy("cluster").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("most")).filter("parts > 1")
    split = split.select("cluster", F.col("most")["component"].alias("largest"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")["n"]) / BLOCK).alias("outer"), "n")
    total = split.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return members.select(F.col("id").alias("x"), F.col("id").alias("y")).limit(0)
    rows = members.join(split.drop("n"), "cluster")
    small = (F.col("blocks") == 1) & (F.col("outer") == 1)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    shown = ["id", "cluster", "component", small.alias("small")]
    inner = rows.select(*shown, F.lit(False).alias("outlier"), part("blocks").alias("b"), every("outer").alias("a"))
    outer = rows.filter("component <> largest").select(*shown, F.lit(True).alias("outlier"), part("outer").alias("a"), every("blocks").alias("b")).select(*inner.columns)
    # small clusters share groups; a large one has a group for each pair of its blocks
    shared = F.pmod(F.xxhash64("cluster", F.lit("group")), F.lit(-(-total // BLOCK)))
    keyed = inner.union(outer).withColumn("g", F.when(F.col("small"), shared)).withColumn("c", F.when(~F.col("small"), F.col("cluster")))
    keyed = keyed.join(sets, F.col("id") == F.col("_rep")).select("g", "c", "a", "b", "id", "cluster", "component", "outlier", "set")

    def compare(table: pa.Table) -> pa.Table:
        cluster = table.column("cluster").to_numpy()
        component = table.column("component").to_numpy()
        outlier = table.column("outlier").to_numpy(zero_copy_only=False)
        data = table.column("set").to_pylist()
        found: set[tuple[int, int]] = set()
        order = np.argsort(cluster, kind="stable")
        for rows_of in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            left, right = rows_of[outlier[rows_of]], rows_of[~outlier[rows_of]]
            if len(left) and len(right):
                x, y = _alike([_unpacked(data[k]) for k in left], [_unpacked(data[k]) for k in right], percent)
                pairs = np.stack([component[left[x]], component[right[y]]], 1)
                found |= set(map(tuple, np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).tolist()))
        return pa.table({"x": pa.array([p[0] for p in found], pa.int64()), "y": pa.array([p[1] for p in found], pa.int64())})

    return keyed.groupBy("g", "c", "a", "b").applyInArrow(compare, "x long, y long").distinct()


def _alike(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left, in right) of sets that are alike enough, counted exactly by products of membership matrices."""
    l_sizes, r_sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    l_all, r_all = np.concatenate(left), np.concatenate(right)
    words = np.intersect1d(l_all, r_all)  # others are in no intersection
    shared = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for sizes, values in ((l_sizes, l_all), (r_sizes, r_all)):
        row, at = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(words, values)
        ok = at < len(words)
        ok[ok] = words[at[ok]] == values[ok]
        by_word = np.argsort(at[ok], kind="stable")
        placed.append((row[ok][by_word], at[ok][by_word], len(sizes)))
    for low in range(0, len(words), COLUMNS):
        parts = []
        for row, at, n in placed:
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(words) - low)), np.float32)
            m[row[a:b], at[a:b] - low] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    counts = shared.astype(np.int64)
    return np.nonzero((counts > 0) & (100 * counts >= percent * (l_sizes[:, None] + r_sizes[None] - counts)))


def document_classes(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _h, n_shingles, component_id, kept) of each row of ``df``; _h is a hash of its text."""
    sketched = stage(sketches(df, shingle, doc_id, text), "near-sketches")
    digest = ["_d1", "_d2"]
    # copies meet where they are read; a class may have any number of rows
    full = sketched.filter("_d1 IS NOT NULL AND _id IS NOT NULL")
    classes = stage(full.groupBy(*digest).agg(F.min("_id").alias("_rep"), F.first("n_shingles").alias("n_shingles"), F.first("_sig").alias("_sig")), "near-classes")
    # the same id may have several texts; its classes are one component then
    pairs = stage(candidates(classes, percent, trees_for(classes.count())), "near-pairs")
    ends = pairs.select(F.col("x").alias("_rep")).union(pairs.select("y")).distinct()

    def packed(texts: list) -> list[tuple]:
        return [(_packed_set(t, shingle),) for t in texts]

    texts = df.select(F.col(doc_id).alias("_rep"), F.col(text).cast("string").alias("_t")).join(ends.hint("shuffle_hash"), "_rep", "left_semi")
    sets = stage(_with_sets(texts, packed), "near-sets")
    first = stage(_most_alike(pairs), "near-first")
    links = confirmed(first, sets, percent)
    roots = components(links)
    members = stage(_members(ends, components(pairs), roots), "near-members")
    joined = components(_links_of_outliers(members, sets, percent)).select(F.col("id").alias("_v"), F.col("root").alias("_r"))
    final = roots.join(joined, F.col("root") == F.col("_v"), "left").select("id", F.coalesce("_r", "root").alias("root"))
    final = final.union(joined.join(roots, F.col("_v") == F.col("id"), "left_anti").select("_v", "_r"))
    labelled = classes.select(*digest, "_rep").join(final, F.col("_rep") == F.col("id"), "left").select(*digest, F.coalesce("root", "_rep").alias("_label"))
    out = sketched.select("_id", "_h", "n_shingles", *digest).join(labelled, digest, "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_label", "_id"))
    return out.select("_id", "_h", "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def _with_sets(texts: DataFrame, packed) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = packed(batch.column("_t").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_rep"), pa.array([r[0] for r in made], pa.binary())], names=["_rep", "set"])

    return texts.mapInArrow(run, "_rep long, set binary")


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Append ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked if their sets of distinct word shingles, A-Z
    lower-cased, have a Jaccard similarity of at least ``percent``; a component
    goes by its smallest id, and that document is kept.  Null text and text
    without words have an empty set and are linked with nothing.  Ids are
    whole numbers; rows that repeat an id and its text get equal results, and
    a row without id is a component of its own, without id, and kept.
    """
    classes = document_classes(df, shingle, percent, doc_id, text).dropDuplicates(["_id", "_h"])
    rest = without(df, ["n_shingles", "component_id", "kept", "_h", "_id"])
    keyed = rest.withColumn("_h", F.xxhash64(F.col(text)))
    joined = keyed.join(classes.hint("shuffle_hash"), keyed[doc_id].eqNullSafe(classes["_id"]) & (keyed["_h"] == classes["_h"]), "left")
    return joined.select(*(keyed[c] for c in rest.columns), "n_shingles", "component_id", "kept")
