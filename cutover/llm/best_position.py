"""Ranked lexical search by the Best Position Algorithm over document shards.

Documents are cut into shards.  A shard holds, for each word of the queries,
its documents in order of falling impact, and for each document its words with
their positions in those lists.  A query reads its lists in parallel, a block
of positions at a time.  Every document met is looked up in all other lists at
once, which marks its positions there as seen too.  The best position of a
list is the end of the seen positions that have no gap from the top; no unseen
document can have more than the impacts found there.  Reading stops when the
score this leaves is strictly below the k-th score, so that ties are decided by
document and not by luck.  Shards return their best k, and the best k of those
are the answer.

Scores use whole numbers only, apart from the weight of a word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutover.session import stage

BEST = 20
#: Entries of the query words' lists that one shard holds, about.
SHARD_ENTRIES = 500_000
#: Words of queries that one task answers from a shard, about.
BLOCK_WORDS = 200_000
#: Positions read from each list before the threshold is looked at again.
STEP = 64
#: Bits of the filter that keeps words of no query from leaving the tokenizing tasks.
FILTER_BITS = 1 << 20

#: The parts of the score.
SLOPE, UNIT, TERM_UNIT, NORM_UNIT = 25, 1_000_000_000, 1000, 12

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms_of(text: str | None) -> list[str]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased."""
    return _TERM.findall((text or "").translate(_FOLD))


def weight(n_documents: Column, df: Column) -> Column:
    """floor(1000 * ln((2N + 2) / (2df + 1)))."""
    return F.floor(1000 * F.ln((2 * n_documents + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def _slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % FILTER_BITS


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times): each query's words with their repeats.  Queries with the same id count as one text after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, terms, times = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for term, q in Counter(terms_of(t)).items():
                    items.append(k)
                    terms.append(term)
                    times.append(q)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(items, pa.int64())), pa.array(terms, pa.string()), pa.array(times, pa.int64())], names=["item", "term", "times"])

    kind = queries.schema[item_id].dataType.simpleString()
    counted = queries.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"item {kind}, term string, times long")
    return counted.groupBy("item", "term").agg(F.sum("times").alias("times"))


def _filter_of(terms: DataFrame) -> bytes:
    """One bit per hash of a query word; its size is fixed, whatever the number of words."""
    # positions of these bitmaps count from 1
    slot = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS)).cast("long") + 1
    bits = terms.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    chunks = bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in chunks:
        out[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = r.bits
    return bytes(out)


def with_term_counts(df: DataFrame, bits: bytes, text: str) -> DataFrame:
    """(doc, n, terms, tfs) of each row: all its words counted, and the ones that may be a query's listed."""
    kind = df.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for t in batch.column(1).to_pylist():
                words = terms_of(t)
                listed, counts = [], []
                for term, tf in Counter(words).items():
                    hit = known.get(term)
                    if hit is None:
                        slot = _slot(term)
                        hit = bool(bits[slot >> 3] >> (slot & 7) & 1)
                        if len(known) < 200_000:
                            known[term] = hit
                    if hit:
                        listed.append(term)
                        counts.append(tf)
                sizes.append(len(words))
                terms.append(listed)
                tfs.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc", "n", "terms", "tfs"])

    return df.select("doc", F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc {kind}, n long, terms array<string>, tfs array<long>")


class Shard:
    """Impact lists of some documents, with direct access by document."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int):
        """One entry per (term, document), terms and documents numbered from 0; ``docs`` rises with each tie-break."""
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        places = np.arange(len(order)) - self.starts[terms[order]]
        by_doc = np.argsort(self.docs, kind="stable")
        self.doc_terms, self.doc_places, self.doc_impacts = terms[order][by_doc], places[by_doc], self.impacts[by_doc]
        self.doc_starts = np.searchsorted(self.docs[by_doc], np.arange(n_docs + 1))
        self.n_terms, self.n_docs = n_terms, n_docs

    def _direct(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries the documents have, and to which of the documents each belongs."""
        sizes = self.doc_starts[docs + 1] - self.doc_starts[docs]
        owner = np.repeat(np.arange(len(docs)), sizes)
        first = np.cumsum(sizes) - sizes
        return np.arange(len(owner)) - first[owner] + self.doc_starts[docs][owner], owner

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int = BEST, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """Up to ``k`` documents with their scores, best first, equal scores by document; and how many entries were read in order."""
        slot = np.full(self.n_terms, -1)
        slot[terms] = np.arange(len(terms))
        sizes = self.starts[terms + 1] - self.starts[terms]
        seen_at = [np.zeros(s + 1, bool) for s in sizes]  # the last stays unseen and ends each run
        best_place = np.zeros(len(terms), np.int64)
        known = np.zeros(self.n_docs, bool)
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, read = 0, 0
        while depth < sizes.max(initial=0):
            met = []
            for s, (term, size) in enumerate(zip(terms, sizes)):
                start, stop = min(depth, size), min(depth + step, size)
                seen_at[s][start:stop] = True
                met.append(self.docs[self.starts[term] + start : self.starts[term] + stop])
                read += stop - start
            depth += step
            new = np.unique(np.concatenate(met))
            new = new[~known[new]]
            known[new] = True
            entries, owner = self._direct(new)
            slots = slot[self.doc_terms[entries]]
            mine = slots >= 0
            entries, owner, slots = entries[mine], owner[mine], slots[mine]
            order = np.argsort(slots, kind="stable")
            for s, places in zip(*_runs(slots[order], self.doc_places[entries[order]])):
                seen_at[s][places] = True
            made = np.zeros(len(new), np.int64)
            np.add.at(made, owner, weights[slots] * self.doc_impacts[entries])
            found, scores = _top(np.concatenate([found, new]), np.concatenate([scores, made]), k)
            bound = 0
            for s, (term, size) in enumerate(zip(terms, sizes)):
                at = best_place[s] + int(np.argmin(seen_at[s][best_place[s] :]))
                best_place[s] = at
                # a list that was seen to its end holds no unseen document
                if at < size:
                    bound += int(weights[s]) * int(self.impacts[self.starts[term] + at - 1])
            if bound <= 0 or len(found) == k and bound < scores[-1]:
                break
        keep = scores > 0
        return found[keep], scores[keep], read


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted ``keys`` once each, and the values of each."""
    distinct, first = np.unique(keys, return_index=True)
    return distinct, np.split(values, first[1:]) if len(distinct) else []


def _top(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(docs) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        docs, scores = docs[near], scores[near]
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def impact(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), where m = 100 - 25 + ((25 n N) div L)."""
    m = 100 - SLOPE + (SLOPE * n * n_documents) // n_terms
    return (UNIT * tf) // (TERM_UNIT * tf + NORM_UNIT * m)


def _answer(docs: pa.Table, queries: pa.Table, n_documents: int, n_terms: int, k: int) -> pa.Table:
    """The best documents of one shard for each query of one block."""
    docs = docs.take(pc.sort_indices(docs["doc"], null_placement="at_start")).combine_chunks()
    queries = queries.combine_chunks()
    asked, items = queries["term"].combine_chunks().dictionary_encode(), queries["item"].combine_chunks().dictionary_encode(null_encoding="encode")
    lists = docs["terms"].combine_chunks()
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=asked.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    tf = docs["tfs"].combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(docs)), pc.list_value_length(lists).to_numpy())
    real = term >= 0  # the filter lets some other words through
    term, tf, owner = term[real], tf[real], owner[real]
    shard = Shard(term, owner, impact(tf, docs["n"].to_numpy()[owner], n_documents, n_terms), len(asked.dictionary), len(docs))
    words, of = asked.indices.to_numpy().astype(np.int64), items.indices.to_numpy().astype(np.int64)
    worth = queries["w"].to_numpy() * queries["times"].to_numpy()
    order = np.argsort(of, kind="stable")
    names, at, scores = [], [], []
    for item, rows in zip(*_runs(of[order], order)):
        best, score, _ = shard.best(words[rows], worth[rows], k)
        names.append(np.full(len(best), item))
        at.append(best)
        scores.append(score)
    joined = lambda parts: pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64))
    return pa.table({"item": items.dictionary.take(joined(names)), "doc": docs["doc"].combine_chunks().take(joined(at)), "score": joined(scores)})


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def ranked(documents: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of each query.

    Equal scores rank by rising ``doc_id``, null first.  Rows of ``documents``
    with the same id are documents of their own, queries with the same id one
    query.  Null and empty texts hold no words: such documents are never found
    and such queries find nothing.  Other columns play no part.
    """
    wanted = stage(query_terms(queries, item_id, item_text), "search-queries")
    words = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("_text"))
    counted = stage(with_term_counts(docs, _filter_of(words), "_text").filter(F.col("n") > 0), "search-terms")
    totals = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries")).first()
    asked = wanted.agg(F.count(F.lit(1))).first()[0]
    shards, blocks = max(1, -(-totals.entries // SHARD_ENTRIES)), max(1, -(-asked // BLOCK_WORDS))

    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = wanted.join(held, "term").withColumn("w", weight(F.lit(totals.documents).cast("long"), F.col("df"))).filter("w > 0")
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    asked_of = weighed.select("item", "term", "times", "w", block.alias("block"), F.explode(_numbers(shards)).alias("shard"))
    # every row goes to each block of queries; one block unless there are very many queries
    dealt = counted.select("*", F.pmod(F.xxhash64("doc", "terms"), F.lit(shards)).alias("shard"), F.explode(_numbers(blocks)).alias("block"))
    n_documents, n_terms = totals.documents, totals.terms
    types = {"item": queries.schema[item_id].dataType.simpleString(), "doc": documents.schema[doc_id].dataType.simpleString()}

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return _answer(left, right, n_documents, n_terms, k)

    found = dealt.groupBy("shard", "block").cogroup(asked_of.groupBy("shard", "block")).applyInArrow(
        answer, f"item {types['item']}, doc {types['doc']}, score long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
