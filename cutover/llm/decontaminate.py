"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the runs of ``WINDOW`` consecutive words of an item, or all
words of a shorter one.  For each length of test string, a shift table says how
far the search may move for the block of words it looks at; where it may not
move, a bucket by that last block, filtered by the first words, has the strings
to compare in full.

The benchmark is searched for in blocks of at most about ``BLOCK_WORDS`` words,
so that what tasks hold is bounded whatever its size; each block adds its
occurrences to those found before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.llm.common import with_columns_by_batch, without
from cutover.session import stage

WINDOW = 10
#: Words of test items that one pass over the documents looks for.
BLOCK_WORDS = 200_000
#: Words of a segment of a long item; segments overlap so that no window is lost.
SEGMENT_WORDS = 1_000

FOUND_DDL = "n_words long, hits array<struct<start:long,stop:long>>, items array<string>"
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, A-Z lower-cased, and of all other characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


class Searcher:
    """Occurrences of many test strings of one length."""

    def __init__(self, length: int, strings: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]]] = {}
        for words, items in strings.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            bucket = self.buckets.setdefault(words[-self.block :], defaultdict(list))
            bucket[words[: self.block]].append((list(words), items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Each position where a test string begins, and the items that have it."""
        length, block, far, shift, n = self.length, self.block, self.far, self.shift, len(words)
        at = length
        while at <= n:
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            move = shift.get(key, far)
            if move:
                at += move
                continue
            start = at - length
            for string, items in self.buckets[key].get(tuple(words[start : start + block]), ()):
                if words[start:at] == string:
                    yield start, items
            at += 1


def searchers(segments: list[tuple[str, str]]) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in segments:
        words = words_of(text)
        length = min(WINDOW, len(words))
        for k in range(len(words) - length + 1):
            by_length[length][tuple(words[k : k + length])].add(item)
    return [Searcher(n, strings) for n, strings in sorted(by_length.items()) if n]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            step = SEGMENT_WORDS - WINDOW + 1
            for k in range(0, max(len(words) - WINDOW, 0) + 1, step) if words else ():
                part = words[k : k + SEGMENT_WORDS]
                rows.append((item, b" ".join(part).decode("utf-8", "surrogatepass"), len(part)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["item", "words", "n"])


def find_occurrences(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``n_words``, ``hits`` (ranges of words inside occurrences, merged) and ``items`` (ids as text, sorted).

    Null text has no words and no hits, and a null or empty item occurs
    nowhere.  An item without id goes by the empty name.  Items with the same
    id count as one, an empty benchmark hits nothing, repeated rows get equal results.
    """
    segments = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).mapInArrow(_segments, "item string, words string, n long")
    total = segments.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    here = [c for c in df.columns if c.lower() not in {d.lower() for d in drop}]
    found = without(df, ["n_words", "hits", "items"])
    for k in range(blocks):
        # about BLOCK_WORDS words; the next block is only read when this one's pass is written
        part = [(r.item, r.words) for r in segments.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).select("item", "words").collect()]
        found = _pass(found, part, text, first=k == 0)
        if k + 1 < blocks:
            found = stage(found, "decontaminate")
    new = {"n_words", "hits", "items"}
    return found.select(*(c for c in here if c.lower() not in new), *sorted(new))


def _pass(df: DataFrame, part: list[tuple[str, str]], text: str, first: bool) -> DataFrame:
    built: list[list[Searcher]] = []  # filled once in each task

    def rows(texts: list, *before: list) -> list[tuple]:
        if not built:
            built.append(searchers(part))
        out = []
        for i, t in enumerate(texts):
            words = words_of(t)
            spans = [] if first else [(h["start"], h["stop"]) for h in before[0][i]]
            items = set() if first else set(before[1][i])
            for s in built[0]:
                for start, found in s.occurrences(words):
                    spans.append((start, start + s.length))
                    items |= found
            out.append((len(words), [{"start": a, "stop": b} for a, b in merged(spans)], sorted(items)))
        return out

    return with_columns_by_batch(df, FOUND_DDL, rows, (text,) if first else (text, "hits", "items"))


def hit_words(hits: str = "hits") -> F.Column:
    """Number of words inside the ranges."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["start"])
