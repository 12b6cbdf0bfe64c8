"""Packing in order: where to cut a stream of documents into windows, by dynamic programming.

The documents of a task, in order, make one stream of token ids, each document
closed by its end id.  A window of at most ``SIZE`` tokens may be cut at the
end of a document for free, at the end of a sentence for a small penalty, and
elsewhere, every ``STEP`` tokens of a long sentence, for a larger one.  A
window is padded to ``SIZE`` unless its length is one of ``UNPADDED``.  The
cheapest cuts are found with a monotone queue: for padding, the best start
within reach is the least of cost + position over a sliding range.

A stream is solved in blocks that end with a document, so memory is bounded by
``BLOCK_TOKENS`` or the longest document, and nothing is shuffled: windows
never reach from one task's documents into another's.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cutover.llm.common import arrow_type, distinct_words, fields_of, listed

SIZE = 2048
UNPADDED = (64, 128, 256, 512, 1024, 2048)
SENTENCE_PENALTY, MIDDLE_PENALTY, WINDOW_COST = 24, 160, 8
STEP = 256
END_ID = 1
BLOCK_TOKENS = 1 << 21
#: Characters of the texts that are encoded together.
TURN_CHARS = 8_000_000
#: Words whose ids a worker keeps.
CACHE_ENTRIES = 500_000
#: Letters that stay single letters in lower case, and that no mark behind them joins.
_STEM = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f]+")
#: Words made of letters alone that are encoded as one text; each ends with a token that ends a word.
JOINED_WORDS = 256

_MARKS = frozenset(",.!")

PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cheapest_cuts(ends: list[int], penalties: list[int], size: int = SIZE, unpadded: tuple[int, ...] = UNPADDED) -> list[int]:
    """The cheapest windows: their end positions, the last of ``ends`` included.

    ``ends`` are the allowed cuts, ascending, no two over ``size`` apart, each
    with its penalty.  Ties go to the window that begins first.
    """
    positions = [0, *ends]
    cost = [0] * len(positions)
    came = [0] * len(positions)
    at_k, starts = _unpadded_starts(positions, unpadded)
    at_k.append(len(positions))  # never reached
    i = 0
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost + position, position, index; the first ascends
    for k in range(1, len(positions)):
        at = positions[k]
        while queue[0][1] < at - size:
            queue.popleft()
        best, came_from = queue[0][0] + size - at, queue[0][2]
        while at_k[i] == k:
            j = starts[i]
            if cost[j] < best:
                best, came_from = cost[j], j
            i += 1
        best += penalties[k - 1] + WINDOW_COST
        cost[k], came[k] = best, came_from
        value = best + at
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, at, k))
    cuts, k = [], len(positions) - 1
    while k:
        cuts.append(positions[k])
        k = came[k]
    return cuts[::-1]


def _unpadded_starts(positions: list[int], unpadded: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """(k, j) of every two positions an unpadded length apart, by k, then in the order of the lengths."""
    places = np.array(positions, np.int64)
    ks, js = [], []
    for n in unpadded:
        j = np.minimum(np.searchsorted(places, places - n), len(places) - 1)
        k = np.flatnonzero(places[j] == places - n)
        ks.append(k)
        js.append(j[k])
    k, j = np.concatenate(ks or [places[:0]]), np.concatenate(js or [places[:0]])
    order = np.argsort(k, kind="stable")
    return k[order].tolist(), j[order].tolist()


class WordEncoder:
    """Ids of texts from those of their words; pre-tokens never cross white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # words with their ids after each other, and the turn that used each last: a small part of a dictionary's memory
        self.words = pa.array([], pa.large_string())
        self.ids, self.sizes, self.used = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        self.turn = 0

    def _encode(self, words: list[str], known: dict[str, bytes]) -> None:
        """Encode words: the ones of letters many at a time, the others each for itself."""
        alone = [w for w in words if not w.isalpha()]
        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), JOINED_WORDS):
            some = letters[at : at + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(stops) != len(some):  # lower-casing made more than letters of some word
                alone += some
                continue
            data, start = ids.tobytes(), 0
            for w, stop in zip(some, stops, strict=True):
                known[w] = data[start:stop]
                start = stop
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def _find(self, words: pa.Array) -> np.ndarray:
        """Places of words among the kept ones, -1 for others."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)

    def _places(self, kept: np.ndarray) -> np.ndarray:
        """Where the ids of kept words are, word by word."""
        sizes = self.sizes[kept]
        first = (np.cumsum(self.sizes) - self.sizes)[kept]
        return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))

    def _keep(self, kept: np.ndarray) -> None:
        """Forget all words but these."""
        self.ids = self.ids[self._places(kept)]
        self.words, self.sizes, self.used = self.words.take(pa.array(kept)), self.sizes[kept], self.used[kept]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't kept."""
        # a mark behind letters is a pre-token of its own
        stems = {w: w[:-1] for w in words if w[-1:] in _MARKS and _STEM.fullmatch(w, 0, len(w) - 1)}
        only = list(set(stems.values()).difference(words))
        at = self._find(pa.array(only, pa.large_string()))
        kept = np.flatnonzero(at >= 0)
        data, stops = self.ids[self._places(at[kept])].tobytes(), np.cumsum(4 * self.sizes[at[kept]]).tolist()
        known = {only[i]: data[start:stop] for i, start, stop in zip(kept.tolist(), [0, *stops], stops)}  # noqa: B905
        self._encode(list({*(w for w in words if w not in stems), *(w for w in only if w not in known), *_MARKS}), known)
        for w, stem in stems.items():
            known[w] = known[stem] + known[w[-1]]
        return [known[w] for w in words]

    def learn(self, words: pa.Array) -> np.ndarray:
        """Have the ids of distinct words at hand: their places among the kept ones.

        Beyond ``CACHE_ENTRIES`` the half used last stays, with all that are asked for.
        """
        self.turn += 1
        at = self._find(words)
        new = words.filter(pa.array(at < 0))
        known = at[at >= 0]
        self.used[known] = self.turn
        if len(self.words) + len(new) > CACHE_ENTRIES:
            stay = max(len(known), CACHE_ENTRIES // 2 - len(new))
            self._keep(np.sort(np.argsort(-self.used, kind="stable")[:stay]))
            at = self._find(words)
        ids = self._ids_of(listed(new))
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        self.used = np.concatenate([self.used, np.full(len(new), self.turn)])
        return at

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Ids of each text, as little-endian unsigned 32-bit, and the positions after its sentences.

        Each distinct word is looked up once; the ids of all its places are copied by position.
        """
        codes, bounds, words = distinct_words([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts])
        at = self.learn(words)
        sizes = self.sizes[at]
        starts = (np.cumsum(self.sizes) - self.sizes)[at]
        n = sizes[codes]
        ends = np.cumsum(n)
        out = self.ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        closing = pc.match_substring_regex(words, "[.!?]$").to_numpy(zero_copy_only=False).astype(bool)[codes]
        before = np.concatenate([[0], ends])[bounds]
        for i, (first, last) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905
            stops = ends[first:last][closing[first:last]] - before[i]
            yield out[before[i] : before[i + 1]].tobytes(), stops


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once; they come almost in order, which this sort makes use of."""
    values = np.sort(values, kind="stable")
    return values[np.diff(values, prepend=values[:1] - 1) > 0]


def candidates(lengths: list[int], sentences: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Allowed cuts of a block of documents and their penalties."""
    ends = np.cumsum(lengths)
    inner = [s + at for s, at in zip(sentences, ends - lengths, strict=True)]
    cuts = _distinct(np.concatenate([ends, *inner])) if len(ends) else np.empty(0, np.int64)
    cuts = cuts[cuts > 0]
    gaps = np.diff(cuts, prepend=0)
    more = [np.arange(c - g + STEP, c, STEP) for c, g in zip(cuts[gaps > STEP], gaps[gaps > STEP], strict=True)]
    every = _distinct(np.concatenate([cuts, *more]))
    penalty = np.full(len(every), MIDDLE_PENALTY)
    penalty[np.searchsorted(every, cuts)] = SENTENCE_PENALTY
    penalty[np.searchsorted(every, ends[ends > 0])] = 0
    return every.tolist(), penalty.tolist()


def pieces(doc_ids: list, ids: list[bytes], sentences: list[np.ndarray], first_sequence: int) -> tuple[list[tuple], int]:
    """Pieces of a block of documents, and how many sequences it takes."""
    lengths = [len(b) // 4 for b in ids]
    cuts = cheapest_cuts(*candidates(lengths, sentences))
    out, k, start = [], 0, 0  # k: the window; start: where it begins
    at = 0
    for doc_id, data, n in zip(doc_ids, ids, lengths, strict=True):
        view, done = memoryview(data), 0
        while done < n:
            take = min(n - done, cuts[k] - at - done)
            out.append((doc_id, done, take, zlib.crc32(view[4 * done : 4 * (done + take)]), n, first_sequence + k, at + done - start))
            done += take
            if at + done == cuts[k]:
                start, k = cuts[k], k + 1
        at += n
    return out, len(cuts)


def packed(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most ``SIZE`` tokens.

    Null or empty text is a document of its end id alone.  Repeated rows are
    packed each for itself; an empty table gives no pieces.  Other columns are
    not passed on.
    """
    end = np.array([END_ID], "<u4").tobytes()
    types = [arrow_type(f.dataType) for f in fields_of(PIECE_DDL)]
    names = [f.name for f in fields_of(PIECE_DDL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        sequence = TaskContext.get().partitionId() << 36
        block: tuple[list, list, list] = ([], [], [])
        tokens = 0

        def solved() -> pa.RecordBatch:
            nonlocal sequence, tokens
            rows, n = pieces(*block, sequence)
            sequence, tokens = sequence + n, 0
            for part in block:
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and chars < TURN_CHARS:
                    chars += len(texts[stop] or "")
                    stop += 1
                for key, (ids, sentences) in zip(keys[at:stop], encode([t or "" for t in texts[at:stop]]), strict=True):
                    for part, value in zip(block, (key, ids + end, sentences), strict=True):
                        part.append(value)
                    tokens += len(ids) // 4 + 1
                    if tokens >= BLOCK_TOKENS:
                        yield solved()
                at = stop
        if block[0]:
            yield solved()

    return df.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"CAST(`{text}` AS STRING) AS text").mapInArrow(run, PIECE_DDL)
