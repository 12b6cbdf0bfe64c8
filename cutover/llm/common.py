"""What the operators of this package share: batches through Python, and hashes of words.

Rules that hold for every operator here: input columns are kept, an input
column whose name clashes with a column the operator adds is replaced by it
(names compare without case), and null text counts as empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of a text whose words are hashed at once; longer texts take several turns.
BLOCK_BYTES = 1 << 22

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"

_ARROW = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the few Spark types the operators return."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return _ARROW[kind]


def fields_of(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns that clash with ``names``."""
    clash = {n.lower() for n in names}
    return df.select(*(df[c] for c in df.columns if c.lower() not in clash))


def with_columns_by_batch(df: DataFrame, ddl: str, fn: Callable[..., list[tuple]], uses: tuple[str, ...], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns that a Python function makes from batches of rows.

    ``fn`` takes one list per column of ``uses`` and returns one tuple per row,
    in the order of ``ddl``.  ``drop`` names input columns that are not passed on.
    """
    new = fields_of(ddl)
    gone = {f.name.lower() for f in new} | {c.lower() for c in drop}
    kept = [c for c in df.columns if c.lower() not in gone]
    schema = T.StructType([df.schema[c] for c in kept] + new)
    types = [arrow_type(f.dataType) for f in new]
    names = kept + [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = fn(*(batch.column(c).to_pylist() for c in uses))
            made = zip(*rows, strict=True) if rows else ([] for _ in types)
            arrays = [pa.array(list(v), t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, names=names)

    return df.mapInArrow(run, schema)


class Recent:
    """What a worker keeps of answers it has worked out: at least the ones used lately, at most ``entries``.

    When the newer half is full it becomes the older one, and what is asked
    for again moves over; so frequent keys stay, whatever comes between.
    """

    def __init__(self, entries: int):
        self.half = max(1, entries // 2)
        self.newer: dict = {}
        self.older: dict = {}

    def unknown(self, keys: set) -> set:
        """The keys without an answer; the others can be looked up in ``newer`` until the next call."""
        if len(self.newer) + len(keys) > self.half:
            self.older, self.newer = self.newer, {}
        return self.also_unknown(keys)

    def also_unknown(self, keys: set) -> set:
        """The same for further keys, without giving up any that were asked for."""
        missing = keys.difference(self.newer)
        older = self.older
        again = {k for k in missing if k in older}  # never a walk over all that is kept
        self.newer.update((k, older[k]) for k in again)
        return missing.difference(again)


class Numbers:
    """Numbers below 2^20 by integer keys below 2^43, looked up and added by whole arrays.

    Open addressing in one array of 8 bytes a slot, at most half full.
    """

    def __init__(self, bits: int = 16):
        self.n = 0
        self.slots = np.full(1 << bits, -1, np.int64)

    def __len__(self) -> int:
        return self.n

    def _places(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys without one."""
        at = self._places(keys)
        found = self.slots[at]
        same = found >> 20 == keys
        numbers = np.where(same, found & 0xFFFFF, -1)
        left = np.flatnonzero(~same & (found >= 0))
        while len(left):
            at[left] = here = at[left] + 1 & len(self.slots) - 1
            found = self.slots[here]
            same = found >> 20 == keys[left]
            numbers[left[same]] = found[same] & 0xFFFFF
            left = left[~same & (found >= 0)]
        return numbers

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add keys, each once, that have no number yet."""
        entries = keys << 20 | numbers
        if 2 * (self.n + len(keys)) > len(self.slots):
            entries = np.concatenate([self.slots[self.slots >= 0], entries])
            self.slots = np.full(1 << (2 * len(entries)).bit_length(), -1, np.int64)
            self.n = 0
        self.n += len(entries)
        at = self._places(entries >> 20)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]  # of several for one slot the last stays
            left = self.slots[at] != entries
            entries, at = entries[left], at[left] + 1 & len(self.slots) - 1


def distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut at every blank: a number for each word in order, where each text's words begin (and the last end), and the words numbered."""
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    found = cut.flatten().dictionary_encode()
    return found.indices.to_numpy(), cut.offsets.to_numpy(), found.dictionary


def listed(words: pa.Array) -> list[str]:
    """The same as ``to_pylist`` for strings, which takes far longer."""
    return words.to_numpy(zero_copy_only=False).tolist()


def words_by_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``distinct_words`` with a list of the words."""
    codes, bounds, words = distinct_words(texts)
    return codes, bounds, listed(words)


def _table(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = {False: _table(False), True: _table(True)}
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            step = _POWERS[-1] * _BASE
            _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_block(a: np.ndarray, values: np.ndarray) -> np.ndarray:
    inside = _IS_WORD[a]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    if not len(edges):
        return np.empty(0, np.uint64)
    lengths = edges[1::2] - edges[0::2]
    first = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(values[a[inside]] * _powers(int(lengths.max()))[offset], first)
        return mix(sums + lengths.astype(np.uint64))


def word_hashes(text: str, fold: bool) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, in order.

    ``fold`` lets A-Z hash like a-z.  Equal words hash alike everywhere.
    """
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(a) <= BLOCK_BYTES:
        return _hash_block(a, _VALUES[fold])
    parts, at = [], 0
    while at < len(a):
        end = min(at + BLOCK_BYTES, len(a))
        while end < len(a) and _IS_WORD[a[end]]:
            end += 1
        parts.append(_hash_block(a[at:end], _VALUES[fold]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words, in order; none if there are fewer words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            h = mix(h + words[k : len(words) - size + 1 + k]) + _BASE
    return h
