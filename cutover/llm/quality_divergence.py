"""Quality rules: base counts, and the distance of a document's histograms from its language's.

The references are histograms per language over all documents that pass the
base rules: the median document's share of each character class, and the words
that make up at least one part in ``COMMON_PARTS`` of the language's words.  A
document is compared by Jensen-Shannon distance (base 2, so 0 to 1) with the
closest reference.  Medians keep what junk there is out of the reference.

References of frequent languages travel to the tasks, and every document is
compared with them.  Those of rare languages stay a table; documents of such a
language are compared with its own one, too, from which the document itself is
taken out first, so that a few documents don't vouch for themselves.  Words are
only compared with references of ``LEAST_WORDS`` words.  Below that a language
has its character classes, and those of the frequent languages with letters of
all scripts as one class: other languages' words never reject its documents.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.llm.common import WHITE, shingle_hashes, with_columns_by_batch, without, word_hashes
from cutover.session import stage

#: A word is common if it is at least one in so many words of its language: at most so many are.
COMMON_PARTS = 1000
#: A language is frequent if it has at least one in so many words of the corpus: at most so many are.
LANGUAGE_PARTS = 200
#: Words of a rare language's reference are compared from so many on, so that a common word stands for 20 occurrences.
LEAST_WORDS = 20 * COMMON_PARTS
#: Histograms of short documents say little, so the limit on the distance depends on the
#: length: (least number of code points, highest distance), and below the last one none is judged.
CHAR_LIMITS = ((240, 0.16), (60, 0.27))
#: The same by number of words, for the distance of the word histograms.
WORD_LIMITS = ((100, 0.42),)
#: Entries of a task's word counter before it is passed on.
COUNTER_ENTRIES = 300_000

CLASSES = ("small", "upper", "white", "stop", "mark", "symbol", "wide")
#: Shares of a class are tallied in steps of one in so many.
SHARE_STEPS = 1000
SYMBOLS = b"#*$%&|<>"

COUNTS_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
VERDICT_DDL = COUNTS_DDL + ", nearest_lang string, char_distance double, word_distance double, kept boolean"


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes of UTF-8 have none."""
    table = np.full(256, CLASSES.index("symbol"))
    table[0x80:] = CLASSES.index("wide")
    table[0x80:0xC0] = len(CLASSES)
    for name, chars in (("small", range(97, 123)), ("small", range(48, 58)), ("upper", range(65, 91)), ("white", WHITE), ("stop", b".,"), ("mark", b"!?;:'\"()-/@+=_")):
        table[list(chars)] = CLASSES.index(name)
    return table


_CLASS = _class_table()
#: For the word histogram: A-Z as a-z, everything else in ASCII but letters and digits as a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def base_counts(text: str) -> tuple[tuple, np.ndarray, bytes]:
    """The base rule's counts of one text, its code points by class, and its bytes."""
    data = text.encode("utf-8", "surrogatepass")
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, by_byte, len(CLASSES) + 1)[:-1].astype(np.int64)
    words = word_hashes(text, fold=False)
    windows = shingle_hashes(words, 5)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(times[which] > 1) if len(windows) else np.empty(0, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + 5, -1)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    n, repeated = len(words), int((np.cumsum(steps) > 0).sum())
    counts = (n, int(by_class.sum() - by_class[CLASSES.index("white")]), int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n)
    return counts, by_class, data


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: documents by class and share (kind c), words (kind w), and number of words (kind n)."""
    words: dict[str, Counter] = defaultdict(Counter)
    shares: dict[str, Counter] = defaultdict(Counter)
    sums: Counter = Counter()

    def rows():
        found = [(lang, "w", w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
        found += [(lang, "c", f"{at // (SHARE_STEPS + 1)}:{at % (SHARE_STEPS + 1)}", n) for lang, c in shares.items() for at, n in c.items()]
        found += [(lang, "n", "", n) for lang, n in sums.items()]
        for kept in (words, shares, sums):
            kept.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(),) * 3 + (pa.int64(),))], names=["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts, by_class, data = base_counts(text or "")
            if lang is None or counts[-1]:
                continue
            plain = data.translate(_PLAIN).split()
            words[lang].update(plain)
            sums[lang] += len(plain)
            shares[lang].update((_FIRST_STEP + _steps(by_class)).tolist())
        if sum(map(len, words.values())) + sum(map(len, shares.values())) > COUNTER_ENTRIES:
            yield rows()
    yield rows()


#: Place of each class's first share among all steps of all classes.
_FIRST_STEP = np.arange(len(CLASSES)) * (SHARE_STEPS + 1)


def _steps(by_class: np.ndarray) -> np.ndarray:
    """The share of each class, in steps."""
    return np.rint(by_class * (SHARE_STEPS / by_class.sum())).astype(np.int64)


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]
#: Documents by class and step, common words, and the number of all words.
Counts = tuple[np.ndarray, dict[bytes, int], int]


def _counts(rows: Iterable[tuple[str, str, int]]) -> Counts:
    """What (kind, key, n) say of one language."""
    classes, words, total = np.zeros((len(CLASSES), SHARE_STEPS + 1), np.int64), {}, 0
    for kind, key, n in rows:
        if kind == "c":
            k, _, step = key.partition(":")
            classes[int(k), int(step)] = n
        elif kind == "w":
            words[key.encode()] = n
        elif kind == "n":
            total = n
    return classes, words, total


def _reference(counts: Counts) -> Reference:
    """Shares of character classes, index of common words, their shares and that of all others."""
    classes, words, total = counts
    keys = sorted(words)
    shares = np.array([words[k] for k in keys] + [total - sum(words.values())], float)
    return _medians(classes), {k: i for i, k in enumerate(keys)}, shares / shares.sum()


def _medians(classes: np.ndarray) -> np.ndarray:
    so_far = np.cumsum(classes, axis=1)
    medians = (2 * so_far < so_far[:, -1:]).sum(axis=1)  # the first step with half of the documents at or below it
    return medians / max(1, medians.sum())


def _less(counts: Counts, by_class: np.ndarray, plain: list[bytes]) -> tuple[np.ndarray | None, Counts | None]:
    """Class shares of a language without one of its documents, None if no other is left, and its counts if they still have enough words."""
    classes, words, total = counts
    classes = classes.copy()
    classes[np.arange(len(CLASSES)), _steps(by_class)] -= 1
    medians = _medians(classes) if classes[0].any() else None
    total -= len(plain)
    if total < LEAST_WORDS:
        return medians, None
    own = Counter(plain)
    left = {w: n - own[w] for w, n in words.items()}
    return medians, (classes, {w: n for w, n in left.items() if n * COMMON_PARTS >= total}, total)


def language_references(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str, Reference], DataFrame | None]:
    """The references of frequent languages by name, and a table (lang, _counts) of the others; None if there are none.

    Counts cover all rows whose language isn't null and whose text passes the
    base rules.  What comes back is bounded by ``COMMON_PARTS`` words in each
    of ``LANGUAGE_PARTS`` languages; if no language is frequent, that many of
    the most frequent ones count as such.  An empty table gives none.
    """
    tallies = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(_tallies, "lang string, kind string, key string, n long")
    tallies = stage(tallies.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "quality-tallies")
    totals = tallies.filter("kind = 'n' AND n > 0").select("lang", F.col("n").alias("total"))
    top = totals.orderBy(F.desc("total"), "lang").limit(LANGUAGE_PARTS).collect()
    if not top:
        return {}, None
    everything = totals.agg(F.sum("total")).first()[0]
    names = [r.lang for r in top if r.total * LANGUAGE_PARTS >= everything] or [r.lang for r in top]
    is_common = (F.col("kind") != "w") | (F.col("n") * COMMON_PARTS >= F.col("total"))
    found: dict[str, list] = defaultdict(list)
    # at most LANGUAGE_PARTS rows are broadcast
    for row in tallies.join(F.broadcast(totals.filter(F.col("lang").isin(names))), "lang").filter(is_common).select("lang", "kind", "key", "n").collect():
        found[row.lang].append((row.kind, row.key, row.n))
    frequent = {name: _reference(_counts(rows)) for name, rows in sorted(found.items())}
    rare = totals.filter(~F.col("lang").isin(names))
    if rare.isEmpty():
        return frequent, None

    def made(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True)
        classes, words, total = _counts(rows)
        at = np.flatnonzero(classes)
        return pa.table({"lang": table.column("lang")[:1], "_counts": pa.array([pickle.dumps((at, classes.ravel()[at], words, total))], pa.binary())})

    # a group has COMMON_PARTS words and the steps of the classes at most
    kept = tallies.join(rare, "lang").filter(is_common).select("lang", "kind", "key", "n")
    return frequent, stage(kept.groupBy("lang").applyInArrow(made, "lang string, _counts binary"), "quality-references")


def _read_counts(data: bytes) -> Counts:
    at, n, words, total = pickle.loads(data)
    classes = np.zeros((len(CLASSES), SHARE_STEPS + 1), np.int64)
    classes.ravel()[at] = n
    return classes, words, total


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return math.sqrt(max(0.0, float(parts.sum()) / 2))


def limit_for(length: int, limits: tuple) -> float | None:
    return next((most for least, most in limits if length >= least), None)


def _one_script(shares: np.ndarray) -> np.ndarray:
    """Class shares with letters outside of ASCII among the small ones."""
    out = shares.copy()
    out[CLASSES.index("small")] += out[CLASSES.index("wide")]
    out[CLASSES.index("wide")] = 0
    return out


def _judge(text: str, references: dict, rare: str | None = None, own: Counts | None = None) -> tuple:
    """Counts and verdict of a text; ``rare`` is its language if that isn't a frequent one, and ``own`` what is known of it."""
    counts, by_class, data = base_counts(text)
    nearest, chars, words = None, None, None
    if not references:
        return (*counts, nearest, chars, words, not counts[-1])
    total = int(by_class.sum())
    plain = data.translate(_PLAIN).split()
    most_chars, most_words = limit_for(total, CHAR_LIMITS), limit_for(len(plain), WORD_LIMITS)
    own_classes = None
    if own is not None and not counts[-1]:
        own_classes, left = _less(own, by_class, plain)
        if left:
            references, rare = {**references, rare: _reference(left)}, None
    best = math.inf
    for name, (classes, index, shares) in references.items():
        c = distance(by_class / total, classes) if most_chars else None
        w = None
        if most_words:
            other = len(index)
            w = distance(np.bincount([index.get(x, other) for x in plain], minlength=other + 1) / len(plain), shares)
        far = max(c / most_chars if most_chars else 0.0, w / most_words if most_words else 0.0)
        if far < best:
            best, nearest, chars, words = far, name, c, w
    if best > 1 and rare is not None and most_chars:
        # too few words to compare with: the classes alone, of its own language or of any
        alike = [(rare, distance(by_class / total, own_classes))] if own_classes is not None else []
        alike += [(name, distance(_one_script(by_class / total), _one_script(classes))) for name, (classes, _, _) in references.items()]
        for name, c in alike:
            if c <= most_chars:
                best, nearest, chars, words = c / most_chars, name, c, None
                break
    return (*counts, nearest, chars, words, not counts[-1] and best <= 1)


def judged(df: DataFrame, text: str = "text", lang: str = "lang", references: dict | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Append the base counts, the closest language, both distances and the verdict ``kept``.

    Null or empty text has no words, so it fails the base rules.  A document
    is kept if it passes the base rules and neither distance from the closest
    reference is above its limit.  Distances of documents shorter than the
    guards are null and don't count.  A document is compared with the
    references of all frequent languages and that of its own, less the document
    itself where the language is rare; one without language with those of all
    frequent ones.  If a rare language has fewer than ``LEAST_WORDS`` other
    words, its documents are also kept if their character classes alone are
    close to its own, or to a frequent language's with letters of all scripts
    as one class; ``word_distance`` is null then.  References come from ``df`` itself unless given.  Repeated rows are judged alike.
    """
    known, rare = language_references(df, text, lang) if references is None else (references, None)
    if rare is None:
        return with_columns_by_batch(df, VERDICT_DDL, lambda texts: [_judge(t or "", known) for t in texts], (text,), drop)

    def rows(texts: list, langs: list, own: list) -> list[tuple]:
        read: dict[str, Counts] = {}
        out = []
        for t, g, data in zip(texts, langs, own, strict=True):
            if data is not None and g not in read:
                read[g] = _read_counts(data)
            out.append(_judge(t or "", known, None if g in known else g, read.get(g)))
        return out

    df = without(df, ["_own", "_counts"])
    name = F.col(lang).cast("string")
    frequent = F.coalesce(name.isin(list(known)), F.lit(True))
    plain = df.filter(frequent).withColumn("_own", name).withColumn("_counts", F.lit(None).cast("binary"))
    others = df.filter(~frequent).withColumn("_own", name)
    others = others.join(rare.withColumnRenamed("lang", "_of"), F.col("_own") == F.col("_of"), "left").select(*plain.columns)
    return with_columns_by_batch(plain.unionByName(others), VERDICT_DDL, rows, (text, "_own", "_counts"), (*drop, "_own", "_counts"))
