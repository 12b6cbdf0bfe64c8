"""Line dedup: repeated runs of lines, found over line-ID sequences by prefix doubling.

Each document is a sequence of line IDs; lines without a word are left out of
it.  Prefix doubling names the first 1, 2, 4, ... lines of every suffix: the
name at twice the depth is made of the names of both halves.  Names are
fingerprints instead of sorted ranks, so doubling needs no shuffle; suffixes
that share their first w lines, an LCP interval of depth w, share the names of
the two power-of-two prefixes that cover w lines.

A line goes if it lies in a run of lines with at least ``min_words`` words that
also occurs at an earlier place (smaller id, or further up in the same
document).  Any such run holds, around the line, a shortest run with enough
words that begins or ends there, so it is enough to look up the shortest run
from each line on, and the shortest one back from each line.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutover.functions.once import once
from cutover.llm.common import without
from cutover.session import stage

#: A run of fewer words may repeat by chance.
MIN_WORDS = 5
_WORD = r"[^\x20\x09-\x0D]+"
_INNER = ("_h", "_l", "_f", "_s", "_e", "_w", "_i", "_n", "_a", "_b", "_c", "_first", "_spans", "_lines", "_gone", "_doc")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _with_words(lines: Column) -> Column:
    """Lines with a word: position in the text, ID, words and characters."""

    def entry(x: Column, i: Column) -> Column:
        bare = F.btrim(x, F.lit(" \t\x0b\x0c\r"))
        return F.struct(i.alias("i"), F.xxhash64(bare).alias("f"), F.regexp_count(bare, F.lit(_WORD)).alias("n"), F.length(bare).alias("c"))

    return F.filter(F.transform(lines, entry), lambda s: s["n"] > 0)


def _shortest(lines: Column, min_words: int) -> Column:
    """How many of the leading entries have ``min_words`` words together; 0 if they haven't."""
    return F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")),
        lambda acc, x: F.when(acc["n"] < min_words, F.struct((acc["n"] + x["n"]).alias("n"), (acc["w"] + 1).alias("w"))).otherwise(acc),
        lambda acc: F.when(acc["n"] >= min_words, acc["w"]).otherwise(0),
    )


def _doubled(names: Column, depth: int) -> Column:
    """Names of the first 2 * depth lines of each suffix that has so many."""
    have = F.greatest(F.size(names) - depth, F.lit(0))
    return F.zip_with(F.slice(names, 1, have), F.slice(names, depth + 1, have), lambda a, b: F.xxhash64(F.lit(depth), a, b))


def repeated_windows(df: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The shortest runs of enough words that repeat an earlier one: (_doc, _h, _i first line, _n lines).

    ``_h`` is a hash of the text; line numbers count lines with a word from 0.
    """
    docs = df.select(F.col(doc_id).alias("_doc"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("_t"))
    docs = once(docs, {"_l": _with_words(_lines(F.col("_t")))}).drop("_t").filter(F.size("_l") > 0)
    line = F.col("_l")
    docs = once(docs, {
        "_s": F.transform(line, lambda s, i: _shortest(F.slice(line, i + 1, min_words), min_words)),
        "_e": F.transform(line, lambda s, i: _shortest(F.reverse(F.slice(line, F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words)))), min_words)),
        "_f": F.transform(line, lambda s: s["f"]),
    })
    levels, depth = [F.col("_f")], 1
    while 2 * depth <= min_words:
        docs = once(docs, {f"_f{2 * depth}": _doubled(levels[-1], depth)})
        levels.append(F.col(f"_f{2 * depth}"))
        depth *= 2
    onward = F.filter(F.transform("_s", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda r: r["w"] > 0)
    back = F.filter(F.transform("_e", lambda w, i: F.struct((i + 1 - w).alias("i"), w.alias("w"))), lambda r: (r["w"] > 0) & (F.get("_s", r["i"]) != r["w"]))

    def name(names: Column, w: Column, at: Column) -> Column:
        return F.get(names, at)

    def key(r: Column, last: bool) -> Column:
        found = None
        for k, names in enumerate(levels):
            at = r["i"] + r["w"] - (1 << k) if last else r["i"]
            here = name(names, r["w"], at)
            found = F.when(r["w"] >= (1 << k), here) if found is None else F.when(r["w"] >= (1 << k), here).otherwise(found)
        return found

    runs = F.transform(F.concat(onward, back), lambda r: F.struct(r["i"].alias("_i"), r["w"].alias("_n"), key(r, False).alias("_a"), key(r, True).alias("_b"), F.get(line, r["i"])["c"].alias("_c")))
    # a few numbers per line, written because both sides of the join below are made of them
    rows = stage(docs.select("_doc", "_h", F.inline(runs)), "line-windows")
    keys = ["_n", "_a", "_b", "_c"]
    place = F.struct("_doc", "_h", "_i")
    # equal rows are one place: count places, not rows
    classes = rows.groupBy(*keys).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first != _last").drop("_last")
    # written, so that the join below shuffles both sides plainly and a very common line's partition can be split
    classes = stage(classes, "line-classes")
    return rows.join(classes, keys).filter(place > F.col("_first")).select("_doc", "_h", "_i", "_n")


def without_repeated_runs(df: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace ``text`` by what is left of it and append ``n_lines`` and ``deleted_lines`` (numbers from 0).

    Lines are separated by line feeds and compared without white space around
    them; the other lines stay as they are.  Null text stays null and has no
    lines.  Rows with the same id and text are one document, so neither is a
    copy of the other; rows with the same id and other text are documents of
    their own, ordered by a hash.  A document without id comes before all others.
    """
    found = repeated_windows(df, min_words, doc_id, text)
    spans = found.groupBy("_doc", "_h").agg(F.collect_set(F.struct(F.col("_i").alias("i"), F.col("_n").alias("n"))).alias("_spans"))
    rest = without(df, ["n_lines", "deleted_lines", *_INNER])
    keyed = rest.withColumn("_h", F.xxhash64(F.col(text)))
    joined = keyed.join(spans.hint("shuffle_hash"), keyed[doc_id].eqNullSafe(spans["_doc"]) & (keyed["_h"] == spans["_h"]), "left").select(*(keyed[c] for c in rest.columns), "_spans")
    joined = once(joined, {"_lines": _lines(F.col(text))})
    covered = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1))))
    # numbers among the lines with a word become numbers among all lines
    at = F.transform(F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), (F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0).alias("any"))), lambda s: s["any"]), lambda s: s["i"])
    none = F.array().cast("array<int>")
    joined = once(joined, {"_at": F.when(F.col("_spans").isNull(), none).otherwise(at)})
    joined = once(joined, {"_gone": F.when(F.col("_spans").isNull(), none).otherwise(F.array_sort(F.transform(covered, lambda k: F.get("_at", k))))})
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get("_lines", i)), "\n")
    shown = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(left)
    return joined.select(
        *((shown if c == text else F.col(c)).alias(c) for c in rest.columns),
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"),
        F.col("_gone").alias("deleted_lines"),
    )
