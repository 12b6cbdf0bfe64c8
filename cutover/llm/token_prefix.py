"""Exact token counts of every prefix by dynamic programming over a merge vocabulary.

A sequence of tokens is the encoding of its text exactly if every token encodes
to itself and every two neighbours encode to themselves.  So a prefix's last
token is the one vocabulary piece that ends there and fits the last token of
what stands before it, and count[i] = count[i - length] + 1: one pass gives the
count at every prefix, and questions about limits need no encoding.

No piece crosses from other text into white space, so the counts of the units
"white space + word" add up.  The pass goes through all distinct units of a turn
at once, one array step for the prefixes of each length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.llm.common import Numbers, Recent, with_columns_by_batch, words_by_text

#: Words with their counts, and chunks of other texts with theirs, that a worker keeps.
WORD_ENTRIES, CHUNK_ENTRIES = 400_000, 100_000
#: Pairs of tokens that a worker keeps before it starts anew, for arrays and for single texts.
PAIR_ENTRIES, SEAM_ENTRIES = 1_000_000, 100_000
#: Characters of the texts that are counted together, and of their distinct words that are solved together.
TURN_CHARS, BLOCK_CHARS = 6_000_000, 1 << 18
#: Longer words are cut into chunks, and as many units as are longer still than all others are solved one by one.
LONG_UNIT, FEW_UNITS = 64, 32

SPACE = "▁"
COUNT_DDL = "n_tokens long, cut_at long"


class PrefixCounter:
    """Token counts for a piece model with byte fallback and scores as merge priorities."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("a piece crosses white space: chunks can't be counted apart")
        self.longest = max(map(len, self.rank))
        self.pattern = re.compile(self._chunk_pattern())
        self.tails = {p[k:]: p[k:] in self.rank for p in self.rank for k in range(len(p))}
        self.names = [*self.rank, ""]
        self._read_backwards()
        self.halves = {p: self._halves(p) for p in self.rank}
        self._number_merges()
        self.words, self.parts = Recent(WORD_ENTRIES), Recent(CHUNK_ENTRIES)
        self.fit = Numbers()
        self.seams: dict[tuple[str, str], bool] = {}

    def _read_backwards(self) -> None:
        """Number the characters and tails of pieces: a tail and the character before it lead to the next longer tail."""
        letters = {c: i for i, c in enumerate(sorted(set(chain.from_iterable(self.rank))), 1)}
        self.char_of = np.zeros(0x110000, np.int32)
        self.char_of[[ord(c) for c in letters]] = list(letters.values())
        number = {t: i for i, t in enumerate(self.tails)}
        pieces = {p: i for i, p in enumerate(self.rank)}
        self.piece_of = np.array([pieces.get(t, -1) for t in self.tails], np.int64)
        self.first = np.full(len(letters) + 1, -1, np.int64)
        single = [t for t in self.tails if len(t) == 1]
        self.first[[letters[t] for t in single]] = [number[t] for t in single]
        steps = [(number[t[1:]] * len(self.first) + letters[t[0]], i) for t, i in number.items() if len(t) > 1]
        self.before = Numbers(18)
        self.before.put(*np.array(steps, np.int64).reshape(-1, 2).T)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best neighbours until none can be merged."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]  # noqa: B905
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece, the piece twice for a single character, None if merging doesn't make it."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:])]  # noqa: B905
            best = min(ranks)
            if best == math.inf:
                return None
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts[0], parts[-1]

    def _number_merges(self) -> None:
        """The same by numbers: halves and ranks of pieces and characters, and the piece that any two of them make."""
        parts = self.names + sorted(set(chain.from_iterable(self.rank)).difference(self.rank))
        number = {p: i for i, p in enumerate(parts)}
        halves = [self.halves.get(p) or (p, p) for p in parts]
        self.whole = np.array([p == "" or self.halves.get(p) is not None for p in parts])
        self.half_of = np.array([[number[x] for x in pair] for pair in halves], np.int64).T
        self.made_at = np.array([self.rank[p] if len(p) > 1 else -math.inf for p in parts])
        self.seam_at = np.array([*self.rank.values(), math.inf])  # -1: no piece
        self.blanks = np.array([[p[:1] == SPACE, p[-1:] == SPACE, SPACE * 2 in p] for p in parts]).T
        seams = [(number[p[:k]] * len(parts) + number[p[k:]], i) for i, p in enumerate(self.rank) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.seam = Numbers(18)
        self.seam.put(*np.array(seams, np.int64).reshape(-1, 2).T)

    def fits(self, before: str, piece: str) -> bool:
        """Whether ``piece`` can be the next token after ``before`` (empty: the first).

        Walks back in time over what stood at the seam: of the two sides, the
        one made last is taken apart, and the pair is wrong if the seam could
        have been merged before that.
        """
        if self.halves[piece] is None or not before:
            return self.halves[piece] is not None
        if SPACE * 2 in before + piece:  # runs of blanks all have the same rank
            return self.merged(before + piece) == [before, piece]
        left, right, until = before, piece, (math.inf, 0)
        made = lambda x: self.rank[x] if len(x) > 1 else -math.inf
        while True:
            seam = self.rank.get(left + right)
            if seam is not None and (seam, 0) < until:
                return False
            if len(left) == len(right) == 1:
                return True
            if made(left) > made(right):
                until, left = (made(left), 0), self.halves[left][1]
            else:
                until, right = (made(right), 1), self.halves[right][0]

    def _fit_all(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs of piece numbers."""
        out = self.whole[piece]
        begins, ends, inside = self.blanks
        odd = inside[before] | inside[piece] | ends[before] & begins[piece]
        for i in np.flatnonzero(odd & out).tolist():
            out[i] = self.fits(self.names[before[i]], self.names[piece[i]])
        open_ = np.flatnonzero(out & ~odd & (before != len(self.names) - 1))
        left, right = before[open_], piece[open_]
        until, by_right = np.full(len(open_), math.inf), np.zeros(len(open_), bool)
        while len(open_):
            seam = self.seam_at[self.seam.get(left * len(self.whole) + right)]
            bad = (seam < until) | by_right & (seam == until)
            out[open_[bad]] = False
            made_left, made_right = self.made_at[left], self.made_at[right]
            on = np.flatnonzero(~bad & ((made_left > -math.inf) | (made_right > -math.inf)))
            open_, left, right, made_left, made_right = open_[on], left[on], right[on], made_left[on], made_right[on]
            by_right = made_left <= made_right
            until = np.maximum(made_left, made_right)
            left, right = np.where(by_right, left, self.half_of[1][left]), np.where(by_right, self.half_of[0][right], right)
        return out

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the second of each pair of piece numbers can follow the first."""
        known = self.fit.get(pairs)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new, at = np.unique(pairs[missing], return_inverse=True)
            if len(self.fit) + len(new) > PAIR_ENTRIES:
                self.fit = Numbers()
            found = self._fit_all(*np.divmod(new, len(self.names))).astype(np.int64)
            self.fit.put(new, found)
            known[missing] = found[at]
        return known == 1

    def _ending(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and numbers of all pieces that end at any place, shorter ones of a place first."""
        node = self.first[chars]
        at = np.flatnonzero(node >= 0)
        node, length = node[at], 1
        places, lengths, pieces = [at[:0]], [at[:0].astype(np.int8)], [self.piece_of[:0]]
        while len(at):
            piece = self.piece_of[node]
            whole = np.flatnonzero(piece >= 0)
            places.append(at[whole])
            lengths.append(np.full(len(whole), length, np.int8))
            pieces.append(piece[whole])
            node = self.before.get(node * len(self.first) + chars[at - length])
            on = np.flatnonzero(node >= 0)
            node, at, length = node[on], at[on], length + 1
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(pieces)

    def _solve_block(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all prefixes of units, longest first, and where each unit's begin.

        Goes from one length of prefixes to the next, all units together.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer(("\0" + "\0".join(units)).encode("utf-32-le", "surrogatepass"), "<u4")
        chars = self.char_of[points]
        chars[starts] = 0  # nothing ends across the beginning of a unit
        n_bytes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        places, lengths, pieces = self._ending(chars)
        level = (places - np.repeat(starts, sizes + 1)[places]).astype(np.min_scalar_type(int(sizes[0])))
        order = np.argsort(level, kind="stable")
        ends = np.cumsum(np.bincount(level, minlength=int(sizes[0]) + 1))
        places, lengths, pieces = places[order], lengths[order], pieces[order]
        counts, last = np.zeros(len(points), np.int64), np.full(len(points), len(self.names) - 1, np.int64)
        longer = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), side="right")
        for k in range(1, int(sizes[0]) + 1):
            here = starts[: longer[k]] + k
            counts[here] = counts[here - 1] + n_bytes[here]  # a character without a piece: one token for each of its bytes, and nothing merges with it
            some = slice(ends[k - 1], ends[k])
            at, piece = places[some], pieces[some]
            start = at - lengths[some]
            good = np.flatnonzero(self._fit(last[start] * len(self.names) + piece))
            last[at[good]] = piece[good]
            counts[at[good]] = counts[start[good]] + 1
        return counts, starts

    def _walk(self, unit: str) -> np.ndarray:
        """The counts of all prefixes of one unit, by the same steps for a single text."""
        piece_at, fit_of = self.tails.get, self.seams.get
        counts, last = [0], [""]
        for end in range(1, len(unit) + 1):
            start, starts = end - 1, []
            while start >= 0:
                is_piece = piece_at(unit[start:end])
                if is_piece is None:
                    break
                if is_piece:
                    starts.append(start)
                start -= 1
            while starts:
                start = starts.pop()
                before, piece = last[start], unit[start:end]
                known = fit_of((before, piece))
                if known is None:
                    if len(self.seams) >= SEAM_ENTRIES:
                        self.seams.clear()
                    known = self.seams[before, piece] = self.fits(before, piece)
                if known:
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                counts.append(counts[-1] + len(unit[end - 1].encode("utf-8", "surrogatepass")))
                last.append("")
        return np.array(counts, np.int64)

    def solve(self, units: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of units, the counts of all prefixes of each (of 0, 1, 2, ... characters), and where each unit's begin.

        Units begin a text or follow a chunk, with ``SPACE`` for blanks.  The few
        that are far longer than the others are gone through one by one.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-sizes, kind="stable")
        longest = max([LONG_UNIT, *sizes[order[FEW_UNITS : FEW_UNITS + 1]].tolist()])
        k = 0
        while k < len(order) and sizes[order[k]] > longest:
            yield order[k : k + 1], self._walk(units[order[k]]), order[:1] * 0
            k += 1
        filled = np.cumsum(sizes[order] + 1)
        while k < len(order):
            stop = max(k + 1, int(np.searchsorted(filled, (filled[k - 1] if k else 0) + BLOCK_CHARS, side="right")))
            yield order[k:stop], *self._solve_block([units[i] for i in order[k:stop].tolist()])
            k = stop

    def totals(self, units: Sequence[str]) -> np.ndarray:
        """The count of each unit."""
        out = np.zeros(len(units), np.int64)
        for which, counts, starts in self.solve(units):
            out[which] = counts[np.append(starts[1:], len(counts)) - 1]
        return out

    def _chunk_pattern(self) -> str:
        """Cut before white space, and between a letter and an ASCII mark or digit: no piece has one behind the other.

        Word characters that some piece does have before a mark don't count as letters.
        """
        mark = re.compile(r"[!-@\[-`{-~]")
        odd = {a for p in self.rank for a, b in zip(p, p[1:]) if re.fullmatch(r"[^\W\d_]", a) and mark.match(b)}  # noqa: B905
        of = re.escape("".join(sorted(odd)))
        if any(c.isalpha() for c in odd):
            raise ValueError("a piece has a letter before a mark")
        letter, other = f"[^\\W\\d_{of}]", f"(?:(?![ \n])[\\W\\d_{of}])"
        body = f"(?:{other}+|{letter}+(?!{mark.pattern}))"
        return f"\n| +{body}*{letter}?|{body}+{letter}?|{letter}"

    def chunks(self, text: str) -> list[str]:
        """Parts whose encodings don't depend on each other; together the normalised text."""
        return self.pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    def _prefixes(self, units: set[str]) -> dict[str, np.ndarray]:
        """The counts of all prefixes of each unit."""
        names, found = list(units), {}
        for which, counts, starts in self.solve(names):
            found.update(zip([names[i] for i in which.tolist()], np.split(counts, starts[1:]), strict=True))
        return found

    def counts(self, texts: list[str]) -> list[int]:
        """Exact token counts of whole texts."""
        return [n for n, _ in self.counts_and_cuts(texts, None)]

    def counts_and_cuts(self, texts: list[str], limit: int | None) -> list[tuple[int, int | None]]:
        """Exact token counts of whole texts, and the code points of the longest prefix within the limit of those beyond it.

        The distinct words of all texts are solved together.  A cut lies in the
        first unit that isn't within the limit as a whole, as every unit takes a token.
        """
        texts = [t.replace(SPACE, " ") for t in texts]
        # words behind a single blank or a line feed are solved as they are; runs of blanks belong to the chunk behind them
        simple = [i for i, t in enumerate(texts) if t and "  " not in t and t[0] != " "]
        codes, bounds, used = words_by_text([texts[i].replace("\n", " \n") for i in simple])
        words = list(self.words.unknown(set(used)))
        cut = {w: self.pattern.findall(w if w[0] == "\n" else " " + w) for w in words if len(w) >= LONG_UNIT}
        whole = {i: self.chunks(t) for i, t in enumerate(texts) if t and ("  " in t or t[0] == " ")}
        parts = list(self.parts.unknown(set(chain.from_iterable(chain(cut.values(), whole.values())))))
        words = [w for w in words if w not in cut] if cut else words
        unit = lambda w: w if w[:1] == "\n" else SPACE + w
        totals = self.totals([unit(w) for w in words] + [p.replace(" ", SPACE) for p in parts]).tolist()
        of_word, of_part = self.words.newer, self.parts.newer
        of_word.update(zip(words, totals))  # noqa: B905
        of_part.update(zip(parts, totals[len(words) :], strict=True))
        of_word.update((w, sum([of_part[p] for p in found])) for w, found in cut.items())
        out = [0] * len(texts)
        cuts: dict[int, tuple[int, int, str]] = {}  # tokens and characters before the unit that the cut is in
        if simple:
            each = np.fromiter(map(of_word.__getitem__, used), np.int64, len(used))
            for k, (i, n) in enumerate(zip(simple, np.add.reduceat(each[codes], bounds[:-1]).tolist(), strict=True)):
                out[i] = n
                if limit is not None and n > limit:
                    places = codes[bounds[k] : bounds[k + 1]]
                    filled = np.cumsum(each[places])
                    fit = int(np.searchsorted(filled, limit, side="right"))
                    first = [unit(used[c]) for c in places[: fit + 1].tolist()]
                    cuts[i] = int(filled[fit - 1]) if fit else 0, sum(map(len, first[:-1])), first[-1]
        for i, found in whole.items():
            filled = list(accumulate(of_part[p] for p in found))
            out[i] = filled[-1]
            if limit is not None and out[i] > limit:
                fit = bisect_right(filled, limit)
                cuts[i] = filled[fit - 1] if fit else 0, sum(map(len, found[:fit])), found[fit].replace(" ", SPACE)
        prefixes = self._prefixes({u for _, _, u in cuts.values()})
        # the blank put before the text is no character of its own
        at = {i: max(0, chars - 1 + int(np.flatnonzero(prefixes[u] <= limit - n)[-1])) for i, (n, chars, u) in cuts.items()}
        return [(n, at.get(i)) for i, n in enumerate(out)]

    def table(self, text: str) -> np.ndarray:
        """Exact token count of the first 0, 1, 2, ... code points of a text."""
        chunks = self.chunks(text)
        if not chunks:
            return np.zeros(1, np.int64)
        solved = self._prefixes({c.replace(" ", SPACE) for c in chunks})
        chunks = [c.replace(" ", SPACE) for c in chunks]
        totals = np.cumsum([0] + [solved[c][-1] for c in chunks])
        counts = np.concatenate([solved[c][1:] + n for c, n in zip(chunks, totals)])  # noqa: B905
        counts[0] = 0  # the blank put before the text is no prefix of its own
        return counts

    def longest_prefix(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens."""
        return int(np.flatnonzero(self.table(text) <= limit)[-1])


@cache
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def with_token_counts(df: DataFrame, model_path: str, limit: int, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens``, ``over_limit`` and ``cut_at``.

    ``cut_at`` is the number of code points of the longest prefix within the
    limit, null for texts that are within it as a whole.  Null or empty text
    has no bytes and no tokens.  Repeated rows get the same figures.
    """

    def rows(texts: list) -> list[tuple]:
        model = counter(model_path)
        found: list[tuple] = []
        turn, chars = [], 0
        for t in texts:
            turn.append(t or "")
            chars += len(turn[-1])
            if chars >= TURN_CHARS:
                found += model.counts_and_cuts(turn, limit)
                turn, chars = [], 0
        return found + model.counts_and_cuts(turn, limit)

    sized = df.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
    return with_columns_by_batch(sized, COUNT_DDL, rows, (text,), drop).withColumn("over_limit", F.col("n_tokens") > limit)


def with_prefix_tables(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Append ``prefix_tokens``: the exact token count of the first 0, 1, 2, ... code points.

    Null or empty text gives the table of the empty prefix alone, ``[0]``.
    """

    def rows(texts: list) -> list[tuple]:
        model = counter(model_path)
        return [(model.table(t or "").tolist(),) for t in texts]

    return with_columns_by_batch(df, "prefix_tokens array<long>", rows, (text,))


def within_budget(df: DataFrame, budget: int) -> DataFrame:
    """Append ``fits_chars``, from a table of ``with_prefix_tables``: the longest prefix of at most ``budget`` tokens.

    A budget under 0 fits nothing, not even the empty prefix, and gives null.
    """
    at = F.filter(F.sequence(F.lit(0), F.size("prefix_tokens") - 1), lambda i: F.get("prefix_tokens", i) <= budget)
    return df.withColumn("fits_chars", F.array_max(at).cast("long"))
