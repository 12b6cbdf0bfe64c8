"""Ids and counts of the word encoder and the prefix counter against the libraries, on texts made to differ."""

import gc
import random
import time
import tracemalloc

import numpy as np
import pytest

from cutover.llm import common, pack_windows, token_prefix
from cutover.llm.queries import tokenizer_path

LETTERS = "aAzZeéÉñßİıǰŉſKΣςσἈЯяʼ中日ﬁⅧªµ̇́0123"
MARKS = ",.!?;:'\"-_()$%&*#<>|…—«»¡¿’"
SPACES = " \n\t\r  　"


def texts(seed, n):
    rng = random.Random(seed)
    out = ["İ!", "İ.", "DİYARBAKIRİ.", "ΑΣ. ΑΣ, Σ!", "ŉ!", "ǰ.", "", " ", "  a", "a  b", "\n", "a.\n\nb!  c"]
    for _ in range(n):
        word = lambda: "".join(rng.choices(LETTERS, k=rng.randint(1, 6))) + "".join(rng.choices(MARKS, k=rng.choice([0, 0, 1, 1, 2])))
        out.append("".join(word() + rng.choice(SPACES if rng.random() < 0.1 else " ") for _ in range(rng.randint(1, 12))))
    return out


@pytest.mark.parametrize("entries", [40, 1_400_000])
def test_ids_are_the_librarys(monkeypatch, entries):
    from tokenizers import Tokenizer

    monkeypatch.setattr(pack_windows, "CACHE_ENTRIES", entries)
    path = tokenizer_path("word_bpe_49k.json")
    encoder, library, some = pack_windows.WordEncoder(path), Tokenizer.from_file(path), texts(entries, 4000)
    got = []
    for k in range(0, len(some), 97):
        got += [np.frombuffer(ids, "<u4").tolist() for ids, _ in encoder.encode(some[k : k + 97])]
    assert [t for t, ids in zip(some, got, strict=True) if ids != library.encode(t, add_special_tokens=False).ids] == []


@pytest.mark.parametrize("entries", [40, 1_000_000])
def test_counts_are_the_librarys(monkeypatch, entries):
    import sentencepiece

    monkeypatch.setattr(token_prefix, "WORD_ENTRIES", entries)
    monkeypatch.setattr(token_prefix, "CHUNK_ENTRIES", entries)
    path = tokenizer_path("piece_bpe_32k.model")
    counter, library, some = token_prefix.PrefixCounter(path), sentencepiece.SentencePieceProcessor(model_file=path), texts(entries + 1, 4000)
    got = []
    for k in range(0, len(some), 97):
        got += counter.counts(some[k : k + 97])
    assert [t for t, n in zip(some, got, strict=True) if n != len(library.encode(t))] == []


def test_counts_of_long_words_and_small_blocks(monkeypatch):
    import sentencepiece

    path, rng = tokenizer_path("piece_bpe_32k.model"), random.Random(4)
    monkeypatch.setattr(token_prefix, "BLOCK_CHARS", 50)
    monkeypatch.setattr(token_prefix, "PAIR_ENTRIES", 30)
    monkeypatch.setattr(token_prefix, "SEAM_ENTRIES", 30)
    counter, library = token_prefix.PrefixCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    some = texts(5, 300) + ["".join(rng.choices("abthein,.1\x00\n中", k=rng.choice([5, 63, 64, 65, 700]))) + rng.choice(["", "  a", " a", "\n"]) for _ in range(60)]
    some += [chr(97 + k % 26) * (70 + k) for k in range(40)]
    for k in range(0, len(some), 80):
        assert counter.counts(some[k : k + 80]) == [len(library.encode(t)) for t in some[k : k + 80]]
    for t in some[-45:-38]:
        assert counter.table(t).tolist()[-1] == len(library.encode(t)) and len(counter.table(t)) == len(t) + 1


@pytest.mark.parametrize("limit", [0, 1, 2, 7, 40])
def test_cuts_are_those_of_the_whole_table(limit):
    counter, rng = token_prefix.PrefixCounter(tokenizer_path("piece_bpe_32k.model")), random.Random(limit)
    some = texts(limit, 300) + ["".join(rng.choices("abthein,.1\x00\n中😀ᛃ", k=rng.choice([5, 64, 200]))) + rng.choice(["", "  a", " a", "\n"]) for _ in range(60)]
    got = counter.counts_and_cuts(some, limit)
    assert got == [(n, counter.longest_prefix(t, limit) if n > limit else None) for t, n in zip(some, counter.counts(some), strict=True)]
    assert any(at is not None for _, at in got)


def test_cuts_solve_one_word_of_a_text(monkeypatch):
    counter, solved = token_prefix.PrefixCounter(tokenizer_path("piece_bpe_32k.model")), []
    solve = counter.solve
    monkeypatch.setattr(counter, "solve", lambda units: solved.extend(units) or solve(units))
    words = [f"word{k}" for k in range(3000)]
    ((n, at),) = counter.counts_and_cuts([" ".join(words)], 4096)
    assert n > 4096 and 0 < at < 30_000 and len(solved) == 3001


def test_pairs_are_judged_alike_one_by_one_and_together():
    counter, rng = token_prefix.PrefixCounter(tokenizer_path("piece_bpe_32k.model")), random.Random(6)
    n = len(counter.rank)
    blanks = [i for i, p in enumerate(counter.rank) if p.strip(token_prefix.SPACE) == ""]
    before, piece = ([rng.choice(blanks) if rng.random() < 0.05 else rng.randrange(n) for _ in range(20_000)] for _ in range(2))
    before[:100] = [n] * 100  # the first of a text
    seams = [(p[:k], p[k:]) for p in list(counter.rank)[:3000] for k in range(1, len(p)) if p[:k] in counter.rank and p[k:] in counter.rank]
    number = {p: i for i, p in enumerate(counter.rank)}
    before, piece = before + [number[a] for a, _ in seams], piece + [number[b] for _, b in seams]
    got = counter._fit_all(np.array(before), np.array(piece)).tolist()
    assert got == [counter.fits(counter.names[a], counter.names[b]) for a, b in zip(before, piece, strict=True)] and 0 < sum(got) < len(got)
    assert all(whole == (counter.merged(p) == [p]) for p, whole in list(zip(counter.rank, counter.whole.tolist()))[::37])  # noqa: B905


def test_new_words_are_counted_together():
    """Counts of texts whose words are all new take no loop over the characters of every word (2 times the library's time; 6 before)."""
    import sentencepiece

    path, rng = tokenizer_path("piece_bpe_32k.model"), random.Random(7)
    counter, library = token_prefix.PrefixCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    parts = "the and tion ing ent er es on in at re ou ti sh wh ble ed an or nd".split()
    some = [" ".join("".join(rng.choices(parts, k=rng.randint(2, 7))) for _ in range(400)) for _ in range(500)]
    began = time.process_time()
    got = counter.counts(some)
    ours = time.process_time() - began
    assert got == [len(x) for x in library.encode(some, num_threads=1)]
    assert ours < 4 * (time.process_time() - began - ours)


def test_numbers_by_key():
    rng = random.Random(9)
    kept, want = common.Numbers(4), {}
    for _ in range(60):
        new = {rng.randrange(1 << 43) if rng.random() < 0.5 else rng.randrange(500): rng.randrange(1 << 20) for _ in range(rng.randint(0, 40))}
        new = {k: v for k, v in new.items() if k not in want}
        kept.put(np.array(list(new), np.int64), np.array(list(new.values()), np.int64))
        want |= new
        asked = [*rng.sample(list(want), min(len(want), 30)), *(rng.randrange(700) for _ in range(30))]
        assert kept.get(np.array(asked, np.int64)).tolist() == [want.get(k, -1) for k in asked]
        assert len(kept) == len(want) and 2 * len(kept) <= len(kept.slots)


def test_kept_words_take_little_memory():
    encoder, rng = pack_windows.WordEncoder(tokenizer_path("word_bpe_49k.json")), random.Random(8)
    some = [" ".join("".join(rng.choices("abcdefghinorst", k=8)) + rng.choice([",", "", "."]) for _ in range(500)) for _ in range(80)]
    gc.collect()
    tracemalloc.start()
    try:
        for k in range(0, len(some), 20):
            list(encoder.encode(some[k : k + 20]))
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(encoder.words) > 39_000 and held + encoder.words.nbytes < 80 * len(encoder.words)  # about 250 bytes a word before


def test_positions_after_sentences():
    encoder = pack_windows.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    (ids, stops), (none, no_stops) = encoder.encode(["one two. three! four", ""])
    assert len(ids) // 4 == 6 and stops.tolist() == [3, 5] and none == b"" and no_stops.tolist() == []


def test_recent_answers():
    rng = random.Random(8)
    kept = common.Recent(20)
    for _ in range(300):
        asked = {min(int(rng.paretovariate(0.7)), 500) for _ in range(rng.randint(1, 9))}
        for k in kept.unknown(asked):
            kept.newer[k] = k * k
        more = {rng.randint(0, 500) for _ in range(3)}
        for k in kept.also_unknown(more):
            kept.newer[k] = k * k
        assert all(kept.newer[k] == k * k for k in asked | more)
        assert len(kept.newer) <= 10 + 12 and len(kept.older) <= 10 + 12
    assert 1 in kept.newer or 1 in kept.older
