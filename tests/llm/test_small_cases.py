"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutover.llm import decontaminate, language_cnn, line_runs, near_forest, pack_windows, pii_feistel, preference_chat, quality_divergence, secret_ledger, token_prefix
from cutover.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "und so weiter. " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, None, None, "a", 0), (2, "", "en", "a", 0), (3, LONG, "de", None, 1), (4, "same text\nhere", "en", "b", 2), (4, "same text\nhere", "en", "b", 2), (None, "no id", None, None, None), (5, "  \n\t ", "fr", "c", 3)], DOCS)


OPERATORS = {
    "secrets": lambda d: secret_ledger.join_back(d, secret_ledger.scan(d)),
    "language": lambda d: language_cnn.with_language(d, language_cnn.trained(d)),
    "near": lambda d: near_forest.near_duplicates(d),
    "packing": lambda d: pack_windows.packed(d, tokenizer_path("word_bpe_49k.json")),
    "decontaminate": lambda d: decontaminate.find_occurrences(d, d.withColumnRenamed("doc_id", "item_id")),
    "lines": lambda d: line_runs.without_repeated_runs(d, 2),
    "pii": lambda d: pii_feistel.with_pseudonyms(d, b"k"),
    "tokens": lambda d: token_prefix.with_token_counts(d, tokenizer_path("piece_bpe_32k.model"), 4096),
    "quality": lambda d: quality_divergence.judged(d),
}
#: Columns that an operator adds, as input columns of other content.
CLASHES = ("blob", "found", "lang_pred", "score", "n_shingles", "component_id", "kept", "n_words", "hits", "items", "n_lines", "deleted_lines", "n_tokens", "n_bytes", "over_limit", "N_SYMBOLS", "_h", "_spans", "_id")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    if name == "packing":
        assert sum(r.length for r in rows if r.doc_id == 1) == sum(r.length for r in rows if r.doc_id == 2) == 1
    else:
        assert len(rows) == 7 and [r for r in rows if r.doc_id == 4][0] == [r for r in rows if r.doc_id == 4][1]
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, docs, name):
    plain, clash = OPERATORS[name](docs), OPERATORS[name](docs.withColumns({c: F.lit("x") for c in CLASHES}))
    rows = lambda df: sorted(df.select(*plain.columns).collect(), key=repr)
    assert rows(clash) == rows(plain)


def test_secret_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, "a", 'token = "abcdefgh1"'), (2, "b", 'token = "abcdefgh1"'), (3, "c", "nothing")], "version long, path string, text string")
    ledger = secret_ledger.scan(first).cache()
    assert ledger.count() == 2
    more = first.union(spark.createDataFrame([(4, "d", "AKIA" + "A" * 12)], first.schema))
    new = secret_ledger.scan(more, ledger).collect()
    assert len(new) == 1 and [s.kind for s in new[0].found] == ["access"]
    extra = (*secret_ledger.RULES, secret_ledger.Rule("word", 1, "noth[a-z]+"))
    again = secret_ledger.scan(first, ledger, extra)
    assert {tuple(r.rules) for r in again.collect()} == {("word/1",)}
    found = secret_ledger.join_back(first, ledger.unionByName(again), extra).collect()
    assert {r.path: [s.kind for s in r.found] for r in found} == {"a": ["assign"], "b": ["assign"], "c": ["word"]}


def test_findings_of_replaced_rule_versions_do_not_come_back(spark):
    docs = spark.createDataFrame([(1, 'token = "abcdefgh1" ' + "0f" * 16), (2, "AKIA" + "A" * 12), (3, None)], "doc_id long, text string")
    ledger = secret_ledger.scan(docs)
    assign, *others = secret_ledger.RULES
    newer = (*others, secret_ledger.Rule("assign", 2, assign.pattern.replace("token", "tokens"), 2, 8, assign.needs))
    both = ledger.unionByName(secret_ledger.scan(docs, ledger, newer)).cache()
    kinds = lambda rules: {r.doc_id: [(s.kind, s.rule) for s in r.found] for r in secret_ledger.join_back(docs, both, rules).collect()}
    assert kinds(newer) == {1: [("hex", "hex/1")], 2: [("access", "access/1")], 3: []}
    assert kinds(secret_ledger.RULES) == {1: [("assign", "assign/1"), ("hex", "hex/1")], 2: [("access", "access/1")], 3: []}
    assert all(r.found == [] for r in secret_ledger.join_back(docs, both.limit(0)).collect())


def test_secret_spans_by_brute_force():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    pick = random.Random(5)
    parts = ["token", "SECRET", "api_key", "ſecret", ":", "=", " ", '"', "short", "longenough1", "AKIA", "ABCDEFGHIJ12", "0123456789abcdef", "é", "x", "'"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 14)))
        want = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert secret_ledger.spans(text, secret_ledger.RULES) == sorted(want), text


def test_token_counts_agree_with_the_library():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, ours, pick = sentencepiece.SentencePieceProcessor(model_file=path), token_prefix.PrefixCounter(path), random.Random(1)
    pieces = [p.replace("▁", " ") for p in ours.rank]
    texts = ["", " ", "  ", "\n\n a", "<s> hi </s>", "a▁b", "日本 語", "\x00a", "1234 5.6", "m². x", LONG[:3000]]
    texts += ["".join(pick.choice("abcdeé ▁\n.,1的<s>/") for _ in range(pick.randint(1, 40))) for _ in range(500)]
    texts += ["".join(pick.choice(pieces) for _ in range(pick.randint(1, 6))) for _ in range(500)]
    assert ours.counts(texts) == [len(x) for x in library.encode(texts)]
    for t in texts[-60:] + texts[:11]:
        t = t[:200]
        assert ours.table(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)]


def test_budget_questions_from_the_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    tables = token_prefix.with_prefix_tables(docs, tokenizer_path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in token_prefix.within_budget(tables, 2).collect()}
    assert rows[2].prefix_tokens == [0] and rows[2].fits_chars == 0
    counts = rows[1].prefix_tokens
    assert rows[1].fits_chars == max(k for k, n in enumerate(counts) if n <= 2)


def _packing_cost(ends, penalties, size, unpadded):
    """Cheapest cost by trying every earlier cut."""
    best = {0: 0}
    for at, p in zip(ends, penalties, strict=True):
        options = [best[i] + (0 if at - i in unpadded else size - (at - i)) for i in best if 0 < at - i <= size]
        best[at] = min(options) + p + pack_windows.WINDOW_COST
    return best[ends[-1]] if ends else 0


def test_cuts_by_definition():
    rng = random.Random(12)
    for _ in range(200):
        lengths = [rng.choice([1, 64, 128, rng.randint(1, 60), rng.randint(1, 3000)]) for _ in range(rng.randint(0, 12))]
        sentences = [np.array(sorted(rng.sample(range(1, n + 1), rng.randint(0, min(n, 20)))), np.int64) for n in lengths]
        places, at = {}, 0  # each cut with its penalty
        for n, inner in zip(lengths, sentences, strict=True):
            places |= {at + int(x): pack_windows.SENTENCE_PENALTY for x in inner} | {at + n: 0}
            at += n
        ends, penalties = pack_windows.candidates(lengths, sentences)
        assert ends == sorted(set(ends)) and max([b - a for a, b in zip([0, *ends], ends)], default=0) <= pack_windows.STEP
        assert {e: p for e, p in zip(ends, penalties, strict=True) if p != pack_windows.MIDDLE_PENALTY} == places
        starts = pack_windows._unpadded_starts([0, *ends], (64, 128))
        by_place = {x: k for k, x in enumerate([0, *ends])}
        assert list(zip(*starts, strict=True)) == [(k, by_place[x - n]) for x, k in by_place.items() for n in (64, 128) if x - n in by_place]


def test_cheapest_cuts_by_brute_force():
    pick = random.Random(3)
    for _ in range(300):
        size, unpadded = 32, (4, 8, 16, 32)
        ends = sorted({*(pick.randint(1, 150) for _ in range(pick.randint(1, 40))), *range(20, 160, 20)})
        penalties = [pick.choice([0, 3, 10]) for _ in ends]
        cuts = pack_windows.cheapest_cuts(ends, penalties, size, unpadded)
        by_end, cost, before = dict(zip(ends, penalties, strict=True)), 0, 0
        for c in cuts:
            assert 0 < c - before <= size
            cost += by_end[c] + pack_windows.WINDOW_COST + (0 if c - before in unpadded else size - (c - before))
            before = c
        assert cuts[-1] == ends[-1] and cost == _packing_cost(ends, penalties, size, unpadded)


def test_packing_round_trip(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = [None, "", "It's the <|endoftext|> end. Isn't it?\nYes!", LONG, "İstanbul ΑΣ 12345 a b", *(f"document {k}. " * (k % 50) for k in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = pack_windows.packed(docs, path).collect()
    library, windows = Tokenizer.from_file(path), {}
    for doc, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids) // 4
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids) // 4
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = [sum(n for _, n in parts) for parts in windows.values()]
    assert sum(used) / sum(n if n & (n - 1) == 0 else 2048 for n in used) > 0.9


def _hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 30])
def test_decontamination_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 15)
    pick = random.Random(2)
    word = lambda: pick.choice(["a", "B", "c", "é", "Z9"])
    items = [(k, pick.choice([" ", ", ", "\n"]).join(word() for _ in range(pick.choice([0, 1, 3, 9, 10, 12, 40])))) for k in range(12)] + [(3, None)]
    texts = [" ".join(word() for _ in range(pick.randint(0, 30))) + " " + (pick.choice(items)[1] or "") + "; " + word() for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.find_occurrences(docs, spark.createDataFrame(items, "item_id long, text string"))
    for r in out.withColumn("n_hit", decontaminate.hit_words()).collect():
        assert (r.n_words, r.n_hit, r["items"]) == _hits(texts[r.doc_id], items)


def test_language_is_learnt_and_held_out_texts_are_told(spark):
    pick = random.Random(4)
    words = {"aa": ["the", "and", "of", "ing"], "bb": ["der", "und", "ßen", "ung"], "cc": ["le", "étê", "aux", "çe"]}
    rows = [(k, " ".join(pick.choice(words[g]) for _ in range(pick.randint(5, 300))), g) for k, g in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_cnn.trained(docs.filter("doc_id < 120"))
    out = language_cnn.with_language(docs.filter("doc_id >= 120"), network).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert language_cnn.predict(network, [None, "", "12 !", "und der"])[:3] == [("und", 0.0)] * 3


def test_every_language_has_its_share_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_cnn, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(language_cnn, "SAMPLE_PER_LANG", 25)
    monkeypatch.setattr(language_cnn.Network, "fit", lambda self, windows, labels: seen.append([self.languages[k] for k in labels]))
    sizes = [4000, 3000, 2000, 900, 500, 300, 200, 100, 40, 4]
    rows = [(f"text {g} {k}", f"l{g}") for g, n in enumerate(sizes) for k in range(n)] + [("one text", "l0")] * 500
    language_cnn.trained(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    assert [seen[0].count(f"l{g}") for g in range(10)] == [10] * 9 + [4]
    assert language_cnn.rows_of_each([7] * 3) == language_cnn.rows_of_each([50, 30]) == 25 and language_cnn.rows_of_each([90, 80, 2, 90, 90, 90]) == 19


@pytest.mark.parametrize("salt", range(4))
def test_languages_of_a_few_texts_are_sampled(spark, monkeypatch, salt):
    """Repeated rows neither crowd out other texts nor hide a language that has only a few."""
    seen = []
    monkeypatch.setattr(language_cnn, "SAMPLE_ROWS", 90)
    monkeypatch.setattr(language_cnn, "SAMPLE_PER_LANG", 30)
    monkeypatch.setattr(language_cnn.Network, "fit", lambda self, windows, labels: seen.append([self.languages[k] for k in labels]))
    rows = [(f"few {salt} {k % 3}", "few") for k in range(9000)] + [(f"many {salt} {k}", "many") for k in range(4000)] + [(f"hot {salt}", "many")] * 3000
    language_cnn.trained(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert (seen[0].count("few"), seen[0].count("many")) == (3, 30)


def _left(texts, least):
    """Lines that stay, by trying every run of every document."""
    lines = [[(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    size = lambda run: sum(len(x.split()) for _, x in run)
    first, gone = {}, [set() for _ in texts]
    for d, own in enumerate(lines):
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                first.setdefault(tuple(x for _, x in own[a:b]), (d, a))
    for d, own in enumerate(lines):
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = own[a:b]
                if size(run) >= least and first[tuple(x for _, x in run)] < (d, a):
                    gone[d] |= {i for i, _ in run}
    return [sorted(g) for g in gone]


def test_line_runs_by_brute_force(spark):
    pick = random.Random(6)
    for least in (1, 5, 12):
        texts = ["\n".join(pick.choice(["a", "b c", "d e f", "  b c ", "", "g h i j k l"]) for _ in range(pick.randint(1, 12))) for _ in range(25)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        rows = line_runs.without_repeated_runs(docs, least).collect()
        want = _left(texts, least)
        for r in rows:
            same = [k for k, t in enumerate(texts) if t == texts[r.doc_id]]
            assert r.deleted_lines == want[r.doc_id], (least, r.doc_id, same)
            assert r.text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in r.deleted_lines)


def test_short_repeated_lines_go_without_a_setting(spark):
    pick = random.Random(16)
    licence = "Licensed under the terms in the file named LICENSE"
    block = "one two three\nfour five\nsix"
    own = lambda: " ".join(f"w{pick.randint(0, 10**6)}" for _ in range(pick.randint(1, 20)))
    texts = ["\n".join(pick.choice([own(), own(), licence, block, "so on"]) for _ in range(12)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = line_runs.without_repeated_runs(docs).collect()
    assert [r.deleted_lines for r in sorted(rows)] == _left(texts, 5)
    assert sum(r.text.count(licence) for r in rows) == 1


def test_pseudonyms_keep_format_and_links_and_can_be_undone():
    p = pii_feistel.Permutation(b"key")
    text = "a.b1@mail.example.com +1 (988) 555-2485, 4041894974608795 4041-8949-7460-8795 10.1.2.3 1999-02-28 28/02/1999 078-05-1120 DE89370400440532013000 and 300.1.1.1 1999-02-30 4041894974608796"
    new, found = pii_feistel.replaced(p, text)
    assert [f["kind"] for f in found] == ["email", "phone", "card", "card", "ip", "date", "date", "ssn", "iban"]
    assert pii_feistel.replaced(p, new, inverse=True)[0] == text
    again, _ = pii_feistel.replaced(p, text)
    assert new == again and pii_feistel.replaced(pii_feistel.Permutation(b"other"), text)[0] != new
    values = [new[: len(text)][f["start"] : f["stop"]] for f in found if f["kind"] != "ip"][:4]
    assert re.sub("-", "", values[3]) == values[2] and values[2] != "4041894974608795"
    for kind, value in (("card", values[2]), ("phone", values[1])):
        assert pii_feistel.pseudonym(p, kind, value) is not None
    for limit in (1, 2, 7, 100):
        assert sorted(p.permute(n, limit, "t") for n in range(limit)) == list(range(limit))
        assert all(p.permute(p.permute(n, limit, "t"), limit, "t", inverse=True) == n for n in range(limit))


def test_no_shape_of_personal_data_stays():
    p, pick = pii_feistel.Permutation(b"key"), random.Random(23)
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    card = lambda n: (d := digits(n - 1)) + pii_feistel.luhn_digit(d)
    loose = {
        "phone": (r"\+?[0-9][0-9 ().-]{6,}[0-9]|\([0-9]{3}\) [0-9-]+", lambda: pick.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+1{digits(10)}", f"+44 20 {digits(4)} {digits(4)}", f"+49{digits(10)}", f"+358-{digits(2)}-{digits(3)}-{digits(4)}"])),
        "ip": (r"[0-9]+(?:\.[0-9]+){3}", lambda: ".".join(str(pick.randint(0, 255)) for _ in range(4))),
        "date": (r"[0-9]+/[0-9]+/[0-9]+", lambda: pick.choice([f"0{pick.randint(1, 9)}/{pick.randint(13, 28)}/20{digits(2)}", f"{pick.randint(10, 28)}/0{pick.randint(1, 9)}/19{digits(2)}"])),
        "iban": (r"[A-Z]{2}[0-9]{2} [0-9 ]+[0-9]", lambda: " ".join(re.findall(".{1,4}", "DE" + pii_feistel._iban_check("DE", d := digits(18)) + d))),
        "card": (r"[0-9]{4}[ -][0-9 -]+[0-9]", lambda: (lambda c, s: f"{c[:4]}{s}{c[4:10]}{s}{c[10:]}")(card(pick.choice([14, 15])), pick.choice(" -"))),
    }
    for kind, (pattern, make) in loose.items():
        seen = {}
        for _ in range(300):
            value = make()
            text = f"call {value} NOW, or x"
            new, found = pii_feistel.replaced(p, text)
            assert re.search(pattern, text)[0] == value and [(f["kind"], text[f["start"] : f["stop"]]) for f in found] == [(kind, value)], (kind, value)
            assert pii_feistel.replaced(p, new, inverse=True)[0] == text and seen.setdefault(new, text) == text
    as_dates = {pii_feistel._day(pii_feistel.pseudonym(p, "date", x))[0] for x in ("2020-03-25", "25/03/2020", "03/25/2020", "25.03.2020")}
    assert len(as_dates) == 1
    assert pii_feistel.pseudonym(p, "iban", "DE89 3704 0044 0532 0130 00").replace(" ", "") == pii_feistel.pseudonym(p, "iban", "DE89370400440532013000")


def test_preference_pairs(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (2, 2, "user", "why"), (3, 0, None, None), (4, 0, None, None), (None, 0, "user", "x"), (6, 0, "assistant", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = preference_chat.conversations_as_pairs(df, F.floor((F.col("conv_id") - 1) / 2), F.col("conv_id") % 2 == 1)
    rows = {r.pair_id: r for r in preference_chat.with_completions(pairs).collect()}
    assert rows[0].prompt == "<|user|>\nq<|end|>\n" and rows[0].n_common == 1 and rows[0].usable
    assert rows[0].chosen_completion == "<|assistant|>\nyes<|end|>\n" and rows[0].rejected_mask == "10"
    assert rows[1].n_common == 1 and rows[1].chosen_completion == "" and not rows[1].usable
    assert rows[2].n_common == 0 and rows[2].chosen == [] and not rows[2].usable
    assert preference_chat.with_completions(pairs.limit(0)).count() == 0


def test_distance_and_base_counts():
    import numpy as np

    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert quality_divergence.distance(p, p) == 0 and abs(quality_divergence.distance(p, q) ** 2 - 0.5) < 1e-12
    pick = random.Random(8)
    for _ in range(300):
        text = "".join(pick.choice(["a ", "b ", "é#", "\n", "c\n", " ", "*", "<x> ", "\x0b"]) for _ in range(pick.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        again = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words)
        want = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n)
        assert quality_divergence.base_counts(text)[0] == want


def test_quality_rejects_what_is_far_from_its_language(spark):
    pick = random.Random(9)
    clean = [" ".join(pick.choice(["the", "of", "and", "in"] + [f"w{pick.randint(0, 9)}x{k}y{j}" for j in range(4)]) for _ in range(150)) + "." for k in range(60)]
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(100, " | ".join(f"zz{k}q" for k in range(150)), "en"), (101, clean[0].upper(), "en"), (102, clean[1], None)]
    out = {r.doc_id: r for r in quality_divergence.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[k].kept for k in range(60)) and not out[100].kept and not out[101].kept and out[102].kept
    assert hashlib.sha256(b"").hexdigest()[:6] == "e3b0c4"


def test_quality_judges_rare_languages_too(spark):
    pick = random.Random(19)
    words = {"en": ["the", "of", "and", "in"], "fi": ["ja", "on", "ei", "se"]}
    clean = lambda g, n=150: " ".join(pick.choice(words[g] + [f"w{pick.randint(0, 9)}x{k}" for k in range(4)]) for _ in range(n)) + "."
    junk = lambda k: " | ".join(f"ZZ{k}Q{j}" for j in range(150))
    rows = [(k, clean("en", 9000), "en") for k in range(150)] + [(k, clean("fi"), "fi") for k in range(200, 232)] + [(240, junk(1), "fi"), (241, junk(2), "xx"), (242, clean("en"), "xx"), (243, junk(3), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    frequent, rare = quality_divergence.language_references(docs)
    assert list(frequent) == ["en"] and sorted(r.lang for r in rare.collect()) == ["fi", "xx"]
    out = {r.doc_id: r for r in quality_divergence.judged(docs).collect()}
    assert len(out) == len(rows) and all(out[k].kept and out[k].nearest_lang == "fi" for k in range(200, 232))
    assert [out[k].kept for k in (240, 241, 242, 243)] == [False, False, True, False] and out[241].word_distance is not None


@pytest.mark.parametrize("n", [1, 2, 29, 30, 31, 150])
def test_quality_keeps_clean_documents_of_languages_of_any_size(spark, monkeypatch, n):
    """Clean documents stay, and junk by its characters goes, however many there are of the language, and whatever its script."""
    monkeypatch.setattr(quality_divergence, "LANGUAGE_PARTS", 20)
    pick = random.Random(23)
    words = {"en": ["the", "of", "and", "in"], "fi": ["ja", "on", "ei", "se"], "ru": ["это", "не", "как", "был"]}
    words = {g: w + [w[j] + f"{v}x{k}" for j in range(3) for k in range(2) for v in "abcdefghij"[: 1 + k]] for g, w in words.items()}
    clean = lambda g: " ".join(pick.choice(words[g]) for _ in range(150)) + "."
    rows = [(k, " ".join(clean("en") for _ in range(50)), "en") for k in range(80)] + [(2000 + k, clean("fi"), "fi") for k in range(n)] + [(3000 + k, clean("ru"), "ru") for k in range(n)]
    rows += [(4000, " | ".join(f"ZZ{j}Q" for j in range(150)), "fi"), (4001, " | ".join(f"#{j}$" for j in range(150)), "zz"), (4002, clean("en"), "fi"), (4003, clean("fi"), "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert list(quality_divergence.language_references(docs)[0]) == ["en"]
    kept = {r.doc_id for r in quality_divergence.judged(docs).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - {4000, 4001}
