"""The registered queries of this package, each on its whole table, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutover.llm import (
    best_position,
    decontaminate,
    language_cnn,
    line_runs,
    near_forest,
    pack_windows,
    pii_feistel,
    preference_chat,
    quality_divergence,
    secret_ledger,
    token_prefix,
    whitening,
    wrapper_induction,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The registered query's own key; production takes it from a secret store.
DEMO_KEY = b"a key of the registered query"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").select(*columns)


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = secret_ledger.join_back(docs, secret_ledger.scan(docs))
    base = secret_ledger.of_kind(F.col("found"), *secret_ledger.BASE_KINDS)
    return found.select(
        "doc_id",
        *(F.size(secret_ledger.of_kind(F.col("found"), k)).cast("long").alias(f"n_{k}") for k in secret_ledger.BASE_KINDS),
        F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"),
        secret_ledger.listed(F.col("found")).alias("spans"),
    )


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    network = language_cnn.trained(docs.filter(~held_out).select("text", "lang"))
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_cnn.with_language(marked, network, drop=("text",))


@query("op3_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return near_forest.near_duplicates(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pack_windows.packed(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(k) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM t),
p AS (SELECT r, k, n.n, array_to_string(w[k : k + n.n - 1], ' ') AS s FROM d, n, unnest(range(1, len(w) - n.n + 2)) AS u(k)),
h AS (SELECT r, k, p.n, item_id FROM p JOIN t USING (n, s)),
c AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM h, unnest(range(0, n)) AS u(j) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""


@query("op5_decontamination", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = decontaminate.find_occurrences(docs, table(spark, folder, "benchmark", "item_id", "text"), drop=("text",))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op6_line_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return line_runs.without_repeated_runs(docs).select(
        "doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.size("deleted_lines").cast("long").alias("n_deleted"),
        F.array_join("deleted_lines", ",").alias("deleted_lines"))


@query("op7_pii_pseudonyms")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = pii_feistel.with_pseudonyms(table(spark, folder, "documents", "doc_id", "text"), DEMO_KEY)
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return docs.select("doc_id", "text", *(of(k) for k in pii_feistel.KINDS), spans.alias("spans"))


OP8_SQL = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
s AS (SELECT pair_id, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM n GROUP BY pair_id),
x AS (SELECT c.pair_id, min(c.k) AS k FROM n AS c JOIN n AS r ON c.pair_id = r.pair_id AND c.k = r.k AND c.side = 0 AND r.side = 1
      WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id),
m AS (SELECT pair_id, least(coalesce(x.k - 1, least(a, b)), least(a, b)) AS n_common FROM s LEFT JOIN x USING (pair_id)),
w AS (SELECT n.*, m.n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line, CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS bit FROM n JOIN m USING (pair_id)),
g AS (SELECT pair_id, any_value(n_common) AS n_common,
      coalesce(string_agg(line, '' ORDER BY k) FILTER (side = 0 AND k <= n_common), '') AS prompt,
      coalesce(string_agg(line, '' ORDER BY k) FILTER (side = 0 AND k > n_common), '') AS chosen_completion,
      coalesce(string_agg(bit, '' ORDER BY k) FILTER (side = 0 AND k > n_common), '') AS chosen_mask,
      coalesce(string_agg(line, '' ORDER BY k) FILTER (side = 1 AND k > n_common), '') AS rejected_completion,
      coalesce(string_agg(bit, '' ORDER BY k) FILTER (side = 1 AND k > n_common), '') AS rejected_mask
      FROM w GROUP BY pair_id)
SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(n_common AS BIGINT) AS n_common, prompt, chosen_completion, chosen_mask, rejected_completion, rejected_mask,
       contains(chosen_mask, '1') AND contains(rejected_mask, '1') AS usable
FROM g
"""


@query("op8_preference_chat", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The table has no preference labels: conversations 2k and 2k + 1 stand for the chosen and the rejected side of pair k."""
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    pairs = preference_chat.conversations_as_pairs(turns, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0)
    return preference_chat.with_completions(pairs).select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask", "usable")


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    counted = token_prefix.with_token_counts(docs, tokenizer_path("piece_bpe_32k.model"), 4096, drop=("text",))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "cut_at")


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return quality_divergence.judged(docs, drop=("text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest_lang", "char_distance", "word_distance")


@query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    fitted = whitening.fit(rows)
    done = whitening.whitened(rows, fitted).drop("embedding")
    return whitening.by_component(done, fitted).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{TERMS}') AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{TERMS}')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, s GROUP BY term),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM p JOIN t USING (term) JOIN q USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return best_position.ranked(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


@query("op12_html_extraction")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    wrappers = wrapper_induction.induced(pages)
    return wrapper_induction.with_main_text(pages, wrappers, drop=("html",)).select("page_id", "url", "text", "n_chars")
