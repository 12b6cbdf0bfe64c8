"""Registered queries: assessment trees, corpus analytics, readers and writers."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cutover.operators import assess as A
from cutover.operators import compare as R
from cutover.operators import corpus as C
from cutover.operators import summary as S
from cutover.plans import q_load_dictionary as QD
from cutover.plans.q_reconcile import OUTCOMES_SQL
from cutover.plans.registry import query
from cutover.session import owned_folder
from cutover.sources import io, replace

c = F.col

# ---- assessment trees ---------------------------------------------------------
_NODES = """SELECT event_id, '0' AS path, 1 AS depth, 'APP' AS name, null AS object_type, 0 AS error_nodes, null AS c1, null AS c2 FROM trees
UNION ALL SELECT event_id, '0/0', 2, concat('APP.PKG', user_id), ty, case when k % 7 = 0 then 0 else k % 3 end, cast(k % 50 + 1 as varchar), cast(k % 13 + 1 as varchar) FROM trees
UNION ALL SELECT event_id, '0/0/0', 3, concat('APP.PKG', user_id, '.P', event_id), 'FUNCTION', event_id % 4, null, null FROM trees"""
_CRIT = "SELECT code FROM action_items WHERE severity = 'CRITICAL'"
query("t01_flatten_trees", "event_id:i path:s depth:i name:s object_type:s error_nodes:i codes:s", f"SELECT *, concat_ws(',', c1, nullif(c2, c1)) AS codes FROM ({_NODES})")(
    lambda t: A.flatten_trees(t.trees, "event_id", "tree").withColumn("codes", F.coalesce(F.array_join("codes", ","), F.lit(""))))
query("t02_severities", "code:s severity:s", "SELECT code, severity FROM action_items")(lambda t: A.severity_dimension(t.action_items, "doc"))
query("t03_targets", "event_id:i path:s object_type:s object_name:s reasons:s error_nodes:i critical_codes:s", f"""
SELECT event_id, path, object_type, split_part(name, '.', -1) AS object_name, concat_ws('; ', case when error_nodes > 0 then 'countErrorNodes=' || error_nodes end, case when crit <> '' then 'critical_codes=' || crit end) AS reasons, error_nodes, crit AS critical_codes
FROM (SELECT *, array_to_string(list_sort(list_distinct(list_filter([case when c1 IN ({_CRIT}) then c1 end, case when c2 IN ({_CRIT}) then c2 end], lambda x: x IS NOT NULL))), ',') AS crit FROM ({_NODES}))
WHERE object_type IN ('PACKAGE', 'TRIGGER', 'VIEW', 'FUNCTION') AND (error_nodes > 0 OR crit <> '')
""")(
    lambda t: A.select_targets(A.flatten_trees(t.trees, "event_id", "tree"), A.severity_dimension(t.action_items, "doc"), "event_id").withColumns({
        "reasons": F.array_join("reasons", "; "), "critical_codes": F.array_join("critical_codes", ",")}))

# ---- corpus -------------------------------------------------------------------
query("c01_static_calls", "token:s n:i", r"""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '@([^@]*)@([\p{L}\p{N}_]*)', 0)) AS token FROM corpus) WHERE NOT ends_with(token, '@') AND contains(split_part(token, '@', 2), '.') GROUP BY 1
""")(lambda t: C.static_calls(t.corpus))
query("c02_dollar_variables", "variable:s n:i", r"""
SELECT variable, count(*) AS n FROM (SELECT trim(split_part(split_part(trim(unnest(regexp_extract_all(content, '\$\{([^}]*)\}', 1))), '.', 1), ',', 1)) AS variable FROM corpus) WHERE variable <> '' AND NOT starts_with(variable, '@') GROUP BY 1
""")(lambda t: C.dollar_variables(t.corpus))

# a control character or an open tag makes a file unreadable
_OK = r"(doc_id % 10 <> 3 AND NOT regexp_matches(content, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))"
_parsed = lambda t: C.parse_files(t.corpus)
_health = lambda t: C.parse_files(t.corpus, with_fragments=False)
query("c03_unknown_aliases", "alias:s n:i", f"SELECT lang || 'Map' AS alias, count(*) AS n FROM corpus JOIN documents USING (doc_id) WHERE {_OK} GROUP BY 1")(lambda t: C.unknown_aliases(_health(t)))
query("c04_procedure_files", "file:s", "SELECT DISTINCT file FROM corpus WHERE contains(upper(content), 'CALL ') OR contains(upper(content), 'EXEC ') OR contains(upper(content), 'EXECUTE ')")(lambda t: C.procedure_files(t.corpus))
query("c05_parse_health", "mapper_count:i parsed_ok:i parse_errors:i", f"SELECT count(*) AS mapper_count, count(*) FILTER ({_OK}) AS parsed_ok, count(*) FILTER (NOT {_OK}) AS parse_errors FROM corpus")(lambda t: C.parse_health(_health(t)))
query("c05_parse_errors", "file:s", f"SELECT file FROM corpus WHERE NOT {_OK}")(lambda t: C.parse_errors(_health(t)))
_FRAGS = f"""SELECT doc_id, 'M' || doc_id AS mapper, 'app.' || source AS namespace, file AS source_file, unnest(case when doc_id % 4 = 0 then [1, 2, 3] else [1, 2] end) AS pos,
  unnest(['rm', 'q' || doc_id, '__el_update_3']) AS sql_id, unnest(['resultMap', 'select', 'update']) AS statement_type FROM corpus JOIN documents USING (doc_id) WHERE {_OK}"""
_FRAGS = f"SELECT * FROM ({_FRAGS}) WHERE pos IS NOT NULL"
query("c06_fragments", "mapper:s namespace:s source_file:s pos:i sql_id:s statement_type:s has_id:b", f"SELECT *, statement_type <> 'update' AS has_id FROM ({_FRAGS})")(lambda t: C.fragments_of(_parsed(t)))
query("c07_catalogue_counts", "source_file:s mapper:s namespace:s fragments:i", f"SELECT source_file, mapper, namespace, count(*) AS fragments FROM ({_FRAGS}) GROUP BY 1, 2, 3")(lambda t: C.catalogue_counts(C.fragments_of(_parsed(t))))
query("c07_catalogue_totals", "mappers:i fragments:i", f"SELECT count(DISTINCT mapper) AS mappers, count(*) AS fragments FROM ({_FRAGS})")(lambda t: C.catalogue_totals(_parsed(t)))


def _count(text, part):
    return f"((length({text}) - length(replace({text}, '{part}', ''))) // {len(part)})"


def _complexity(src, large):
    return f"""SELECT *, case when not is_large then 'standard' when complexity < 30 then 'standard_with_compression' when complexity < 100 then 'chunked' else 'manual_review' end AS strategy
FROM (SELECT *, case when complexity < 10 then 'simple' when complexity < 30 then 'moderate' when complexity < 100 then 'complex' else 'very_complex' end AS complexity_level, char_count // 3 AS token_estimate, char_count > {large} AS is_large
  FROM (SELECT *, join_count + 2 * if_count + 3 * choose_count + 2 * foreach_count AS complexity
    FROM (SELECT id, length(x) AS char_count, {_count('upper(x)', 'JOIN')} AS join_count, {_count('x', '<if')} AS if_count, {_count('x', '<choose')} AS choose_count, {_count('x', '<foreach')} AS foreach_count FROM ({src}))))"""


_CX = "id:i char_count:i token_estimate:i is_large:b join_count:i if_count:i choose_count:i foreach_count:i complexity:i"
query("c08_complexity_corpus", _CX, _complexity("SELECT doc_id AS id, content AS x FROM corpus", 50000))(lambda t: C.complexity(t.corpus.withColumnRenamed("doc_id", "id"), "content"))
query("c08_complexity_pages", _CX, _complexity("SELECT page_id AS id, html AS x FROM pages", 4000))(lambda t: C.complexity(t.pages.withColumnRenamed("page_id", "id"), "html", 4000))
query("c09_levels_and_strategies", "complexity_level:s strategy:s n:i", f"SELECT complexity_level, strategy, count(*) AS n FROM ({_complexity('SELECT doc_id AS id, content AS x FROM corpus', 1500)}) GROUP BY 1, 2")(
    lambda t: C.complexity(t.corpus, "content", 1500).groupBy("complexity_level", "strategy").agg(F.count(F.lit(1)).alias("n")))
query("c10_bind_names", "doc_id:i params:s", r"""
SELECT doc_id, coalesce(string_agg(p, ',' ORDER BY first), '') AS params FROM (SELECT doc_id, p, min(i) AS first FROM (
  SELECT doc_id, regexp_extract(trim(unnest(x)), '^[^., ]*') AS p, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(content, '#\{([^}]*)\}', 1) AS x FROM corpus)) WHERE p <> '' GROUP BY 1, 2) GROUP BY 1
""")(lambda t: t.corpus.select("doc_id", F.array_join(C.bind_names(c("content")), ",").alias("params")))

_selects = lambda t: C.fragment_parameters(C.fragments_of(_parsed(t))).filter(c("statement_type") == "select")
# documents whose own text holds a bind would need the parser; there are none
_SEL = f"SELECT doc_id, 'M' || doc_id AS mapper, 'q' || doc_id AS sql_id, doc_id % 2 = 0 AS ifs, doc_id % 3 = 0 AS ch, doc_id % 5 = 0 AS fe FROM corpus WHERE {_OK}"
query("c11_static_params", "sql_id:s static_params:s if_params:s", f"""
SELECT sql_id, case when ch then 'sysdate' else 'userId,sysdate' end AS static_params, case when ifs then 'range,total,d' else '' end AS if_params FROM ({_SEL})
""")(lambda t: _selects(t).withColumns({"static_params": F.array_join("static_params", ","), "if_params": F.array_join("if_params", ",")}))
_SCEN = f"""SELECT mapper, sql_id, ch, s.d AS description, s.b AS branches, s.a AS active, s.c AS collection, s.n AS size, mapper || '_' || sql_id || '_tc' || lpad(i::varchar, 3, '0') AS test_case_id FROM (
  SELECT *, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, case when len(l0) = 0 then [{{'d': '정적 SQL (분기 없음)', 'b': '', 'a': '', 'c': null::varchar, 'n': null::int}}] else l0 end AS l FROM (SELECT *,
    list_concat(list_concat(case when ifs then [{{'d': '모든 if 조건 비활성 (최소)', 'b': '', 'a': '', 'c': null::varchar, 'n': null::int}}, {{'d': 'range만 활성', 'b': 'if:range', 'a': 'range', 'c': null, 'n': null}}, {{'d': 'total만 활성', 'b': 'if:total', 'a': 'total', 'c': null, 'n': null}},
        {{'d': 'd만 활성', 'b': 'if:d', 'a': 'd', 'c': null, 'n': null}}, {{'d': '모든 if 조건 활성 (최대)', 'b': 'if:range,if:total,if:d', 'a': 'range,total,d', 'c': null, 'n': null}}] else [] end,
      case when ch then [{{'d': 'choose[0] when: t == 1', 'b': 'when:t == 1', 'a': '', 'c': null::varchar, 'n': null::int}}, {{'d': 'choose[0] when: t == 2', 'b': 'when:t == 2', 'a': '', 'c': null, 'n': null}}, {{'d': 'choose[0] otherwise', 'b': 'choose[0]:otherwise', 'a': '', 'c': null, 'n': null}}] else [] end),
      case when fe then [{{'d': 'foreach ids: 빈 리스트', 'b': 'foreach:ids:0', 'a': '', 'c': 'ids', 'n': 0}}, {{'d': 'foreach ids: 단일 항목', 'b': 'foreach:ids:1', 'a': '', 'c': 'ids', 'n': 1}}, {{'d': 'foreach ids: 다중 항목', 'b': 'foreach:ids:3', 'a': '', 'c': 'ids', 'n': 3}}] else [] end) AS l0 FROM ({_SEL}))))"""
query("c12_scenarios", "test_case_id:s mapper:s sql_id:s description:s branches:s active:s collection:s size:i", _SCEN)(
    lambda t: C.scenarios(_selects(t)).withColumns({"branches": F.array_join("expected_branches", ","), "active": F.array_join("active_params", ",")}))


def _binds(t):
    """userId, total, ids and d of every select belong to a column; the others do not."""
    refs = F.array(*(F.struct(F.lit(p).alias("param"), F.lit(r).alias("ref")) for p, r in (
        ("userId", "Orders.O_CUSTKEY"), ("total", "orders.o_totalprice"), ("ids", "part.p_name"), ("d", "orders.nowhere"))))
    return t.documents.select(F.concat(F.lit("M"), c("doc_id")).alias("mapper"), F.concat(F.lit("q"), c("doc_id")).alias("sql_id"), F.inline(refs))


query("c13_parameter_values", "test_case_id:s param:s value:s repeats:i", f"""
SELECT test_case_id, param, case param when 'userId' then (SELECT arg_min(o_custkey, o_orderkey)::varchar FROM orders) when 'total' then (SELECT arg_min(o_totalprice, o_orderkey)::varchar FROM orders) when 'ids' then (SELECT arg_min(p_name, p_partkey) FROM part) else 'SAMPLE' end AS value,
  case when param = 'ids' then size end AS repeats
FROM (SELECT *, unnest(string_split(concat_ws(',', case when ch then null else 'userId' end, 'sysdate', nullif(active, ''), collection), ',')) AS param FROM ({_SCEN}))
""")(lambda t: C.parameter_values(C.scenarios(_selects(t)), _binds(t), QD._dictionary(t)))

RULES = {"sysdate": "CURRENT_DATE", "dir": "a < b & \\1 $0", "a.b": "x"}
query("c14_substituted", "doc_id:i variable_subs:i content:s", r"""
SELECT doc_id, 2 AS variable_subs, replace(replace(content, '#{sysdate}', 'CURRENT_DATE'), '${a.b,c}', 'x') AS content FROM corpus
""")(lambda t: C.substitute_tokens(t.corpus, RULES))
query("c14_totals", "total_files:i changed_files:i variable_subs:i", "SELECT count(*) AS total_files, count(*) AS changed_files, count(*) * 2 AS variable_subs FROM corpus")(
    lambda t: C.substitution_totals(C.substitute_tokens(t.corpus, RULES)))
query("c15_statement_kinds", "doc_id:i kind:s", r"""
SELECT doc_id, case doc_id % 12 when 0 then 'query' when 1 then 'dml' when 2 then 'dml' when 3 then 'procedure' when 4 then 'procedure' when 5 then 'dml'
  when 6 then case when regexp_matches(upper(statement), '(INSERT|UPDATE|DELETE|MERGE) ') then 'dml' else 'query' end when 7 then case when contains(statement, '*/') then 'other' else 'query' end when 8 then 'query' when 9 then 'procedure' when 10 then 'dml'
  else case when regexp_matches(upper(ltrim(statement, ' ' || chr(9) || chr(10) || chr(13))), '^(CALL |EXEC |EXECUTE |\{CALL )') then 'procedure' when regexp_matches(upper(statement), '^\s*(INSERT|UPDATE|DELETE|MERGE)') then 'dml' when regexp_matches(upper(statement), '^\s*WITH[\s\S]*(INSERT|UPDATE|DELETE|MERGE) ') then 'dml' else 'query' end end AS kind FROM statements
""")(lambda t: t.statements.select("doc_id", C.statement_kind(c("statement")).alias("kind")))


def _converted(t):
    """Converted fragments: half of the selects, and selects of documents that do not exist."""
    return t.documents.select(
        F.concat(F.lit("M"), c("doc_id")).alias("mapper"), F.lit("select").alias("statement_type"),
        F.expr("case when length(text) % 2 = 0 then concat('q', doc_id) else concat('gone', doc_id) end").alias("sql_id"))


query("c16_merge_audit", "mapper:s statement_type:s sql_id:s fate:s", f"""
SELECT coalesce(o.mapper, f.mapper) AS mapper, coalesce(o.statement_type, 'select') AS statement_type, coalesce(o.sql_id, f.sql_id) AS sql_id, case when o.mapper is null then 'unused' when f.mapper is null then 'not_replaced' else 'replaced' end AS fate
FROM (SELECT mapper, statement_type, sql_id FROM ({_FRAGS}) WHERE statement_type <> 'update') o FULL JOIN
  (SELECT 'M' || doc_id AS mapper, case when length(text) % 2 = 0 then concat('q', doc_id) else concat('gone', doc_id) end AS sql_id FROM documents) f ON o.mapper = f.mapper AND o.sql_id = f.sql_id
""")(lambda t: C.merge_audit(C.fragments_of(_parsed(t)), _converted(t)))


# ---- readers and writers ------------------------------------------------------

def _fresh(t, label):
    return owned_folder(t.spark, label)


def _documents_with_corrupt_ones(t):
    """Each event as a JSON document; one in fifty is cut short."""
    path = _fresh(t, "json-documents")
    doc = F.to_json(F.struct(c("event_id").alias("id"), c("event_type").alias("kind")))
    t.events.select(F.when(c("event_id") % 50 == 7, F.substring(doc, 1, 9)).otherwise(doc).alias("value")).write.text(path)
    return path


query("io02_json_documents", "id:i kind:s", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 50 <> 7")(
    lambda t: io.read_json_documents(t.spark, _documents_with_corrupt_ones(t), "id bigint, kind string", one_per_file=False))
def _documents_with_wrong_ids(t):
    """Each event as a JSON document; one in fifty has text where the id should be a number."""
    path = _fresh(t, "json-documents")
    id_text = F.when(c("event_id") % 50 == 7, F.lit('"none"')).otherwise(c("event_id").cast("string"))
    t.events.select(F.concat(F.lit('{"id":'), id_text, F.lit(',"kind":"'), c("event_type"), F.lit('"}')).alias("value")).write.text(path)
    return path


query("io02_other_columns", "kind:s n:i", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_id % 50 <> 7 GROUP BY 1")(
    lambda t: io.read_json_documents(t.spark, _documents_with_wrong_ids(t), "id bigint, kind string", one_per_file=False).select("kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
def _corpus_files(t):
    """Pages as files: a folder with a blank in its name, one to exclude, and one more."""
    path = _fresh(t, "corpus files")
    n = c("page_id")
    folder = F.when(n % 5 == 0, "old").when(n % 5 == 1, "a b").otherwise("new")
    t.pages.select(folder.alias("d"), F.concat(F.lit("<mapper>"), n.cast("string")).alias("value")).write.partitionBy("d").text(path)
    return path


query("io03_corpus_reader", "folder:s n:i", """
SELECT CASE WHEN page_id % 5 = 1 THEN 'd=a b' ELSE 'd=new' END AS folder, count(*) AS n FROM pages WHERE page_id % 5 <> 0 GROUP BY 1
""")(lambda t: io.read_corpus(t.spark, _corpus_files(t), ["d=old"], ".txt").select(
    F.split("file", "/")[0].alias("folder"), F.regexp_count("content", F.lit("<mapper>")).alias("n")).groupBy("folder").agg(F.sum("n").alias("n")))
query("io03_looks_like", "page_id:i hit:b", "SELECT page_id, contains(left(html, 2048), '<footer') OR contains(left(html, 2048), '<script') AS hit FROM pages")(
    lambda t: t.pages.select("page_id", io.looks_like(c("html"), ["<footer", "<script"]).alias("hit")))


def _json_report(t):
    path = _fresh(t, "details")
    io.write_json(R.outcomes(t.runs), path)
    return t.spark.read.schema("tc_id string, status string, matched boolean, note string, source_rows long").json(path)


def _csv_report(t):
    path = _fresh(t, "failures")
    io.write_csv(S.failure_extract(R.outcomes(t.runs)), path)
    df = t.spark.read.option("header", "true").option("escape", '"').schema("tc_id string, failure_type string, severity string, source_rows long, target_rows long, row_diff long, note string").csv(path)
    return df.withColumn("note", F.coalesce("note", F.lit("")))


def _replaced(t):
    path = _fresh(t, "replaced")
    replace.replace_table(t.orders, path)
    replace.replace_table(t.orders.filter(c("o_totalprice") > 100000), path)
    return t.spark.read.parquet(path)


def _replaced_after_failure(t):
    """A replacement that fails in the middle of its write, then one that reads the table it replaces."""
    path = _fresh(t, "replaced")
    replace.replace_table(t.orders, path)
    broken = F.when(c("o_orderkey") % 1000 == 999, F.raise_error(F.lit("on purpose")).cast("double")).otherwise(c("o_totalprice"))
    try:
        replace.replace_table(t.orders.withColumn("o_totalprice", broken), path)
    except PySparkException:
        pass
    else:
        raise RuntimeError("the write was meant to fail")
    mine = t.spark.read.parquet(path)
    replace.replace_table(mine.withColumn("o_totalprice", c("o_totalprice") * 2).filter(c("o_orderstatus") != "P"), path)
    return t.spark.read.parquet(path)


def _replaced_partitions(t):
    """Orders by status: open ones are replaced by their expensive half, the others stay."""
    path = _fresh(t, "replaced")
    replace.replace_partitions(t.orders, path, ["o_orderstatus"])
    replace.replace_partitions(t.spark.read.parquet(path).filter("o_orderstatus = 'O' AND o_totalprice > 100000"), path)
    return t.spark.read.parquet(path)


query("io04_json_report", "tc_id:s status:s matched:b note:s source_rows:i", OUTCOMES_SQL)(_json_report)
query("io05_csv_report", "tc_id:s failure_type:s severity:s row_diff:i note:s", f"""
SELECT tc_id, failure_type, severity, target_rows - source_rows AS row_diff, replace(coalesce(note, ''), chr(10), ' ') AS note FROM ({OUTCOMES_SQL}) WHERE status = 'failed'
""")(_csv_report)
query("io06_inventory", "kind:s files:i bytes:i", """
SELECT regexp_extract(url, '^([a-z]+)://', 1) AS kind, count(*) AS files, sum(length(html)) AS bytes FROM pages GROUP BY 1
""")(lambda t: io.inventory_summary(t.pages.select(c("url").alias("path"), F.length("html").alias("length")), F.regexp_extract("path", "^([a-z]+)://", 1)))
query("io07_replace_table", "o_orderkey:i o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")(_replaced)
query("io07_replace_after_failure", "o_orderkey:i o_orderstatus:s o_totalprice:d", "SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'")(_replaced_after_failure)
query("io07_replace_partitions", "o_orderkey:i o_orderstatus:s o_totalprice:d", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O' OR o_totalprice > 100000")(_replaced_partitions)
