import json

import pytest
from pyspark.sql import functions as F

from cutover.operators import assess as A
from cutover.operators import corpus as C
from cutover.sources import io

c = F.col

MAPPER = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE mapper PUBLIC "-//x//DTD Mapper 3.0//EN" "http://example.com/x.dtd">
<mapper namespace="app.Users">
  <!-- comment -->
  <cache/>
  <resultMap id="rm" type="camelMap"/>
  <select id="find" resultType="CamelMap" parameterType="HashMap">
    select * from users where id = #{id, jdbcType=INTEGER} and x = #{ y }
    <if test="name != null">and name = #{name.first} and id = #{id}</if>
    <choose><when test="a">a = #{a}</when><otherwise>1 = 1</otherwise></choose>
    <foreach collection="list" item="i">#{i}</foreach>
  </select>
  <update id="fix" parameterType="com.app.User">call me</update>
</mapper>"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a/Users.xml", MAPPER), ("Bad.xml", "<mapper><select>"), ("Other.xml", "<beans/>")], "file string, content string")


def test_parse(spark, files):
    parsed = C.parse_files(files).persist()
    assert tuple(C.parse_health(parsed).first()) == (3, 2, 1)
    assert [r.file for r in C.parse_errors(parsed).collect()] == ["Bad.xml"]
    frags = C.fragments_of(parsed).orderBy("pos").collect()
    assert [(r.mapper, r.namespace, r.sql_id, r.statement_type, r.has_id) for r in frags] == [
        ("Users", "app.Users", "__el_cache_1", "cache", False), ("Users", "app.Users", "rm", "resultMap", True),
        ("Users", "app.Users", "find", "select", True), ("Users", "app.Users", "fix", "update", True)]
    assert {r.alias: r.n for r in C.unknown_aliases(parsed).collect()} == {"CamelMap": 1}
    assert tuple(C.catalogue_totals(parsed).first()) == (1, 4)
    assert C.catalogue_counts(C.fragments_of(parsed)).first().fragments == 4
    parsed.unpersist()


def test_a_task_holds_few_parsed_files(spark):
    """Files of a batch are passed on some at a time, none is lost, and a file longer than a turn goes alone."""
    note = "x" * (C.TURN_CHARS // 8)
    made = [(f"d/M{i}.xml", f"<mapper><select id='q{i}'>{note * (12 if i == 20 else 1)}<if test='a'>#{{p{i}}}</if></select></mapper>") for i in range(40)]
    made += [("d/bad.xml", "<mapper>"), ("d/empty.xml", "")]
    files = spark.createDataFrame(made, "file string, content string").coalesce(1)
    parsed = C.parse_files(files)

    turns = [list(C._turns(b)) for b in files.toArrow().combine_chunks().to_batches()]
    held = [some for of_batch in turns for some in of_batch]
    assert [f for some in held for f in some] == made
    assert all(len(some) == 1 or sum(len(t) for _, t in some) <= C.TURN_CHARS for some in held) and len(held) >= 5
    got = {r.file: r for r in parsed.collect()}
    assert len(got) == 42 and sum(r.ok for r in got.values()) == 40 and got["d/bad.xml"].fragments == []
    assert all(got[f"d/M{i}.xml"].fragments[0].elements[0].test == "a" and got[f"d/M{i}.xml"].fragments[0].sql_id == f"q{i}" for i in range(40))


def test_tokens(spark):
    df = spark.createDataFrame([("f", "@a.B@isEmpty(x) @a.B@isEmpty(y) @nodot@m @a.C@ ${t.col,x} ${ t } ${@a.B@x} ${open exec Proc"), ("g", "nothing")], "file string, content string")
    assert {r.token: r.n for r in C.static_calls(df.withColumn("content", F.replace("content", F.lit("${@a.B@x}"), F.lit("")))).collect()} == {"@a.B@isEmpty": 2}
    assert {r.variable: r.n for r in C.dollar_variables(df).collect()} == {"t": 2}
    assert [r.file for r in C.procedure_files(df).collect()] == ["f"]


def test_parameters_and_scenarios(spark, files):
    frags = C.fragment_parameters(C.fragments_of(C.parse_files(files))).filter("sql_id = 'find'")
    r = frags.first()
    assert r.params == ["id", "y", "name", "a", "i"] and r.static_params == ["y"] and r.if_params == ["name", "id"] and r.collections == ["list"]
    cases = C.scenarios(frags)
    got = [(x.test_case_id[-5:], x.expected_branches, x.active_params, x.size) for x in cases.orderBy("test_case_id").collect()]
    assert got == [
        ("tc001", [], [], None), ("tc002", ["if:name"], ["name"], None), ("tc003", ["if:id"], ["id"], None), ("tc004", ["if:name", "if:id"], ["name", "id"], None),
        ("tc005", ["when:a"], [], None), ("tc006", ["choose[0]:otherwise"], [], None),
        ("tc007", ["foreach:list:0"], [], 0), ("tc008", ["foreach:list:1"], [], 1), ("tc009", ["foreach:list:3"], [], 3)]
    plain = C.scenarios(C.fragment_parameters(C.fragments_of(C.parse_files(files))).filter("sql_id = 'fix'")).collect()
    assert [x.test_case_id for x in plain] == ["Users_fix_tc001"]
    binds = spark.createDataFrame([("Users", "find", "y", "U.Y"), ("Users", "find", "name", "u.name"), ("Users", "find", "id", "u.id"), ("Users", "find", "list", "u.d")], "mapper string, sql_id string, param string, ref string")
    d = spark.createDataFrame([("u.y", "character varying", "abcdef", 3), ("u.name", "character", None, 2), ("u.id", "bigint", None, None), ("u.d", "date", None, None)],
                              "key string, data_type string, sample_value string, char_max_length long")
    values = {(x.test_case_id[-5:], x.param): (x.value, x.repeats) for x in C.parameter_values(cases, binds, d).collect()}
    assert values[("tc001", "y")] == ("abc", None) and values[("tc004", "name")] == ("SA", None) and values[("tc004", "id")] == ("1", None)
    assert values[("tc009", "list")] == ("2026-01-01 00:00:00", 3) and values[("tc007", "list")][1] == 0
    assert C.parameter_values(C.scenarios(frags), binds.limit(0), d).filter("param = 'y'").first().value == "SAMPLE"


@pytest.mark.parametrize("text,score,level", [
    ("select 1", 0, "simple"), ("a JOIN b join c <if x> <IF>", 4, "simple"), ("<choose>" * 3 + "<foreach>", 11, "moderate"),
    ("<choose>" * 10, 30, "complex"), ("<choose>" * 40, 120, "very_complex"),
])
def test_complexity(spark, text, score, level):
    r = C.complexity(spark.createDataFrame([(text,)], "t string"), "t", 60).first()
    assert (r.complexity, r.complexity_level, r.char_count, r.token_estimate) == (score, level, len(text), len(text) // 3)
    large = len(text) > 60
    assert r.strategy == ({"simple": "standard_with_compression", "moderate": "standard_with_compression", "complex": "chunked", "very_complex": "manual_review"}[level] if large else "standard")


def test_substitution(spark):
    text = "#{UserId} ${userid, x} #{userid.a} #{ userid} #{other ${userid} ${lang}"
    got = C.substitute_tokens(spark.createDataFrame([("f", text), ("g", "none")], "file string, content string"), {"userid": "1 < 2 & $3", "lang": "'KO'"})
    r = {x.file: x for x in got.collect()}
    # text inside another token stays, and so does a name with a property or behind a blank
    assert r["f"].content == "1 &lt; 2 &amp; $3 1 &lt; 2 &amp; $3 #{userid.a} #{ userid} #{other ${userid} 'KO'" and r["f"].variable_subs == 3
    assert tuple(C.substitution_totals(got).first()) == (2, 1, 3)


@pytest.mark.parametrize("sql,kind", [
    ("/* a */ -- b\n  insert into t", "dml"), ("{call p()}", "procedure"), ("begin x end", "procedure"), ("begin x", "query"), ("with a as (select 1) update t", "dml"),
    ("with a as (select 1) select 1", "query"), ("/* open insert", "query"), ("-- insert", "query"), (None, "query"), ("callme", "query"), ("  /* x **/ MERGE into", "dml"), ("execute p", "procedure"),
])
def test_statement_kind(spark, sql, kind):
    assert spark.createDataFrame([(sql,)], "s string").select(C.statement_kind(c("s")).alias("k")).first().k == kind


def test_statement_kind_of_a_long_comment(spark):
    assert spark.createDataFrame([("/*" + "x" * 200_000 + "*/ delete from t",)], "s string").select(C.statement_kind(c("s")).alias("k")).first().k == "dml"


def test_merge_audit(spark):
    o = spark.createDataFrame([("M", "select", "a", True), ("M", "select", "b", True), ("M", "cache", "__el_cache_0", False)], "mapper string, statement_type string, sql_id string, has_id boolean")
    f = spark.createDataFrame([("M", "select", "a"), ("M", "insert", "a"), ("M", "cache", "__el_cache_0")], "mapper string, statement_type string, sql_id string")
    assert {(r.statement_type, r.sql_id, r.fate) for r in C.merge_audit(o, f).collect()} == {("select", "a", "replaced"), ("select", "b", "not_replaced"), ("insert", "a", "unused")}


def test_trees(spark):
    leaf = {"name": "A.B.f", "statistic": {"objectType": "FUNCTION", "countErrorNodes": "", "messageActions": [{"code": 7}, {"code": "8"}, {"code": ""}]}}
    table = {"name": "T", "statistic": {"objectType": "TABLE", "countErrorNodes": 9}, "children": None}
    doc = {"name": "root", "children": [{"name": "A", "statistic": {"objectType": "PACKAGE", "countErrorNodes": 2}, "children": [leaf, table]}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "not json"), (3, '{"name": "alone"}')], "id long, doc string")
    nodes = A.flatten_trees(df, "id", "doc")
    assert {(r.id, r.path, r.depth, r.name) for r in nodes.collect()} == {(1, "0", 1, "root"), (1, "0/0", 2, "A"), (1, "0/0/0", 3, "A.B.f"), (1, "0/0/1", 3, "T"), (3, "0", 1, "alone")}
    sev = A.severity_dimension(spark.createDataFrame([('{"7": {"severityType": "CRITICAL"}, "8": {}, "x": "text"}',)], "doc string"), "doc")
    assert {(r.code, r.severity) for r in sev.collect()} == {("7", "CRITICAL"), ("8", "")}
    expected = {("PACKAGE", "A", ("countErrorNodes=2",)), ("FUNCTION", "f", ("critical_codes=7",))}
    assert {(r.object_type, r.object_name, tuple(r.reasons)) for r in A.select_targets(nodes, sev, "id").collect()} == expected
    assert A.select_targets(nodes, sev, "id", code_types_only=False).count() == 3


def test_tree_of_any_depth(spark):
    doc = {"name": "bottom", "statistic": {"objectType": "VIEW", "countErrorNodes": 1}}
    for k in range(99):
        doc = {"name": f"n{k}", "children": [doc]}
    nodes = A.flatten_trees(spark.createDataFrame([(1, json.dumps(doc))], "id long, doc string"), "id", "doc")
    assert nodes.agg({"depth": "max"}).first()[0] == 100 and nodes.filter("name = 'bottom'").count() == 1


def test_deep_trees_in_few_passes(spark, monkeypatch):
    written = []
    monkeypatch.setattr(A, "stage", lambda df, label, whole=A.stage: written.append(label) or whole(df, label))
    chain = {"name": "end", "statistic": {"objectType": "VIEW"}}
    for k in range(199, 0, -1):
        chain = {"name": f"d{k}", "children": [{"name": f"side{k}"}, chain, None, "text", 7]}
    nodes = A.flatten_trees(spark.createDataFrame([(1, json.dumps(chain)), (2, json.dumps({"name": "flat", "children": []}))], "id long, doc string"), "id", "doc")
    rows = nodes.collect()
    assert len(rows) == 400 and max(r.depth for r in rows) == 200 and len(written) == 9
    end = next(r for r in rows if r.name == "end")
    assert end.path == "0" + "/1" * 199 and end.object_type == "VIEW" and len({(r.id, r.path) for r in rows}) == 400


def test_wide_and_broken_trees(spark):
    wide = {"name": "top", "statistic": {"countErrorNodes": 0}, "children": [{"name": f"n{k}", "children": [{"statistic": {"countErrorNodes": str(k)}}]} for k in range(3000)]}
    docs = [(1, json.dumps(wide)), (2, None), (3, ""), (4, "[1, 2]"), (5, '{"children": "none"}'), (6, '{"children": [{"children": [{"name": "deep"}]}]}'), (7, '{"name": "a", "name": "b"}')]
    rows = A.flatten_trees(spark.createDataFrame(docs, "id long, doc string"), "id", "doc").collect()
    one = [r for r in rows if r.id == 1]
    assert len(one) == 6001 and sum(r.error_nodes for r in one) == sum(range(3000)) and next(r for r in one if r.depth == 1).children == 3000
    assert {(r.id, r.path, r.depth, r.name) for r in rows if r.id != 1} == {(6, "0/0/0", 3, "deep")}


def test_corpus_reader(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("a/M1.xml", MAPPER)
    put("a/._M1.xml", MAPPER)
    put("target/M2.xml", MAPPER)
    put("b/late.xml", " " * 3000 + "<mapper>")
    put("b/M3.txt", MAPPER)
    put("target.xml", MAPPER)
    got = io.read_corpus(spark, str(tmp_path), exclude_dirs=["target"]).collect()
    assert sorted(r.file for r in got) == ["a/M1.xml", "target.xml"] and {r.content for r in got} == {MAPPER}


def test_json_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{\n "id": 1,\n "p": {"x": "y"}}')
    (tmp_path / "in" / "b.json").write_text('{"id": ')
    schema = "id long, p map<string,string>"
    assert [(r.id, r.p) for r in io.read_json_documents(spark, str(tmp_path / "in"), schema).collect()] == [(1, {"x": "y"})]
    assert io.count_corrupt(spark, str(tmp_path / "in"), "id long") == 1
    df = spark.createDataFrame([("a", 'say "x", y')], "k string, note string")
    io.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).collect() == df.collect()
    io.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).collect() == df.collect()
    files = io.inventory(spark, str(tmp_path), "*.json")
    assert files.count() >= 3 and io.inventory_summary(files, F.lit("json")).first().bytes > 0


def test_jdbc_options():
    base = io.jdbc_options("oracle", "h", 1521, "svc", "u", "p")
    assert base["url"] == "jdbc:oracle:thin:@//h:1521/svc" and io.jdbc_options("postgres", "h", 5432, "d", "u", "p")["url"] == "jdbc:postgresql://h:5432/d"
    split = io.jdbc_read_options(base, table="t", column="id", bounds=(1, 100), partitions=8)
    assert (split["dbtable"], split["partitionColumn"], split["numPartitions"], split["fetchsize"]) == ("t", "id", "8", "1000")
    assert io.jdbc_read_options(base, query="select 1", column="id", bounds=(1, 2))["dbtable"] == "(select 1) q"
    assert io.jdbc_read_options(base, query="select 1")["query"] == "select 1"
    for wrong in ({}, {"table": "t", "query": "q"}, {"table": "t", "column": "id"}, {"table": "t", "column": "id", "bounds": (2, 1)}):
        with pytest.raises(ValueError):
            io.jdbc_read_options(base, **wrong)
    with pytest.raises(ValueError):
        io.jdbc_options("other", "h", 1, "d", "u", "p")


def test_substitution_keeps_the_texts_own_marks(spark):
    df = spark.createDataFrame([("f", "a\x01b \x01#{x} \x01\x02 #{x} ${y}")], "file string, content string")
    r = C.substitute_tokens(df, {"x": "1"}).first()
    assert r.content == "a\x01b \x011 \x01\x02 1 ${y}" and r.variable_subs == 2
