"""Mining a corpus of mapper files: tokens, health, fragments, complexity, test cases."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutover.functions.once import once

c = F.col

# Type aliases every mapper framework installation knows.
BUILTIN_ALIASES = [
    "string", "byte", "long", "short", "int", "integer", "double", "float", "boolean", "date", "decimal", "bigdecimal", "biginteger",
    "object", "map", "hashmap", "list", "arraylist", "collection", "iterator", "_int", "_integer", "_long", "_short", "_byte", "_double",
    "_float", "_boolean", "resultset",
]
PROCEDURE_PREFIXES = ["CALL ", "EXEC ", "EXECUTE ", "{CALL "]
DML_WORDS = ["INSERT", "UPDATE", "DELETE", "MERGE"]
CHARS_PER_TOKEN = 3
LARGE_CHARS = 50_000
LEVELS = [(10, "simple"), (30, "moderate"), (100, "complex")]
TOP_LEVEL = "very_complex"
STRATEGIES = {"simple": "standard_with_compression", "moderate": "standard_with_compression", "complex": "chunked", "very_complex": "manual_review"}
SMALL_STRATEGY = "standard"
FOREACH_SIZES = [(0, "빈 리스트"), (1, "단일 항목"), (3, "다중 항목")]
NONE_ACTIVE, ALL_ACTIVE, ONE_ACTIVE, STATIC_SQL = "모든 if 조건 비활성 (최소)", "모든 if 조건 활성 (최대)", "만 활성", "정적 SQL (분기 없음)"
NUMERIC_KINDS = ["int", "numeric", "decimal", "real", "double", "serial"]
DATETIME_KINDS = ["timestamp", "date", "time"]
NUMERIC_SAMPLE, DATETIME_SAMPLE, TEXT_SAMPLE = "1", "2026-01-01 00:00:00", "SAMPLE"
BLANKS = " \t\n\r\f\x0b"
# Marks where a token starts; the text's own marks are told from it by the sign behind them.
MARK, OWN = "\x01", "\x01\x02"

#: Characters of files whose parsed form a task holds at once; a longer file is held by itself.
TURN_CHARS = 1 << 20

PARSED = ("file string, ok boolean, error string, root string, namespace string, type_names array<string>, "
          "fragments array<struct<pos:int,sql_id:string,statement_type:string,has_id:boolean,content:string,"
          "elements:array<struct<kind:string,test:string,collection:string,when_tests:array<string>,has_otherwise:boolean,text:string>>>>")
_TEXTS = pa.list_(pa.string())
_ELEMENT = pa.struct([("kind", pa.string()), ("test", pa.string()), ("collection", pa.string()), ("when_tests", _TEXTS), ("has_otherwise", pa.bool_()), ("text", pa.string())])
_FRAGMENT = pa.struct([("pos", pa.int32()), ("sql_id", pa.string()), ("statement_type", pa.string()), ("has_id", pa.bool_()), ("content", pa.string()), ("elements", pa.list_(_ELEMENT))])
_PARSED_TYPES = {"file": pa.string(), "ok": pa.bool_(), "error": pa.string(), "root": pa.string(), "namespace": pa.string(), "type_names": _TEXTS, "fragments": pa.list_(_FRAGMENT)}


# ---- tokens -------------------------------------------------------------------

def _counted(tokens: DataFrame, name: str) -> DataFrame:
    return tokens.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), name)


def static_calls(files: DataFrame) -> DataFrame:
    """``@package.Class@method`` tokens and how often each occurs."""
    found = F.regexp_extract_all("content", F.lit(r"@([^@]*)@([\p{L}\p{N}_]*)"), F.lit(0))
    cls = F.regexp_extract("token", r"@([^@]*)@", 1)
    return _counted(files.select(F.explode(found).alias("token")).filter(~c("token").endswith("@") & cls.contains(".")), "token")


def dollar_variables(files: DataFrame) -> DataFrame:
    """Root names of ``${...}`` variables and how often each occurs."""
    inner = F.regexp_extract_all("content", F.lit(r"\$\{([^}]*)\}"), F.lit(1))
    root = F.btrim(F.split(F.split(F.btrim(c("inner"), F.lit(BLANKS)), r"\.", 2)[0], ",", 2)[0], F.lit(BLANKS))
    roots = files.select(F.explode(inner).alias("inner")).select(root.alias("variable"))
    return _counted(roots.filter((c("variable") != "") & ~c("variable").startswith("@")), "variable")


def unknown_aliases(parsed: DataFrame) -> DataFrame:
    """Type names that are neither a full class name nor built in."""
    names = parsed.filter("ok").select(F.explode("type_names").alias("alias"))
    return _counted(names.filter((c("alias") != "") & ~c("alias").contains(".") & ~F.lower("alias").isin(BUILTIN_ALIASES)), "alias")


def procedure_files(files: DataFrame) -> DataFrame:
    """Files that call procedures."""
    upper, hit = F.upper("content"), F.lit(False)
    for prefix in PROCEDURE_PREFIXES:
        hit = hit | upper.contains(prefix)
    return files.filter(hit).select("file").distinct()


# ---- files and fragments ------------------------------------------------------

def _elements(node) -> list[dict]:
    out = []
    for el in node.iter():
        if el.tag in ("if", "foreach", "choose"):
            tail, el.tail = el.tail, None
            text = ElementTree.tostring(el, encoding="unicode")
            el.tail = tail
            out.append({
                "kind": el.tag, "test": el.get("test") if el.tag == "if" else None,
                "collection": el.get("collection") if el.tag == "foreach" else None,
                "when_tests": [w.get("test") for w in el.findall("when") if w.get("test")] if el.tag == "choose" else [],
                "has_otherwise": el.tag == "choose" and el.find("otherwise") is not None, "text": text})
    return out


def _parse(name: str, text: str, with_fragments: bool) -> tuple:
    builder = ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)
    try:
        root = ElementTree.fromstring(text, ElementTree.XMLParser(target=builder))
    except ElementTree.ParseError as e:
        return name, False, str(e).splitlines()[0], None, None, [], []
    types = [v for el in root.iter() if isinstance(el.tag, str) for a in ("resultType", "parameterType") if (v := el.get(a))]
    fragments = []
    if with_fragments and root.tag == "mapper":
        for pos, el in enumerate(root):
            if isinstance(el.tag, str):
                sql_id = el.get("id")
                fragments.append({
                    "pos": pos, "sql_id": sql_id if sql_id is not None else f"__el_{el.tag}_{pos}", "statement_type": el.tag,
                    "has_id": sql_id is not None, "content": ElementTree.tostring(el, encoding="unicode"), "elements": _elements(el)})
    return name, True, None, root.tag, root.get("namespace"), types, fragments


def _turns(batch: pa.RecordBatch) -> Iterator[list[tuple[str, str]]]:
    """The files of a batch, about TURN_CHARS characters at a time."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    at = 0
    while at < len(sizes):
        stop, chars = at, 0
        while stop < len(sizes) and (stop == at or chars + sizes[stop] <= TURN_CHARS):
            chars += sizes[stop]
            stop += 1
        some = batch.slice(at, stop - at)
        yield list(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True))
        at = stop


def parse_files(files: DataFrame, with_fragments: bool = True) -> DataFrame:
    """Parse every file once: health, type names and, unless told otherwise, top-level statements.

    A statement stands several times in its parsed form, so a task passes that
    on every TURN_CHARS characters, however many files a batch has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _turns(batch):
                made = zip(*(_parse(n, t, with_fragments) for n, t in some), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, _PARSED_TYPES.values(), strict=True)], names=list(_PARSED_TYPES))

    return files.select("file", "content").mapInArrow(run, PARSED)


def parse_health(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count(F.lit(1)).alias("mapper_count"), F.count_if("ok").alias("parsed_ok"), F.count_if(~c("ok")).alias("parse_errors"))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~c("ok")).select("file", "error")


def fragments_of(parsed: DataFrame) -> DataFrame:
    """One row per top-level statement; a statement without an id gets a made-up one."""
    mapper = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return parsed.filter(c("ok") & (c("root") == "mapper")).select(
        mapper.alias("mapper"), "namespace", c("file").alias("source_file"), F.inline("fragments"))


def catalogue_counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("source_file", "mapper", "namespace").agg(F.count(F.lit(1)).alias("fragments"))


def catalogue_totals(parsed: DataFrame) -> DataFrame:
    mappers = parsed.filter(c("ok") & (c("root") == "mapper"))
    return mappers.agg(F.count(F.lit(1)).alias("mappers"), F.coalesce(F.sum(F.size("fragments")), F.lit(0)).alias("fragments"))


# ---- complexity ---------------------------------------------------------------

def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def complexity(texts: DataFrame, column: str, large_chars: int = LARGE_CHARS) -> DataFrame:
    """Size, branch counts, score, level and strategy of each text."""
    t = c(column)
    counted = texts.withColumns({
        "char_count": F.length(t).cast("bigint"), "join_count": occurrences(F.upper(t), "JOIN"), "if_count": occurrences(t, "<if"),
        "choose_count": occurrences(t, "<choose"), "foreach_count": occurrences(t, "<foreach")})
    score = c("join_count") + c("if_count") * 2 + c("choose_count") * 3 + c("foreach_count") * 2
    scored = counted.withColumns({
        "token_estimate": F.floor(c("char_count") / CHARS_PER_TOKEN), "is_large": c("char_count") > large_chars, "complexity": score})
    level = F
    for below, name in LEVELS:
        level = level.when(c("complexity") < below, name)
    leveled = scored.withColumn("complexity_level", level.otherwise(TOP_LEVEL))
    strategy = F.when(~c("is_large"), SMALL_STRATEGY)
    for name, chosen in STRATEGIES.items():
        strategy = strategy.when(c("complexity_level") == name, chosen)
    return leveled.withColumn("strategy", strategy)


# ---- parameters and test cases ------------------------------------------------

def bind_names(text: Column) -> Column:
    """Distinct root names of ``#{...}`` binds, in order of appearance."""
    inner = F.regexp_extract_all(text, F.lit(r"#\{([^}]*)\}"), F.lit(1))
    roots = F.transform(inner, lambda x: F.btrim(F.regexp_extract(F.btrim(x, F.lit(BLANKS)), r"^[^., ]*", 0), F.lit(BLANKS)))
    return F.array_distinct(F.filter(roots, lambda x: x != ""))


def fragment_parameters(fragments: DataFrame) -> DataFrame:
    """All, dynamic and static parameters of each fragment, and its branches."""
    named = F.transform("elements", lambda e: F.struct(
        e["kind"].alias("kind"), e["collection"].alias("collection"), e["when_tests"].alias("when_tests"),
        e["has_otherwise"].alias("has_otherwise"), bind_names(e["text"]).alias("params")))
    df = once(fragments, {"params": bind_names(c("content")), "_els": named})
    of = lambda kind: F.filter("_els", lambda e: e["kind"] == kind)
    dynamic = F.array_distinct(F.flatten(F.transform("_els", lambda e: e["params"])))
    return df.withColumns({
        "static_params": F.array_except("params", dynamic),
        "if_params": F.array_distinct(F.flatten(F.transform(of("if"), lambda e: e["params"]))),
        "chooses": F.transform(of("choose"), lambda e: F.struct(e["when_tests"].alias("when_tests"), e["has_otherwise"].alias("has_otherwise"))),
        "collections": F.transform(of("foreach"), lambda e: F.coalesce(e["collection"], F.lit("items"))),
    }).drop("_els")


def scenarios(fragments: DataFrame) -> DataFrame:
    """Test cases of each fragment: no/each/all optional conditions, each branch, lists of 0, 1 and 3."""
    texts = lambda *x: F.array(*x).cast("array<string>")
    case = lambda desc, branches, active, coll=None, size=None: F.struct(
        desc.alias("description"), branches.alias("branches"), active.alias("active"),
        (F.lit(None).cast("string") if coll is None else coll).alias("collection"), F.lit(size).cast("int").alias("size"))
    none = texts()
    no_case = F.filter(F.array(case(F.lit(""), none, none)), lambda x: F.lit(False))
    p, many = c("if_params"), F.size("if_params")
    ifs = F.when(many > 0, F.concat(
        F.array(case(F.lit(NONE_ACTIVE), none, none)),
        F.transform(p, lambda x: case(F.concat(x, F.lit(ONE_ACTIVE)), texts(F.concat(F.lit("if:"), x)), texts(x))),
        F.when(many > 1, F.array(case(F.lit(ALL_ACTIVE), F.transform(p, lambda x: F.concat(F.lit("if:"), x)), p))).otherwise(no_case),
    )).otherwise(no_case)
    number = lambda i: F.concat(F.lit("choose["), i.cast("string"), F.lit("]"))
    chooses = F.flatten(F.transform("chooses", lambda x, i: F.concat(
        F.transform(x["when_tests"], lambda t: case(F.concat(number(i), F.lit(" when: "), t), texts(F.concat(F.lit("when:"), t)), none)),
        F.when(x["has_otherwise"], F.array(case(F.concat(number(i), F.lit(" otherwise")), texts(F.concat(number(i), F.lit(":otherwise"))), none))).otherwise(no_case))))
    lists = F.flatten(F.transform("collections", lambda x: F.array(*(
        case(F.concat(F.lit("foreach "), x, F.lit(f": {label}")), texts(F.concat(F.lit("foreach:"), x, F.lit(f":{n}"))), none, x, n)
        for n, label in FOREACH_SIZES))))
    every = F.concat(ifs, chooses, lists)
    kept = ["mapper", "namespace", "sql_id", "static_params"]
    df = once(fragments.select(*kept, "if_params", "chooses", "collections"), {"_built": every})
    plain = F.array(case(F.lit(STATIC_SQL), none, none))
    df = df.select(*kept, F.when(F.size("_built") == 0, plain).otherwise(c("_built")).alias("_cases"))
    out = df.select("mapper", "namespace", "sql_id", "static_params", F.posexplode("_cases").alias("_i", "_c"))
    no = c("_i") + 1
    padded = F.when(no < 1000, F.lpad(no.cast("string"), 3, "0")).otherwise(no.cast("string"))
    return out.select(
        F.concat("mapper", F.lit("_"), "sql_id", F.lit("_tc"), padded).alias("test_case_id"), "mapper", "namespace", "sql_id",
        c("_c.description").alias("description"), c("_c.branches").alias("expected_branches"), "static_params",
        c("_c.active").alias("active_params"), c("_c.collection").alias("collection"), c("_c.size").alias("size"))


def parameter_values(cases: DataFrame, bind_columns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per test case and parameter with its value; lists carry how often the value repeats.

    ``bind_columns`` maps (mapper, sql_id, param) to a ``table.column``.  The
    value is the dictionary's sample, else a default of the column's type, cut
    to the column's length.
    """
    scalar = F.transform(F.array_distinct(F.concat("static_params", "active_params")), lambda x: F.struct(
        x.alias("param"), F.lit(None).cast("int").alias("repeats")))
    listed = F.array(F.struct(c("collection").alias("param"), c("size").alias("repeats")))
    # a list takes the place of a plain parameter of the same name
    every = F.when(c("collection").isNull(), scalar).otherwise(F.concat(F.filter(scalar, lambda x: x["param"] != c("collection")), listed))
    rows = cases.select("test_case_id", "mapper", "sql_id", F.inline(every))
    entry = dictionary.select("key", "data_type", "sample_value", "char_max_length", F.lit(True).alias("_found"))
    known = rows.join(bind_columns.select("mapper", "sql_id", "param", F.lower("ref").alias("key")), ["mapper", "sql_id", "param"], "left").join(entry, "key", "left")
    kind = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(F.coalesce("data_type", F.lit(""))), w))
    cut = lambda x: F.when(c("char_max_length") > 0, F.substring(x, F.lit(1), c("char_max_length").cast("int"))).otherwise(x)
    value = (
        F.when(c("_found").isNull(), F.lit(TEXT_SAMPLE)).when(c("sample_value").isNotNull(), cut(c("sample_value")))
        .when(kind(NUMERIC_KINDS), F.lit(NUMERIC_SAMPLE)).when(kind(DATETIME_KINDS), F.lit(DATETIME_SAMPLE)).otherwise(cut(F.lit(TEXT_SAMPLE)))
    )
    return known.select("test_case_id", "param", value.alias("value"), "repeats")


# ---- token substitution -------------------------------------------------------

def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def substitute_tokens(files: DataFrame, literals: Mapping[str, str]) -> DataFrame:
    """Replace ``#{name}`` and ``${name}`` of known names by their literals; counts what was replaced.

    ``literals`` is a short list of rules, one replacement pass each.  Token
    starts are marked first, so that text inside another token is left alone.
    """
    kept = F.replace(c("content"), F.lit(MARK), F.lit(OWN))
    df = once(files, {"_m": F.regexp_replace(kept, r"([#$])\{([^}]*)\}", MARK + r"$1{$2}")})
    text, count = c("_m"), F.lit(0)
    for name, literal in literals.items():
        quoted = "".join(f"\\{ch}" if not ch.isalnum() else ch for ch in name)
        pattern = MARK + r"[#$]\{[\r\f\x0B]*(?i:" + quoted + r")[\r\f\x0B]*(?:[, \t\n][^}]*)?\}"
        count = count + F.regexp_count(c("_m"), F.lit(pattern))
        text = F.regexp_replace(text, pattern, _escaped(literal).replace(MARK, OWN).replace("\\", "\\\\").replace("$", "\\$"))
    for start in ("#{", "${"):
        text = F.replace(text, F.lit(MARK + start), F.lit(start))
    return df.withColumn("variable_subs", count).withColumn("content", F.replace(text, F.lit(OWN), F.lit(MARK))).drop("_m")


def substitution_totals(substituted: DataFrame) -> DataFrame:
    return substituted.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(c("variable_subs") > 0).alias("changed_files"),
        F.coalesce(F.sum("variable_subs"), F.lit(0)).alias("variable_subs"))


# ---- statements ---------------------------------------------------------------

def statement_kind(statement: Column) -> Column:
    """procedure, dml or query, judged behind leading blanks and comments."""
    body = F.regexp_replace(F.coalesce(statement, F.lit("")), r"^(?:\s++|/\*(?:[^*]|\*(?!/))*+\*/|--[^\n]*+\n)*+", "")
    open_comment = body.startswith("/*") | body.startswith("--")
    s = F.when(open_comment, F.lit("")).otherwise(F.upper(body))
    starts = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.startswith(s, w))
    holds = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(s, w))
    return (
        F.when(starts(PROCEDURE_PREFIXES) | (s.startswith("BEGIN") & s.contains("END")), "procedure")
        .when(starts(DML_WORDS) | (s.startswith("WITH") & holds([f"{w} " for w in DML_WORDS])), "dml")
        .otherwise("query")
    )


def merge_audit(originals: DataFrame, converted: DataFrame) -> DataFrame:
    """What a merge would do with each statement: replaced, kept as it was, or a fragment nothing uses."""
    keys = ["mapper", "statement_type", "sql_id"]
    o = originals.groupBy(*keys).agg(F.bool_or("has_id").alias("has_id"), F.count(F.lit(1)).alias("statements"))
    f = converted.select(*keys).distinct().withColumn("_f", F.lit(True))
    joined = o.join(f, keys, "full_outer")
    fate = F.when(c("statements").isNull(), "unused").when(c("_f").isNull(), "not_replaced").otherwise("replaced")
    # statements without an id are merged but not reported
    return joined.withColumn("fate", fate).filter((c("fate") == "unused") | c("has_id")).select(
        *keys, "fate", F.coalesce("statements", F.lit(1)).alias("statements"))
