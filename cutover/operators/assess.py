"""Assessment trees: flattening, severities and the objects to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutover.functions.once import once
from cutover.operators.load import union_all
from cutover.session import stage

#: Levels of a tree that the first pass unfolds, and the most that a later one does; each pass takes twice as many.
LEVELS, MOST_LEVELS = 4, 32
# Object types that hold code.
CODE_TYPES = ["PROCEDURE", "FUNCTION", "PACKAGE", "PACKAGE BODY", "TRIGGER", "TYPE", "TYPE BODY", "VIEW", "MATERIALIZED VIEW"]
CRITICAL = "CRITICAL"

c = F.col


def _field(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _below(nodes: Column) -> Column:
    """The children of some (path, node), each with its own path."""
    children = lambda n: F.coalesce(_field(n["node"], "$.children", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(nodes, lambda n: F.transform(children(n), lambda x, i: F.struct(F.concat(n["path"], F.lit("/"), i).alias("path"), x.alias("node")))))


def _own_fields(nodes: DataFrame) -> DataFrame:
    """The fields of nodes themselves; only trees that are still folded up keep what is under them."""
    def field(path, kind):
        return _field(c("node"), path, kind)

    codes = F.transform(field("$.statistic.messageActions", "array<variant>"), lambda x: _field(x, "$.code", "string"))
    return nodes.withColumns({
        "name": field("$.name", "string"), "object_type": field("$.statistic.objectType", "string"),
        "error_nodes": F.coalesce(F.nullif(field("$.statistic.countErrorNodes", "string"), F.lit("")).cast("int"), F.lit(0)),
        "codes": F.array_distinct(F.filter(codes, lambda x: x.isNotNull() & (x != ""))),
        "children": F.coalesce(F.size(field("$.children", "array<variant>")), F.lit(0)),
        "_is_node": ~c("_folded") & (field("$.name", "string").isNotNull() | field("$.statistic", "variant").isNotNull()),
        "node": F.when(c("_folded"), c("node"))})


def _marked(depth: int, folded: bool):
    return lambda n: F.struct(n["path"].alias("path"), F.lit(depth).alias("depth"), n["node"].alias("node"), F.lit(folded).alias("_folded"))


def flatten_trees(docs: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """One row per node of every tree, with its path of child positions and its depth.

    The text is parsed once, into a binary tree that is cut apart without
    parsing.  A pass unfolds some levels inside the row of a document and
    writes their nodes together with the trees below them, which the next pass
    goes on with, twice as many levels at a time; trees of any depth need no
    schema.  A document that is no JSON, or has one name twice in an object,
    has no nodes.
    """
    tops = F.array(F.struct(F.lit("0").alias("path"), F.try_parse_json(json_column).alias("node")))
    level, depth, many, done = docs.select(c(id_column), tops.alias("_l0")), 1, LEVELS, []
    while True:
        for k in range(many):
            # each level is made once and used twice: for its own nodes and for the level below
            level = once(level, {f"_l{k + 1}": _below(c(f"_l{k}"))})
        found = F.concat(*(F.transform(f"_l{k}", _marked(depth + k, folded=k == many)) for k in range(many + 1)))
        nodes = _own_fields(level.select(id_column, F.inline(found)))
        written = stage(nodes.filter(c("_is_node") | c("_folded")), "tree-levels")
        done.append(written.filter("_is_node").drop("_is_node", "_folded", "node"))
        below = written.filter("_folded")
        if below.isEmpty():
            return union_all(done)
        level = below.select(id_column, F.array(F.struct("path", "node")).alias("_l0"))
        depth, many = depth + many, min(2 * many, MOST_LEVELS)


def severity_dimension(docs: DataFrame, json_column: str) -> DataFrame:
    """code -> severity from action-item documents; entries that are not objects are skipped."""
    items = docs.select(F.explode(F.from_json(json_column, "map<string,string>")).alias("code", "entry"))
    return items.filter(F.ltrim("entry").startswith("{")).select(
        "code", F.coalesce(F.get_json_object("entry", "$.severityType"), F.lit("")).alias("severity")).distinct()


def select_targets(nodes: DataFrame, severities: DataFrame, id_column: str, code_types_only: bool = True) -> DataFrame:
    """Objects with error nodes or a critical action item, and the reasons."""
    df = nodes.filter(F.coalesce("object_type", F.lit("")) != "")
    if code_types_only:
        df = df.filter(c("object_type").isin(CODE_TYPES))
    critical = severities.filter(c("severity") == CRITICAL).select("code").distinct()
    # the list of codes is the side that may be small; its measured size decides how it travels
    hits = df.select(id_column, "path", F.explode("codes").alias("code")).join(critical, "code").groupBy(id_column, "path").agg(
        F.array_sort(F.collect_set("code")).alias("critical_codes"))
    df = df.join(hits, [id_column, "path"], "left").withColumn("critical_codes", F.coalesce("critical_codes", F.array().cast("array<string>")))
    reasons = F.array_compact(F.array(
        F.when(c("error_nodes") > 0, F.concat(F.lit("countErrorNodes="), c("error_nodes"))),
        F.when(F.size("critical_codes") > 0, F.concat(F.lit("critical_codes="), F.array_join("critical_codes", ",")))))
    return df.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(
        id_column, "path", "object_type", F.element_at(F.split("name", r"\."), -1).alias("object_name"), "reasons", "error_nodes", "critical_codes")
