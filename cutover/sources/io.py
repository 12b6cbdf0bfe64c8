"""Readers and writers: databases, JSON documents, mapper corpora, reports, inventories."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.functions.once import once

FETCH_ROWS = 1000
BATCH_ROWS = 10_000
HEAD_CHARS = 2048
MAPPER_MARKS = ["DTD Mapper", "<mapper"]

c = F.col


def jdbc_options(kind: str, host: str, port: int, database: str, user: str, password: str) -> dict[str, str]:
    """Connection options; the URL's form follows the kind of database."""
    urls = {
        "oracle": f"jdbc:oracle:thin:@//{host}:{port}/{database}",
        "postgres": f"jdbc:postgresql://{host}:{port}/{database}",
    }
    drivers = {"oracle": "oracle.jdbc.OracleDriver", "postgres": "org.postgresql.Driver"}
    if kind not in urls:
        raise ValueError(f"unknown database kind {kind}")
    return {"url": urls[kind], "driver": drivers[kind], "user": user, "password": password}


def jdbc_read_options(base: dict[str, str], table: str | None = None, query: str | None = None, column: str | None = None,
                      bounds: tuple[int, int] | None = None, partitions: int = 1, fetch_rows: int = FETCH_ROWS) -> dict[str, str]:
    """Options of one read; a numeric ``column`` with bounds splits a table into parallel range reads."""
    if (table is None) == (query is None):
        raise ValueError("name a table or a query, not both")
    out = {**base, "fetchsize": str(fetch_rows)}
    if column is not None:
        if bounds is None or bounds[0] > bounds[1]:
            raise ValueError("a split read needs ordered bounds")
        out |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
        # a split read takes its text as a derived table
        out["dbtable"] = table if table is not None else f"({query}) q"
    elif table is not None:
        out["dbtable"] = table
    else:
        out["query"] = query
    return out


def read_jdbc(spark: SparkSession, options: dict[str, str], predicates: Sequence[str] | None = None) -> DataFrame:
    """Read a table or query; ``predicates`` has one condition per partition, such as ``split_predicates`` makes."""
    if predicates is None:
        return spark.read.format("jdbc").options(**options).load()
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=list(predicates), properties=rest)


def sql_literal(value) -> str:
    """A number, text, date or time as a literal both kinds of database read alike."""
    if isinstance(value, bool) or value is None:
        raise ValueError("neither truth values nor null split a table")
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return format(value, "f") if isinstance(value, decimal.Decimal) else repr(value)


def split_predicates(histogram: Sequence[tuple], column: str, partitions: int, within: str | None = None) -> list[str]:
    """Conditions that cut a table into parts of about equal size, for a read in parallel.

    ``histogram`` has (value, rows) for values of ``column`` in rising order,
    such as a sampled or exact count by value; rows of values it lacks fall
    to the part of the value before.  Each row of the table meets exactly one
    condition, null included.  A value with more rows than a part is one of its
    own, cut further by ``within``, a whole-number expression, if that is given.
    """
    if partitions < 1 or not histogram:
        raise ValueError("a split needs values and at least one part")
    if any(not a[0] < b[0] for a, b in zip(histogram, histogram[1:])):
        raise ValueError("values must rise")
    depth = max(1, -(-sum(rows for _, rows in histogram) // partitions))
    # (first value, whether it stands alone, rows)
    parts: list[list] = []
    for value, rows in histogram:
        alone = rows >= depth
        if not parts or alone or parts[-1][1] or parts[-1][2] + rows > depth:
            parts.append([value, alone, rows])
        else:
            parts[-1][2] += rows
    out = []
    for i, (value, alone, rows) in enumerate(parts):
        low = f"{column} >= {sql_literal(value)}" if i else None
        high = f"{column} < {sql_literal(parts[i + 1][0])}" if i + 1 < len(parts) else None
        condition = " AND ".join(x for x in (low, high) if x)
        if not i:
            condition = f"{condition} OR {column} IS NULL" if condition else "1 = 1"
        pieces = -(-rows // depth) if alone and within else 1
        if pieces == 1:
            out.append(condition)
        else:
            out += [f"({condition}) AND MOD(COALESCE({within}, 0), {pieces}) " + (f"= {k}" if k else f"NOT IN ({', '.join(map(str, range(1, pieces)))})") for k in range(pieces)]
    return out


def key_histogram(df: DataFrame, column: str, buckets: int = 1000) -> list[tuple]:
    """Equi-depth histogram of a key for ``split_predicates``: about ``buckets`` values with the rows from each to the next.

    Values with as many rows as a bucket are counted by themselves.  The driver gets a few values per bucket.
    """
    if not isinstance(df.schema[column].dataType, (T.IntegralType, T.DateType)):
        raise ValueError("only whole numbers and dates can be cut by value")
    known = df.select(c(column).alias("v")).filter("v is not null")
    bounds = known.agg(F.percentile_approx("v", [k / buckets for k in range(buckets)], 10 * buckets)).first()[0] if not known.isEmpty() else []
    # a value that several quantiles name is frequent; the next value begins a bucket of its own
    least = known.agg(F.min("v")).first()[0]
    frequent = {v for v in bounds if bounds.count(v) > 1}
    step = datetime.timedelta(days=1) if isinstance(df.schema[column].dataType, T.DateType) else 1
    starts = sorted({least, *bounds, *(v + step for v in frequent)}) if bounds else []
    if not starts:
        return []
    listed = F.array(*(F.lit(v) for v in starts))
    counted = known.groupBy(F.array_size(F.filter(listed, lambda s: s <= c("v"))).alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = {r.i - 1: r.n for r in counted}
    return [(v, rows[i]) for i, v in enumerate(starts) if i in rows]


def write_jdbc(df: DataFrame, base: dict[str, str], table: str, batch_rows: int = BATCH_ROWS) -> None:
    """Replace a table's rows and keep its definition."""
    df.write.format("jdbc").options(**base, dbtable=table, batchsize=str(batch_rows), truncate="true").mode("overwrite").save()


def read_json_documents(spark: SparkSession, folder: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """Documents of a folder, without the ones that do not parse.

    Whether a document parses depends on its whole text and schema, whatever columns are read of it later.
    """
    return _parsed_documents(spark, folder, schema, one_per_file).filter(c("_doc._corrupt_record").isNull()).select("_doc.*").drop("_corrupt_record")


def _parsed_documents(spark: SparkSession, folder: str, schema: str, one_per_file: bool) -> DataFrame:
    texts = spark.read.text(folder, wholetext=one_per_file).filter(F.length(F.btrim("value", F.lit(" \t\r\n"))) > 0)
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return once(texts, {"_doc": parsed})


def count_corrupt(spark: SparkSession, folder: str, schema: str, one_per_file: bool = True) -> int:
    return _parsed_documents(spark, folder, schema, one_per_file).filter(c("_doc._corrupt_record").isNotNull()).count()


def looks_like(text: Column, marks: Sequence[str] = MAPPER_MARKS, head_chars: int | None = HEAD_CHARS) -> Column:
    """Whether one of the marks stands in the head of a text, or anywhere in it without ``head_chars``."""
    head, hit = text if head_chars is None else F.substring(text, 1, head_chars), F.lit(False)
    for mark in marks:
        hit = hit | head.contains(mark)
    return F.coalesce(hit, F.lit(False))


def read_corpus(spark: SparkSession, folder: str, exclude_dirs: Sequence[str] = (), suffix: str = ".xml", marks: Sequence[str] = MAPPER_MARKS,
                head_chars: int | None = HEAD_CHARS) -> DataFrame:
    """Whole files below a folder as (file, content): mappers only, no resource forks, no excluded folders.

    ``file`` is the path below the folder, whatever kind of store that is in;
    only folders below it can be excluded.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/")
    # file names come percent-encoded; a plus sign stands for itself in a path
    path = F.url_decode(F.replace(F.regexp_replace(c("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    df = files.select(F.substr(path, F.lit(len(root) + 2)).alias("file"), c("value").alias("content"))
    parts = F.split("file", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    df = df.filter(~F.element_at(parts, -1).startswith("._"))
    if exclude_dirs:
        df = df.filter(~F.arrays_overlap(folders, F.array(*(F.lit(d) for d in exclude_dirs))))
    return df.filter(looks_like(c("content"), marks, head_chars))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path and size of the files below a folder; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length")


def inventory_summary(files: DataFrame, by: Column) -> DataFrame:
    return files.groupBy(by.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
