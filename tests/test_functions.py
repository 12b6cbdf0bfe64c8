from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.functions import oracle as O
from cutover.functions.equality import cells_equal

c = F.col


def one(spark, expr, **cols):
    df = spark.range(1).select(*(v.alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("r")).first().r


def test_null_rules(spark):
    n = F.lit(None).cast("int")
    assert one(spark, O.greatest(F.lit(1), n)) is None
    assert one(spark, O.least(F.lit(1), F.lit(3))) == 1
    assert one(spark, O.concat_ignoring_null("a", F.lit(None), "b")) == "ab"
    assert one(spark, O.concat_ignoring_null(F.lit(None), F.lit(None))) is None
    assert one(spark, O.decode(n, None, "none", 1, "one", "other")) == "none"
    assert one(spark, O.decode(F.lit(5), 1, "one")) is None
    assert one(spark, O.nvl2(n, F.lit("set"), F.lit("null"))) == "null"


@pytest.mark.parametrize("value,currency,text", [
    ("1234567.5", "KRW", "1,234,568"), (None, "KRW", "0"), ("0.5", "USD", "$.50"), ("-1234.5", "USD", "$-1,234.50"),
    ("12", "EUR", "12.00 EUR"), ("999999999999", "KRW", "999,999,999,999"), ("1000000000000", "KRW", "#" * 16), ("2.5", "JPY", "3"),
])
def test_format_amount(spark, value, currency, text):
    assert one(spark, O.format_amount(F.lit(value).cast("decimal(20,2)"), currency)) == text


def test_mask_and_raw(spark):
    assert one(spark, O.mask_string(F.lit("abcdef"))) == "abc***"
    assert one(spark, O.mask_string(F.lit("abc"))) == "abc"
    assert one(spark, O.mask_string(F.lit(None).cast("string"))) is None
    assert one(spark, O.raw_to_text(O.text_to_raw(F.lit("héllo")))) == "héllo"


def test_dates(spark):
    d = lambda s: F.lit(date.fromisoformat(s))
    assert one(spark, O.add_months(d("2024-02-29"), 1)) == date(2024, 3, 31)
    assert one(spark, O.add_months(d("2024-01-31"), 1)) == date(2024, 2, 29)
    assert one(spark, O.calc_age(d("1980-06-15"), d("2020-06-14"))) == 39
    assert one(spark, O.calc_age(d("1980-06-15"), d("2020-06-15"))) == 40
    assert one(spark, O.to_char_date(d("2024-03-05"), "YYYY-MM-DD HH24:MI:SS")) == "2024-03-05 00:00:00"
    assert one(spark, O.korean_day(d("2024-03-03"))) == "일"


def test_business_days_equals_walking_the_span(spark):
    df = spark.sql("select date'2024-01-01' + a as a, date'2024-01-01' + b as b from (select explode(sequence(0, 13)) a) lateral view explode(sequence(-3, 40)) t as b")
    walked = F.expr("case when a > b then 0 else size(filter(sequence(a, b), x -> weekday(x) < 5)) end")
    assert df.filter(O.business_days(c("a"), c("b")) != walked).count() == 0
    assert one(spark, O.business_days(F.lit(None).cast("date"), F.lit(date(2024, 1, 1)))) == 0


def test_numbers(spark):
    dec = lambda s: F.lit(Decimal(s))
    assert one(spark, O.round_half_up(dec("1250"), -2)) == 1300
    assert one(spark, O.trunc_number(dec("-1.7"))) == -1
    assert spark.createDataFrame([(3.0,)], "v double").agg(O.variance(c("v"))).first()[0] == 0
    assert spark.createDataFrame([(1.0,), (3.0,)], "v double").agg(O.variance(c("v"))).first()[0] == 2


@pytest.mark.parametrize("a,at,b,bt,equal", [
    (5, T.IntegerType(), 5.0, T.DoubleType(), True), ("99.99", T.StringType(), "99.989", T.StringType(), False),
    ("Y", T.StringType(), "Y ", T.StringType(), False), (None, T.StringType(), None, T.StringType(), True),
    (None, T.IntegerType(), 0, T.IntegerType(), False), (5, T.IntegerType(), "5", T.StringType(), True),
    (5.0, T.DoubleType(), "5", T.StringType(), False), (True, T.BooleanType(), 1, T.IntegerType(), False),
    (2**53 + 1, T.LongType(), float(2**53), T.DoubleType(), False), (2**53, T.LongType(), float(2**53), T.DoubleType(), True),
    (Decimal("1.50"), T.DecimalType(5, 2), 1.5, T.DoubleType(), True), (1e300, T.DoubleType(), 1, T.LongType(), False),
])
def test_strict_equality(spark, a, at, b, bt, equal):
    df = spark.createDataFrame([(a, b)], T.StructType([T.StructField("a", at), T.StructField("b", bt)]))
    assert df.select(cells_equal(c("a"), at, c("b"), bt).alias("r")).first().r is equal
    assert df.select(cells_equal(c("b"), bt, c("a"), at).alias("r")).first().r is equal


def test_like_has_wildcards_and_no_escape(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("50%",), ("c\\d",)], "t string")
    find = lambda part: sorted(r.t for r in df.filter(O.like_anywhere(F.col("t"), part)).collect())
    assert find("a_b") == ["a_b", "axb"] and find("%") == sorted(["a_b", "axb", "50%", "c\\d"]) and find("c\\d") == ["c\\d"]


def test_add_months_keeps_month_end_and_time(spark):
    row = spark.sql("SELECT timestamp_ntz'2001-02-28 13:45:00' AS a, timestamp_ntz'2001-03-30 08:00:00' AS b").select(O.add_months_at(F.col("a"), -12).alias("a"), O.add_months_at(F.col("b"), -1).alias("b")).first()
    assert str(row.a) == "2000-02-29 13:45:00" and str(row.b) == "2001-02-28 08:00:00"


def test_to_timestamp(spark):
    df = spark.createDataFrame([("2024-02-29 23:05:07", "29.02.2024", "2024-02-29")], "a string, b string, c string")
    r = df.select(O.to_timestamp(F.col("a")).alias("a"), O.to_timestamp(F.col("b"), "DD.MM.YYYY").alias("b"), O.to_timestamp(F.col("c"), "YYYY-MM-DD").alias("c"))
    assert dict(r.dtypes) == dict.fromkeys("abc", "timestamp_ntz")
    assert tuple(r.first()) == (datetime(2024, 2, 29, 23, 5, 7), datetime(2024, 2, 29), datetime(2024, 2, 29))
