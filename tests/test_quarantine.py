"""S2 as a load that keeps going: good and refused rows apart, counted by the one pass."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from helpers import rows
from rowsmith.session import scratch_path
from rowsmith.sources import tables
from rowsmith.sources.quarantine import load_apart

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.TimestampNTZType()), T.StructField("qty", T.IntegerType()),
                       T.StructField("price", T.DecimalType(9, 2)), T.StructField("note", T.StringType()), T.StructField("paid", T.StringType())])
LINES = [("1", "01/31/88", "3", "9.99", "ok"), ("2", "02/30/99", "x", "1", "two problems"), ("3", None, None, None, None),
         ("4", "1999-12-31", "99999999999", "1", "too large"), ("x5", "12/31/49", "0", "12345678.9", "id and price"), ("6", "", "1", "1.005", "")]


def lines(spark, data=LINES):
    return spark.createDataFrame(data, "id string, day string, qty string, price string, note string")


def test_rows_are_kept_apart_and_counted(spark):
    load = load_apart(lines(spark), SCHEMA, scratch_path(spark, "q"), {"paid": "n"}, {"double": F.col("qty") * 2}, mdy_pivot=50)
    assert (load.n_loaded, load.n_refused) == (2, 4)
    good = {r["id"]: r for r in load.loaded.collect()}
    assert good[1]["day"] == dt.datetime(1988, 1, 31) and good[1]["double"] == 6 and good[1]["paid"] == "n"
    assert good[3]["day"] is None and good[3]["paid"] == "n" and load.loaded.columns == [*SCHEMA.names, "double"]
    bad = {r["id"]: r for r in load.refused.collect()}
    problems = {i: [tuple(p) for p in r["problems"]] for i, r in bad.items()}
    assert problems == {"2": [("day", "02/30/99"), ("qty", "x")], "4": [("qty", "99999999999")],
                        "x5": [("id", "x5"), ("price", "12345678.9")], "6": [("day", "")]}
    assert bad["4"]["day"] == "1999-12-31" and bad["2"]["note"] == "two problems"


def test_refused_rows_load_after_mending(spark):
    load = load_apart(lines(spark), SCHEMA, scratch_path(spark, "q"), mdy_pivot=50)
    mended = (load.refused.drop("problems").withColumn("id", F.regexp_replace("id", "x", "")).withColumn("day", F.lit("01/01/00"))
              .withColumn("qty", F.lit("1")).withColumn("price", F.lit("1")))
    again = load_apart(mended, SCHEMA, scratch_path(spark, "q"), mdy_pivot=50)
    assert (again.n_loaded, again.n_refused) == (4, 0) and again.refused.count() == 0
    assert sorted(r["id"] for r in again.loaded.unionByName(load.loaded).collect()) == [1, 2, 3, 4, 5, 6]


def test_good_rows_equal_the_strict_load(spark):
    good = lines(spark, [LINES[0], LINES[2]])
    strict = tables.load_with_defaults(good, SCHEMA, {"paid": "n"}, mdy_pivot=50)
    load = load_apart(good, SCHEMA, scratch_path(spark, "q"), {"paid": "n"}, mdy_pivot=50)
    assert rows(load.loaded) == rows(strict) and load.n_refused == 0 and load.loaded.dtypes == strict.dtypes
    with pytest.raises(Exception, match="no MM/DD/YY date"):
        tables.load_with_defaults(lines(spark, [("2", "02/30/99", "1", "1", "")]), SCHEMA, mdy_pivot=50).collect()


def test_empty_input_unknown_columns_and_typed_input(spark):
    empty = load_apart(lines(spark, LINES[:0]), SCHEMA, scratch_path(spark, "q"), mdy_pivot=50)
    assert (empty.n_loaded, empty.n_refused, empty.loaded.count(), empty.refused.count()) == (0, 0, 0, 0)
    with pytest.raises(ValueError, match="extra"):
        load_apart(lines(spark).withColumn("extra", F.lit(1)), SCHEMA, scratch_path(spark, "q"))
    typed = spark.createDataFrame([(1, "a"), (None, None)], "id long, note string")
    load = load_apart(typed, SCHEMA, scratch_path(spark, "q"))
    assert load.n_loaded == 2 and load.n_refused == 0


def test_one_pass_and_no_shuffle(spark):
    reads = spark.sparkContext.accumulator(0)
    source = lines(spark).rdd.map(lambda r: (reads.add(1), tuple(r))[1])
    path = scratch_path(spark, "q")
    load = load_apart(spark.createDataFrame(source, lines(spark).schema), SCHEMA, path, mdy_pivot=50)
    assert reads.value == len(LINES) and load.n_loaded + load.n_refused == len(LINES)
    # a second run overwrites the first
    again = load_apart(lines(spark, LINES[:2]), SCHEMA, path, mdy_pivot=50)
    assert (again.loaded.count(), again.refused.count()) == (1, 1)
