"""Scalars, dates, arrays (X1-X10, R1-R2; N3, N7, N9, N13)."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsmith.functions import arrays, dates, scalars

from helpers import rows

C = F.col


def test_concat_null_propagates(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(scalars.concat_null(C("x"), ", ", C("y"))).collect()] == ["a, b", None]


def test_is_upper(spark):
    df = spark.createDataFrame([("ABC",), ("AbC",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.is_upper("s")).collect()] == [True, False, None]


def test_case_chain_first_true_wins(spark):
    df = spark.createDataFrame([(1, 5), (None, 5), (3, 1)], "a int, b int")
    e = scalars.case_chain([(C("a") == 1, "one"), (C("b") > 2, "big")], "other")
    assert [r[0] for r in df.select(e).collect()] == ["one", "big", "other"]


def test_raise_by_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(Decimal("10.10"),), (Decimal("0.10"),), (Decimal("33.33"),)], "v decimal(12,2)")
    out = [r[0] for r in df.select(scalars.raise_by_percent("v", "5")).collect()]
    # 10.605 -> 10.61, 0.105 -> 0.11 (half up), 34.9965 -> 35.00
    assert out == [Decimal("10.61"), Decimal("0.11"), Decimal("35.00")]


def test_percent_change(spark):
    df = spark.createDataFrame([(100.0, 110.0), (0.0, 1.0), (None, 1.0)], "o double, n double")
    out = [r[0] for r in df.select(scalars.percent_change("o", "n")).collect()]
    assert abs(out[0] - 10.0) < 1e-12 and out[1] is None and out[2] is None


def test_int_functions_widen_before_overflow(spark):
    df = spark.createDataFrame([(6, 2), (2147483647, 1), (-3, None), (0, 0), (-2147483648, 1)], "k int, l int")
    got = df.select(scalars.int_add("k", "l"), scalars.int_sub("k", "l"), scalars.int_double("k")).collect()
    assert [tuple(r) for r in got] == [(8, 4, 12), (2147483648, 2147483646, 4294967294), (None, None, -6),
                                       (0, 0, 0), (-2147483647, -2147483649, -4294967296)]


def test_parse_mdy_pivot(spark):
    df = spark.createDataFrame([("12/31/88",), ("01/02/05",), ("3/4/50",), ("02/30/99",), ("xx",), (None,),
                                ("07/04/1776",)], "t string")
    got = [r[0] for r in df.select(dates.parse_mdy("t", pivot=50)).collect()]
    assert got == [dt.datetime(1988, 12, 31), dt.datetime(2005, 1, 2), dt.datetime(1950, 3, 4), None, None, None,
                   dt.datetime(1776, 7, 4)]


def test_days_between_and_minus_days(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 3, 12))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(dates.days_between("a", "b"), dates.minus_days(C("b"), 60)).first()
    assert r[0] == 2.5 and r[1] == dt.datetime(1999, 11, 4, 12)


def test_element_out_of_range_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "a array<double>")
    got = df.select(arrays.element("a", 1), arrays.element("a", 3)).collect()
    assert [tuple(r) for r in got] == [(1.0, None), (None, None)]


def test_array_slots_five_rows_blank_and_null(spark):
    df = spark.createDataFrame([(1, ["en", " ", "fr"]), (2, None), (3, ["a", "b", "c", "d", "e"])],
                               "k int, langs array<string>")
    out = rows(arrays.array_slots(df, "langs", 5), "k", "slot", "value")
    assert [r for r in out if r[0] == 1] == [(1, 1, "en"), (1, 2, "NULL"), (1, 3, "fr"), (1, 4, None),
                                             (1, 5, None)]
    assert [r for r in out if r[0] == 2] == [(2, s, None) for s in range(1, 6)]
    assert [r[2] for r in out if r[0] == 3] == ["a", "b", "c", "d", "e"]


def test_arrays_over_the_slots_are_reported_not_cut(spark):
    from rowsmith.operators import joins, rules
    df = spark.createDataFrame([(1, list("abcdef")), (2, ["a"]), (3, None)], "k int, a array<string>")
    broken = rules.violations(df, [rules.Rule("five", arrays.fits_slots("a", 5))], ["k"])
    assert rows(broken) == [(1, "five")]
    for cut in (df.select(arrays.fixed_slots("a", 5).alias("a")), arrays.array_slots(df, "a", 5)):
        with pytest.raises(Exception, match="more than 5 slots"):
            cut.collect()
    every = joins.join_lateral_explode(df, "a", keep_empty=False)
    assert rows(every.where("k = 1"), "slot", "value") == list(enumerate("abcdef", 1))


def test_fixed_slots(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(arrays.fixed_slots("a", 4)).collect()] == [["a", "b", " ", " "], None]


def test_days_between_ignores_session_time_zone(spark):
    """Midnight 1995-10-15 does not exist in Sao Paulo (DST began then):
    zone-less values must still differ by exactly one day."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.createDataFrame([(dt.datetime(1995, 10, 14), dt.datetime(1995, 10, 15)),
                                    (dt.datetime(1995, 10, 15), dt.datetime(1995, 10, 16))],
                                   "a timestamp_ntz, b timestamp_ntz")
        assert [r[0] for r in df.select(dates.days_between("a", "b")).collect()] == [1.0, 1.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.dates(min_value=dt.date(1950, 1, 1), max_value=dt.date(2049, 12, 31)), min_size=1, max_size=30),
       st.lists(st.text(alphabet="0123456789/ x", max_size=10), max_size=10))
def test_parse_mdy_round_trip_and_garbage(spark, days, junk):
    """Every date of the pivot window survives MM/dd/yy and back; any other
    text gives a valid date or NULL, never an error."""
    df = spark.createDataFrame([(dt.datetime(d.year, d.month, d.day),) for d in days], "ts timestamp_ntz")
    out = df.select("ts", dates.parse_mdy(dates.format_mdy("ts"), pivot=50).alias("back")).collect()
    assert all(r["ts"] == r["back"] for r in out)
    g = spark.createDataFrame([(j,) for j in junk] or [("",)], "t string")
    parsed = [r[0] for r in g.select(dates.parse_mdy("t")).collect()]
    assert all(p is None or isinstance(p, dt.datetime) for p in parsed)
