"""F1-F9 and J1-J7 helpers on small hand-made frames (three-valued logic)."""

from pyspark.sql import functions as F

from rowsmith.operators import joins, predicates

from helpers import rows

C = F.col


def test_filters_and_three_valued_logic(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "c", None), (4, "ab", 2)], "k int, s string, v int")
    assert rows(predicates.filter_null(df, "s"), "k") == [(2,)]
    assert rows(predicates.filter_null(df, "s", is_null=False), "k") == [(1,), (3,), (4,)]
    # NOT IN is unknown for a NULL value: that row is not kept
    assert rows(predicates.filter_in_list(df, "s", ["a"], negate=True), "k") == [(3,), (4,)]
    assert rows(predicates.filter_prefix(df, "s", "a"), "k") == [(1,), (4,)]
    assert rows(predicates.filter_range(df, "v", 2, 7), "k") == [(1,), (4,)]
    assert rows(predicates.filter_range(df, "v", upper=5, upper_inclusive=True), "k") == [(1,), (4,)]
    assert rows(predicates.filter_between(df, "v", 5, 7), "k") == [(1,), (2,)]
    got = df.select("k", predicates.is_true(C("v") > 4).alias("t"), predicates.is_not_false(C("v") > 4).alias("nf"))
    assert rows(got) == [(1, True, True), (2, True, True), (3, False, True), (4, False, False)]


def test_key_set_and_scalar_lookup(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, s string")
    keys = spark.createDataFrame([(1,), (3,), (3,), (9,)], "k int")
    assert rows(predicates.filter_key_set(df, keys, "k")) == [(1, "x"), (3, "z")]
    look = spark.createDataFrame([(1, "a", 10), (3, "c", 30)], "k int, s2 string, lo int")
    assert rows(predicates.scalar_lookup(df, look, ["k"], ["lo"]), "k", "lo") == [(1, 10), (2, None), (3, 30)]


def test_joins(spark):
    left = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, ref int")
    right = spark.createDataFrame([(10, "ten"), (20, "twenty")], "key int, name string")
    assert rows(joins.join_inner(left, right, "ref", "key"), "id", "name") == [(1, "ten")]
    assert rows(joins.join_anti(left, right, "ref", "key"), "id") == [(3,)]
    assert rows(joins.join_semi(left, right.withColumnRenamed("key", "ref"), ["ref"]), "id") == [(1,)]
    assert rows(joins.join_semi(left, right.withColumnRenamed("key", "ref"), ["ref"], negate=True), "id") == \
        [(2,), (3,)]
    comp_l = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 1)], "id int, k1 string, k2 int")
    comp_r = spark.createDataFrame([("a", 1, "hit"), (None, 1, "never")], "k1 string, k2 int, tag string")
    assert rows(joins.join_composite(comp_l, comp_r, ["k1", "k2"]), "id", "tag") == [(1, "hit")]


def test_lateral_explode_outer_and_inner(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "k int, arr array<string>")
    outer = rows(joins.join_lateral_explode(df, "arr"), "k", "slot", "value")
    assert outer == [(1, 1, "a"), (1, 2, "b"), (2, None, None), (3, None, None)]
    inner = rows(joins.join_lateral_explode(df, "arr", keep_empty=False), "k", "slot", "value")
    assert inner == [(1, 1, "a"), (1, 2, "b")]
