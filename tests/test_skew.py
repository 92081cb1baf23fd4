"""One key holding a third of the rows: results stay whole and exact, and the
key-grouped jobs pre-aggregate map-side before their shuffle."""

import collections
import contextlib
import io

from pyspark.sql import functions as F

from rowsmith.operators import aggregates, rules
from rowsmith.plans import reports

from helpers import rows

N = 3000


def skewed(spark):
    # key 0 holds a third of the rows; the rest spread over 500 keys
    data = [(i, 0 if i % 3 == 0 else 1 + i % 500, float(i % 10)) for i in range(N)]
    return spark.createDataFrame(data, "id long, k long, v double").repartition(6), data


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_duplicate_keys_hot_key(spark):
    df, data = skewed(spark)
    out = rules.duplicate_keys(df, ["k"])
    want = sorted((k, n) for k, n in collections.Counter(k for _, k, _ in data).items() if n > 1)
    assert rows(out) == want
    assert "partial_count" in plan_of(out)


def test_count_with_zero_hot_key(spark):
    df, data = skewed(spark)
    parents = spark.range(0, 600).withColumnRenamed("id", "k")
    out = dict(rows(aggregates.count_with_zero(parents, "k", df, "k", "n"), "k", "n"))
    counts = collections.Counter(k for _, k, _ in data)
    assert out == {k: counts.get(k, 0) for k in range(600)}
    assert out[0] == N // 3


def test_sub_totals_hot_key(spark):
    df, data = skewed(spark)
    out = {r["k"]: r for r in aggregates.sub_totals(df, "k", "v").collect()}
    hot = [v for _, k, v in data if k == 0]
    assert out[0]["total"] == sum(hot) and out[0]["n_values"] == len(hot)
    assert "partial_sum" in plan_of(aggregates.sub_totals(df, "k", "v"))


def test_orphans_and_ship_decisions_hot_customer(spark):
    df, data = skewed(spark)
    parents = spark.range(0, 400).withColumnRenamed("id", "k")
    assert rules.orphans(df, ["k"], parents, ["k"]).count() == sum(1 for _, k, _ in data if k >= 400)
    sales = df.select(F.col("id").alias("o_orderkey"), F.col("k").alias("o_custkey"),
                      F.when(F.col("id") % 2 == 0, "shipped").otherwise("open").alias("order_status"),
                      F.lit("1990-01-01").cast("timestamp_ntz").alias("ship_date"), F.lit("n").alias("paid"))
    cust = spark.range(0, 501).select(F.col("id").alias("c_custkey"), F.lit(None).cast("string").alias("on_hold"))
    import datetime as dt
    out = dict(rows(reports.ship_decisions(sales, cust, dt.datetime(2000, 1, 1))
                    .groupBy("decision").count()))
    # brute force: an open order is overdue when its customer has any shipped (unpaid, 1990) order
    shipped_custs = {k for i, k, _ in data if i % 2 == 0}
    want = collections.Counter("already_shipped" if i % 2 == 0 else
                               ("overdue" if k in shipped_custs else "ship") for i, k, _ in data)
    assert out == dict(want)


@contextlib.contextmanager
def skew_limits(spark):
    """Every join a shuffled one, a partition of twice the median and 10 kB is skewed."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark):
    """The joins of the checks and changes take the form that adaptive execution splits."""
    from rowsmith.operators import changes
    n = 60_000
    with skew_limits(spark):
        child = (spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).cast("long").alias("k"),
                                       F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8))
        parent = spark.range(1, 4000).select(F.col("id").alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(4)
        jobs = {
            "orphans": rules.orphans(child, ["k"], parent, ["p"]),
            "self_reference": rules.self_reference(child.select(F.col("id").alias("n"), F.col("k").alias("up"), "pad"), "n", "up"),
            "null_out": changes.null_out_references(child, "k", spark.range(0, 9).withColumnRenamed("id", "r").repartition(4), "r"),
            "insert": changes.insert_tagged(child, {"x": ("k", parent, "p")}),
        }
        for name, job in jobs.items():
            assert "skew=true" in final_plan(job), name
        sales = child.select(F.col("id").alias("o_orderkey"), F.col("k").alias("o_custkey"), F.lit("open").alias("order_status"),
                             F.lit(None).cast("timestamp_ntz").alias("ship_date"), F.lit("y").alias("paid"), "pad")
        customers = parent.select(F.col("p").alias("c_custkey"), F.lit("*").alias("on_hold"))
        decided = reports.ship_decisions(sales, customers, "2000-01-01 00:00:00")
        assert "skew=true" in final_plan(decided)
        assert decided.where("decision = 'on_hold'").count() == sales.where("o_custkey between 1 and 3999").count()


def hot_children(spark, n=60_000):
    """Half the rows refer to key 0, some to none; the rest spread over 5000 keys."""
    ref = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 5000).cast("long")
    return spark.range(n).select("id", ref.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8)


def test_cascade_takes_hot_references_past_the_shuffle(spark):
    """Adaptive execution has nothing to split here (the accepted keys come out of a join), so hot keys are measured."""
    from rowsmith.operators import changes
    child = hot_children(spark)
    data = child.select("id", "k").collect()
    parent = spark.range(0, 5000).select(F.col("id").alias("p"))
    keys = parent.where("p % 3 = 0").select(F.col("p").alias("k"))
    blockers = spark.range(0, 5000, 9).select((F.col("id") + 3).alias("b"))
    accepted = {k for k in range(0, 5000, 3)} - {k + 3 for k in range(0, 5000, 9)}
    with skew_limits(spark):
        new_parent, kids, refused, taken = changes.cascade_delete(
            parent, "p", keys, "k", blockers, "b", {"gone": (child, "k", "delete"), "kept": (child, "k", "nullify")})
        assert {r["k"] for r in taken.collect()} == accepted and 0 in accepted
        for name in kids:
            plan = final_plan(kids[name])
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan, name
            # no exchange carries the hot key: every shuffle of the child has the anti join with the hot keys under it
            assert plan.count("ShuffledHashJoin") == 0
        assert sorted(r["id"] for r in kids["gone"].collect()) == [r["id"] for r in sorted(data) if r["k"] not in accepted]
        assert rows(kids["kept"], "id", "k", "cleared") == sorted(
            ((r["id"], None if r["k"] in accepted else r["k"], r["k"] in accepted) for r in data),
            key=lambda t: tuple((x is None, 0 if x is None else x) for x in t))
        assert kids["kept"].columns == ["id", "k", "pad", "cleared"]


def test_shuffles_of_a_hot_table_carry_no_hot_row(spark):
    """Measured from the stages: the largest shuffle partition of the join has no third of the rows."""
    from rowsmith.operators.skew import hot_keys, split_by_keys
    child = hot_children(spark)
    with skew_limits(spark):
        hot = hot_keys(child, ["k"])
        assert [tuple(r) for r in hot.collect()] == [(0,)]
        right = spark.range(0, 4000, 2).withColumnRenamed("id", "k").repartition(4)
        hit, rest = split_by_keys(child, right.unionByName(right), ["k"])
        sizes = [n for _, n in hit.groupBy(F.spark_partition_id()).count().collect()]
        assert hit.count() == sum(1 for r in child.collect() if r["k"] is not None and r["k"] < 4000 and r["k"] % 2 == 0)
        assert hit.count() + rest.count() == 60_000 and max(sizes) < 10_000


def test_small_tables_measure_no_hot_keys(spark):
    from rowsmith.operators.skew import hot_keys, join_unique
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert hot_keys(df, ["k"]) is None and hot_keys(df.limit(0), ["k"]) is None
    right = spark.createDataFrame([(1, 5)], "k int, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(join_unique(df, right, ["k"], how)) == rows(df.join(right, ["k"], how))


def test_join_unique_equals_the_plain_join(spark, monkeypatch):
    from rowsmith.operators import skew
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    df = spark.createDataFrame([(i, 0 if i % 2 else i % 7, "x" if i % 3 else None) for i in range(100)], "id int, a int, b string")
    right = spark.createDataFrame([(a, b, a * 10) for a in range(5) for b in ("x", "y")], "a int, b string, w int")
    assert skew.hot_keys(df, ["a", "b"]) is not None
    for how in ("inner", "left", "left_semi", "left_anti"):
        for apart in (False, True):
            got = skew.join_unique(df, right, ["a", "b"], how, nulls_apart=apart)
            assert got.columns == df.join(right, ["a", "b"], how).columns and rows(got) == rows(df.join(right, ["a", "b"], how)), how


def test_insert_sends_one_row_a_task_for_a_hot_key(spark):
    from rowsmith.operators import changes
    child = hot_children(spark).drop("pad")
    parent = spark.range(0, 4000).select(F.col("id").alias("p"))
    none = child.limit(0)
    out = changes.insert_tagged(child, {"x": ("k", parent, "p")}, none, ["k"], ["id"])
    first = {}
    for i, k in sorted((r["id"], r["k"]) for r in child.collect() if r["k"] is not None):
        first.setdefault(k, i)
    want = collections.Counter("accepted" if r["k"] is None else "unknown_x" if r["k"] >= 4000 else
                               "accepted" if first[r["k"]] == r["id"] else "duplicate_key" for r in child.collect())
    assert dict(rows(out.groupBy("status").count())) == dict(want)
    assert "Window" not in final_plan(out) and "partial_min" in final_plan(out)
    by_column = changes.insert_tagged(child, {"x": ("k", parent, "p")}, none, ["k"], [F.col("id").asc()])
    assert rows(by_column) == rows(out)
