"""Plan checks: pushdown, pruning, no cartesian products, no Python nodes."""

import contextlib
import io

import pytest

from rowsmith.plans.catalog import all_queries

from helpers import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsIn", "MapInPandas", "MapInArrow", "PythonUDF")


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(spec.run(spark, SF_SMALL)) for name, spec in all_queries().items()}


def test_no_cartesian_or_python_nodes(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items()}
    assert {n: f for n, f in bad.items() if f} == {}


def test_filters_reach_the_scan(plans):
    assert "EqualTo(c_mktsegment,BUILDING)" in plans["filter_param"]
    assert "GreaterThanOrEqual(o_orderdate" in plans["filter_range"] and "LessThan(o_orderdate" in plans["filter_range"]
    assert "StringStartsWith(p_brand,Brand#1)" in plans["filter_prefix"]
    assert "In(o_orderpriority" in plans["filter_in_list"]
    # the location test of the flagship sits under the view's join, on the customer scan
    assert "EqualTo(c_mktsegment,BUILDING)" in plans["report_phone_list"]


def test_columns_are_pruned(plans):
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plans["project_columns"]
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_discount:double>" in plans["filter_between"]


def test_spans_and_audit_need_no_shuffle(plans):
    assert "Exchange" not in plans["text_find_spans"] and "Generate" in plans["text_find_spans"]
    assert "Contains(text,th)" in plans["text_find_spans"].replace("StringContains", "Contains")
    assert "Exchange" not in plans["audit_changes"]


def test_orders_are_not_shuffled_for_the_range_table(plans):
    for name in ("scalar_subquery", "join_composite", "check_foreign_key_composite", "check_lookup_range"):
        assert "hashpartitioning" not in plans[name] and "BuildRight" in plans[name], name


def test_status_tests_reach_the_scan(plans):
    assert "EqualTo(o_orderstatus,F)" in plans["check_cross_table"]


def test_no_single_partition_window(plans):
    """A window must be keyed: no query moves all rows of a window
    into one partition."""
    for name, p in plans.items():
        if "Window" in p:
            assert "SinglePartition" not in p, name


def test_shuffled_plans_have_no_cartesian_or_nested_loop(spark):
    """The plans the queries get at scale, with broadcasts off: every join is
    still an equi-join on keys (sort-merge), never a cartesian product or a
    nested loop, and no Python node appears."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bad = {}
        for name, spec in all_queries().items():
            p = plan_of(spec.run(spark, SF_SMALL))
            hit = [f for f in FORBIDDEN if f in p]
            if hit:
                bad[name] = hit
        assert bad == {}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
