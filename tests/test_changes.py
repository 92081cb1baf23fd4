"""M1-M7 table-change jobs and D1 audit."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsmith.operators import audit, changes, rules

from helpers import rows

C = F.col


def test_update_where_unknown_predicate_leaves_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    assert rows(changes.update_where(df, "v", C("v") < 0, 0)) == [(1, 5), (2, None), (3, 0)]


def test_update_sequence_later_step_sees_earlier(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    out = changes.update_sequence(df, [("v", C("k") == 1, C("v") * 3), ("v", C("v") > 25, C("v") + 1)])
    assert rows(out) == [(1, 31), (2, 20)]


def test_update_by_mapping(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    m = spark.createDataFrame([(1, "A"), (3, None)], "key int, val string")
    assert rows(changes.update_by_mapping(df, "k", m, "key", {"v": "val"})) == [(1, "A"), (2, "b"), (3, None)]


def test_null_out_references(spark):
    df = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, ref int")
    gone = spark.createDataFrame([(10,), (10,)], "k int")
    assert rows(changes.null_out_references(df, "ref", gone, "k")) == [(1, None), (2, 11), (3, None)]


def test_cascade_delete_refuses_blocked_and_leaves_no_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    sales = spark.createDataFrame([(100, 2)], "po int, rep int")
    links = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k int, proj string")
    new_parent, kids, refused, accepted = changes.cascade_delete(
        parent, "k", keys, "k", sales, "rep", {"links": (links, "k", "delete"), "managed": (links, "k", "nullify")})
    assert rows(new_parent) == [(2,), (3,)]
    assert rows(refused) == [(2, "has_blocking_rows")]
    assert rows(accepted) == [(1,)]
    assert rows(kids["links"]) == [(2, "q"), (3, "r")]
    assert rows(kids["managed"]) == [(2, "q", False), (3, "r", False), (None, "p", True)]
    assert rules.orphans(kids["links"], ["k"], new_parent, ["k"]).count() == 0


def test_insert_checked_reasons(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    existing = spark.createDataFrame([(2, "x")], "id int, proj string")
    new = spark.createDataFrame([(1, "p"), (1, "p"), (2, "x"), (5, "z"), (None, "n"), (2, "y")],
                                "id int, proj string")
    acc, rej = changes.insert_checked(new, {"employee": ("id", parents, "id")}, existing=existing,
                                      key=["id", "proj"])
    assert rows(acc) == [(1, "p"), (2, "y"), (None, "n")]  # the first of a repeated key is inserted
    assert rows(rej) == [(1, "p", "duplicate_key"), (2, "x", "duplicate_key"), (5, "z", "unknown_employee")]


def test_insert_is_one_by_one(spark):
    parents = spark.createDataFrame([(10,), (11,)], "id int")
    new = spark.createDataFrame([(2, 10), (2, 99), (3, 11), (3, 10), (3, None), (None, 10), (None, 10)], "k int, ref int")
    got = rows(changes.insert_tagged(new, {"unit": ("ref", parents, "id")}, new.limit(0), ["k"], [C("ref").asc_nulls_last()]))
    assert got == [(2, 10, "accepted"), (2, 99, "unknown_unit"), (3, 10, "accepted"), (3, 11, "duplicate_key"),
                   (3, None, "duplicate_key"), (None, 10, "accepted"), (None, 10, "accepted")]
    with pytest.raises(ValueError):
        changes.insert_tagged(new, {"unit": ("ref", parents.unionByName(parents), "id")})


def test_look_ups_with_a_key_twice_raise(spark):
    from rowsmith.operators import hierarchy, joins, predicates
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    for job in (lambda: predicates.scalar_lookup(df, twice, ["k"], ["w"]),
                lambda: joins.join_lookup_default(df, twice, "k", "k", {"o": ("w", "-")}),
                lambda: changes.update_by_mapping(df, "k", twice, "k", {"v": "w"}),
                lambda: hierarchy.tree_rollup(spark.createDataFrame([(1, 0, 5), (1, 0, 6)], "n int, p int, v int"), "n", "p", "v")):
        with pytest.raises(ValueError):
            job()


def test_sums_keep_the_values(spark):
    from decimal import Decimal
    from rowsmith.operators import aggregates, hierarchy
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            d = spark.createDataFrame([(1, 1, 0.004), (2, 1, 0.004), (3, 1, 0.004), (4, 2, 1e12), (5, 2, 2e10)], "n int, g int, v double")
            assert [tuple(r)[:2] for r in aggregates.sub_totals(d, "g", "v").orderBy("g").collect()] == [(1, 0.012), (2, 1.02e12)]
            e = spark.createDataFrame([(1, None, Decimal("1.2345")), (2, 1, Decimal("0.0005"))], "n int, p int, v decimal(18,4)")
            assert aggregates.sub_totals(e, "p", "v").where("p is null").first()["total"] == Decimal("1.2345")
            assert {r["n"]: r["subtree_total"] for r in hierarchy.tree_rollup(e, "n", "p", "v").collect()} == \
                {1: Decimal("1.2350"), 2: Decimal("0.0005")}
            with pytest.raises(Exception, match="does not fit"):
                aggregates.sub_totals(spark.createDataFrame([(1, 1e30)], "g int, v double"), "g", "v").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_assign_keys_from_high_water_mark(spark):
    df = spark.createDataFrame([(1015, "x"), (None, "b"), (None, "a"), (7, "c")], "k long, name string")
    assert rows(changes.assign_keys(df, "k", ["name"])) == [(7, "c"), (1015, "x"), (1016, "a"), (1017, "b")]
    assert rows(changes.assign_keys(df, "k", ["name"], start_after=145)) == \
        [(7, "c"), (146, "a"), (147, "b"), (1015, "x")]


def test_audit_rows_only_for_changed_values(spark):
    old = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, None), (4, 10.0)], "k int, s double")
    new = spark.createDataFrame([(1, 110.0), (2, 50.0), (3, 5.0), (5, 1.0)], "k int, s double")
    out = audit.audit_changes(old, new, ["k"], "s", dt.datetime(1994, 1, 1), "admin").collect()
    assert len(out) == 1
    r = out[0]
    assert (r["k"], r["old_value"], r["new_value"], r["updater_id"]) == (1, 100.0, 110.0, "admin")
    assert abs(r["percent_change"] - 10.0) < 1e-9
    assert r["change_date"] == dt.datetime(1994, 1, 1)


def test_audit_of_equal_snapshots_is_empty(spark):
    old = spark.createDataFrame([(1, 100.0), (2, 0.0)], "k int, s double")
    assert audit.audit_changes(old, old, ["k"], "s", dt.datetime(2000, 1, 1), "u").count() == 0


def test_audit_old_zero_gives_null_percent(spark):
    old = spark.createDataFrame([(1, 0.0)], "k int, s double")
    new = spark.createDataFrame([(1, 5.0)], "k int, s double")
    assert audit.audit_changes(old, new, ["k"], "s", dt.datetime(2000, 1, 1), "u").first()["percent_change"] is None


def test_audit_update_equals_snapshot_diff_without_shuffle(spark):
    import contextlib
    import io
    from rowsmith.plans import standins as si
    from rowsmith.sources.tables import Catalog
    old = si.orders_keyed(Catalog(spark, "/root/testdata/sf0.001"))
    steps = si.price_update_steps()
    new, trig = audit.audit_update(old, ["o_orderkey"], "price", steps, si.AS_OF, "auditor")
    diff = audit.audit_changes(old, changes.update_sequence(old, steps), ["o_orderkey"], "price", si.AS_OF,
                               "auditor")
    assert trig.count() == diff.count() > 0
    assert trig.exceptAll(diff).count() == 0 and diff.exceptAll(trig).count() == 0
    assert new.columns == old.columns
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        trig.explain()
    assert "Exchange" not in buf.getvalue() and "Join" not in buf.getvalue()


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 500)), st.text(alphabet="abc", min_size=1, max_size=4)),
                min_size=1, max_size=40, unique_by=lambda t: (t[0] if t[0] is not None else object(), t[1])))
def test_assign_keys_properties(spark, recs):
    given_keys = [k for k, _ in recs if k is not None]
    if len(set(given_keys)) != len(given_keys):
        return  # keys must be unique where given (a primary key)
    names = [n for _, n in recs]
    recs = [(k, f"{n}-{i}") for i, (k, n) in enumerate(recs)]  # names unique: a total order
    df = spark.createDataFrame(recs, "k long, name string")
    out = dict((r["name"], r["k"]) for r in changes.assign_keys(df, "k", ["name"]).collect())
    mark = max(given_keys, default=0)
    missing = sorted(n for k, n in recs if k is None)
    assert [out[n] for n in missing] == list(range(mark + 1, mark + 1 + len(missing)))
    assert all(out[n] == k for k, n in recs if k is not None)
    assert len(set(out.values())) == len(out) == len(names)


@settings(max_examples=4, deadline=None)
@given(st.sets(st.integers(1, 30), min_size=1, max_size=15), st.sets(st.integers(1, 40), max_size=15),
       st.lists(st.integers(1, 40), max_size=20), st.lists(st.integers(1, 40), max_size=20))
def test_cascade_delete_properties(spark, parent_keys, wanted, blocker_refs, child_refs):
    parent = spark.createDataFrame([(k,) for k in sorted(parent_keys)], "k int")
    keys = spark.createDataFrame([(k,) for k in sorted(wanted)] or [(None,)], "k int").where("k IS NOT NULL")
    blockers = spark.createDataFrame([(b,) for b in blocker_refs] or [(None,)], "b int")
    child = spark.createDataFrame([(i, c) for i, c in enumerate(child_refs)] or [(0, None)], "id int, k int")
    new_parent, kids, refused, accepted = changes.cascade_delete(
        parent, "k", keys, "k", blockers, "b", {"child": (child, "k", "delete"), "soft": (child, "k", "nullify")})
    ref = {r[0] for r in refused.collect()}
    acc = {r[0] for r in accepted.collect()}
    assert ref | acc == set(wanted) and not (ref & acc)
    assert ref == set(wanted) & set(blocker_refs)
    assert {r[0] for r in new_parent.collect()} == set(parent_keys) - acc
    assert not ({r["k"] for r in kids["child"].collect()} & acc)
    assert not ({r["k"] for r in kids["soft"].collect()} & acc)
    assert kids["soft"].count() == child.count()
