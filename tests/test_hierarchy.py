"""A4 tree rollup (N10) and S4 numbering."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsmith.operators import hierarchy, positions

from helpers import rows

# node, parent, value: a root, four levels, a NULL value, a node whose parent
# is not in the table, a second root
TREE = [(0, None, 100.0), (1, 0, 10.0), (2, 0, 20.0), (3, 1, 1.5), (4, 1, None), (5, 3, 0.25),
        (6, 5, 2.0), (7, 99, 7.0), (8, None, 8.0)]


def brute_rollup(tree):
    kids = {}
    for n, p, _ in tree:
        kids.setdefault(p, []).append(n)
    val = {n: v for n, _, v in tree}

    def walk(n):
        tot, vals, nulls, cnt = (val[n] or 0.0), int(val[n] is not None), int(val[n] is None), 1
        for c in kids.get(n, []):
            a, b, c2, d = walk(c)
            tot, vals, nulls, cnt = tot + a, vals + b, nulls + c2, cnt + d
        return tot, vals, nulls, cnt

    out = []
    for n, _, v in tree:
        tot, vals, nulls, cnt = walk(n)
        out.append((n, v, round(tot, 2), vals, cnt, nulls > 0))
    return sorted(out)


def test_rollup_matches_recursive_walk(spark):
    df = spark.createDataFrame(TREE, "node long, parent long, value double")
    got = rows(hierarchy.tree_rollup(df, "node", "parent", "value"),
               "node", "own_value", "subtree_total", "subtree_values", "subtree_nodes", "has_null")
    assert sorted(got) == brute_rollup(TREE)


def test_root_total_is_sum_of_its_tree(spark):
    df = spark.createDataFrame(TREE, "node long, parent long, value double")
    r = {x["node"]: x for x in hierarchy.tree_rollup(df, "node", "parent", "value").collect()}
    assert r[0]["subtree_total"] == pytest.approx(100 + 10 + 20 + 1.5 + 0.25 + 2.0)
    assert r[0]["subtree_nodes"] == 7 and r[0]["has_null"] is True
    assert r[8]["subtree_total"] == 8.0 and r[8]["subtree_nodes"] == 1


def test_hot_parent(spark):
    """One parent with most of the rows as direct children."""
    data = [(0, None, 1.0)] + [(i, 0, 1.0) for i in range(1, 3001)] + [(5000 + i, i, 2.0) for i in range(1, 11)]
    df = spark.createDataFrame(data, "node long, parent long, value double")
    r = {x["node"]: x for x in hierarchy.tree_rollup(df, "node", "parent", "value").collect()}
    assert r[0]["subtree_total"] == 3001 + 20 and r[0]["subtree_nodes"] == 3011
    assert r[1]["subtree_total"] == 3.0


def test_cycle_raises(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, None, 1.0)], "node long, parent long, value double")
    with pytest.raises(hierarchy.TreeDepthError):
        hierarchy.tree_rollup(df, "node", "parent", "value", max_depth=6)


def test_with_position_numbers_sorted_rows_0_to_n(spark):
    data = [(i, f"n{(i * 7919) % 1000:04d}") for i in range(1000)]
    df = spark.createDataFrame(data, "k long, name string").repartition(7)
    out = positions.with_position(df, ["name", "k"]).collect()
    by_pos = sorted(out, key=lambda r: r["position"])
    assert [r["position"] for r in by_pos] == list(range(1000))
    assert [r["name"] for r in by_pos] == sorted(r["name"] for r in out)


def test_with_position_start_and_empty(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k long")
    assert rows(positions.with_position(df, ["k"], start=10), "k", "position") == [(1, 10), (2, 11), (3, 12)]
    assert positions.with_position(df.where("k > 5"), ["k"]).count() == 0


def test_deep_chain_and_branches(spark):
    """A 300-long chain with side branches: log2(depth) rounds must still
    count every descendant exactly once."""
    data = [(0, None, 1.0)] + [(i, i - 1, float(i % 7)) for i in range(1, 300)] \
        + [(1000 + i, i, 0.5) for i in range(0, 300, 13)]
    df = spark.createDataFrame(data, "node long, parent long, value double")
    got = rows(hierarchy.tree_rollup(df, "node", "parent", "value"),
               "node", "own_value", "subtree_total", "subtree_values", "subtree_nodes", "has_null")
    assert sorted(got) == brute_rollup(data)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.one_of(st.none(), st.integers(0, 12).map(lambda x: x / 4))),
                min_size=1, max_size=40))
def test_random_forests_match_walk(spark, links):
    """Random forests (parent index always smaller, so no cycles), some
    parents absent, some values NULL."""
    tree = []
    for i, (p, v) in enumerate(links):
        parent = None if i == 0 or p % 5 == 0 else (p % i if p % 7 else 1000 + p)
        tree.append((i, parent, v))
    df = spark.createDataFrame(tree, "node long, parent long, value double")
    got = rows(hierarchy.tree_rollup(df, "node", "parent", "value"),
               "node", "own_value", "subtree_total", "subtree_values", "subtree_nodes", "has_null")
    assert sorted(got) == brute_rollup(tree)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=3), min_size=0, max_size=60), st.integers(1, 9))
def test_with_position_random(spark, names, parts):
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string").repartition(parts)
    out = positions.with_position(df, ["name", "k"]).collect()
    assert sorted(r["position"] for r in out) == list(range(len(names)))
    assert [(r["name"], r["k"]) for r in sorted(out, key=lambda r: r["position"])] == \
        sorted((n, k) for k, n in enumerate(names))
