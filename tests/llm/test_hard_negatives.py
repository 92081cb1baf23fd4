import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from conftest_llm import same_as_sql
from rowsmith.llm import hard_negatives
from rowsmith.llm.hard_negatives import Heaps, mine, scores, strassen, window_of

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, id int"


def brute(rows, every=50, n_positives=5, n_negatives=3):
    """``rows``: (id, vector, label) with labels as they are."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
          if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(ok):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z, at) for at, (j, w, z) in enumerate(ok)]
        positives = sorted((s, j) for s, j, z, at in scored if at != a and j != i and z == y)[:n_positives]
        for p, j in positives:
            fits = sorted((s, k) for s, k, z, _ in scored if z != y and 50 * -p <= 100 * -s <= 95 * -p)[:n_negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, parts=3, **kw):
    frame = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA)
    return sorted(tuple(r) for r in mine(frame.repartition(parts), **kw).collect())


def vectors(rng, n, dim=6, labels=3):
    return [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) + rng.random() / 8 for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def test_query_matches_sql(spark):
    assert same_as_sql(spark, "op13_hard_negatives") > 50


@pytest.mark.parametrize("bounds", [{}, dict(BLOCK_BYTES=200), dict(ANCHOR_TILE=2, CANDIDATE_TILE=5, LEAF=1)])
def test_matches_brute_force(spark, rng, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(rng, 150)
    expected = brute(rows, 10)
    assert len(expected) > 100 and found(spark, rows, every=10) == expected


def test_edges(spark, rng):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.5], 1) for i in range(0, 30)] + [(100 + i, [0.75, 0.25], 2) for i in range(9)] + [(200 + i, [0.75, 0.25], 2) for i in range(9)]
    odd = [(None, [9.0, 9.0], 1), (60, None, 1), (70, [1.0, None], 1), (80, [nan, 1.0], 2), (90, [inf, 1.0], 2), (40, [1.0, 0.5], None),
           (50, [], 3), (51, [], 3), (52, [], 4), (20, [1.0, 0.5], 1), (110, [1.0], 7), (111, [1.0, 2.0, 3.0], 7), (112, [0.7], 8), (120, [1.0, 0.5, 0.25], 1)]
    rows = same + odd
    assert found(spark, rows, every=10) == brute(rows, 10)
    negative = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.75], 2), (3, [0.0], 2), (4, [0.0], 1)]
    assert found(spark, negative) == brute(negative) == [(0, 4, 1, 3, 0, 0)]
    assert found(spark, []) == [] == found(spark, [(1, [1.0], 1)]) == found(spark, [(0, [1.0], 1)]) == found(spark, [(0, None, None)])


def test_scores_beyond_64_bits_are_refused(spark):
    assert found(spark, [(0, [1e6], 1), (1, [1e6], 1), (2, [9e5], 2)]) == brute([(0, [1e6], 1), (1, [1e6], 1), (2, [9e5], 2)])
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e9], 1), (1, [1e9], 1)])
    with pytest.raises(OverflowError):
        scores(np.array([[2 ** 40]]), np.array([[2 ** 30]]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 19), st.integers(1, 19), st.integers(1, 19), st.integers(1, 4), st.integers(0, 2 ** 32))
def test_strassen_is_exact(m, k, n, leaf, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(-2 ** 28, 2 ** 28, (m, k)), r.integers(-2 ** 28, 2 ** 28, (k, n))
    assert (strassen(a, b, leaf) == a @ b).all() and strassen(a, b, leaf).shape == (m, n)


def test_intermediate_sums_may_wrap():
    a = np.array([[2 ** 62, 3], [2 ** 62, 5]])
    b = np.array([[1, 0], [2, 1]])
    assert (strassen(a, b, 1) == np.array([[2 ** 62 + 6, 3], [2 ** 62 + 10, 5]])).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.integers(0, 9)), max_size=60), st.integers(1, 7), st.integers(1, 4))
def test_heaps_merge_in_any_order(entries, piece, k):
    heaps, other = Heaps(4, k), Heaps(4, k)
    for order, h in ((entries, heaps), (entries[::-1], other)):
        for at in range(0, len(order), piece):
            h.add(*(np.array(c, np.int64) for c in zip(*order[at:at + piece])))
    want = [x for s in range(4) for x in sorted((e for e in entries if e[0] == s), key=lambda e: (-e[1], e[2]))[:k]]
    assert list(zip(heaps.slot, heaps.score, heaps.id)) == want == list(zip(other.slot, other.score, other.id))


def test_windows_are_exact():
    p = np.arange(-100, 2000)
    low, high = window_of(p, np.ones(len(p), bool))
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist()):
        fits = [s for s in range(-200, 2000) if 50 * x <= 100 * s <= 95 * x]
        assert fits == list(range(a, b + 1))
