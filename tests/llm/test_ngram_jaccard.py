import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from conftest_llm import SMALL, documents, same_as_sql, words
from rowsmith.llm import ngram_jaccard
from rowsmith.llm.components import components
from rowsmith.llm.ngram_jaccard import (apart, bitmap, folded, list_pairs, needed, op7_ngram_jaccard, prefix_length, set_name, sets_of, shingles_of,
                                        with_smallest_id, words_of)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(set size, smallest id) for each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    low = lambda x: min((d for d in ids[x] if d is not None), default=None)
    return sorted(((doc, len(sets[i]), low(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def found(spark, rows):
    out = with_smallest_id(ngram_jaccard.join(documents(spark, rows)))
    return sorted(((r.id, r.n, r.component_id) for r in out.collect()), key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = op7_ngram_jaccard(spark, SMALL)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_query_matches_sql(spark):
    assert same_as_sql(spark, "op7_ngram_jaccard", "/root/testdata/sf0.01") == 1000


def near_copies(rng):
    """Chains and stars of near copies, many at the edge of the limit, in a crowd that shares a passage."""
    passage = words(rng, 30, 10_000)
    rows = [f"{passage} {words(rng, rng.randint(20, 80), 10_000)}" for _ in range(80)]
    for base in (words(rng, 70, 10_000), words(rng, 150, 10_000)):
        rows += [edited(rng, base, rng.randint(0, 5)) for _ in range(60)]
        step = base
        for _ in range(12):  # each like the one before, the ends unlike
            step = edited(rng, step, 1)
            rows.append(step)
    rows += [rows[-1]] * 20
    return list(enumerate(rows))


def test_near_copies_match_brute_force(spark, rng):
    rows = near_copies(rng)
    assert found(spark, rows) == brute(rows)


def test_split_lists_and_frequent_shingles_do_not_matter(spark, rng, monkeypatch):
    rows = near_copies(rng)
    want = brute(rows)
    monkeypatch.setattr(ngram_jaccard, "LIST_LIMIT", 20)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 5)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    assert found(spark, rows) == want


def test_edges(spark):
    long = "very long text " * 30_000
    rows = [(1, None), (2, None), (3, ""), (4, " \n\t"), (5, "a b"), (6, "A  B"), (7, "a b c"), (8, "a"), (None, "A b\nc"), (None, None),
            (9, "x y z w v"), (10, "x y z w v"), (10, "x y z w v"), (11, long), (12, long + "end"), (None, "only null"), (13, "a\x1cb c d e"),
            (14, "ü Ü É é ß"), (15, "Ü Ü É é ß")]
    assert found(spark, rows) == brute(rows)
    assert with_smallest_id(ngram_jaccard.join(documents(spark, ["a"]).limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tZ", max_size=40), max_size=12))
def test_sets_do_not_depend_on_chunks(texts):
    whole = [s.tolist() for s in sets_of(texts)]
    assert whole == [next(iter(sets_of([t]))).tolist() for t in texts] == [s.tolist() for s in sets_of(texts, chunk=1)]
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    names = {}
    for s, t in zip(whole, texts):
        assert names.setdefault(shingles(t), set_name(np.array(s, np.uint64))) == set_name(np.array(s, np.uint64))


def test_words_do_not_depend_on_blocks():
    raw = b"  one two\tthree four  fivefivefive six " * 20
    a, b = words_of(raw), words_of(raw, block=13)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


@pytest.mark.parametrize("first", [True, False])
def test_list_pairs_lose_nothing(first):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 100).astype(np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        k = rng.integers(0, 25)
        s[rng.choice(99, k, replace=False) + 1] = rng.integers(0, 2 ** 63, k).astype(np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    bits = list(map(bitmap, sets))
    vertex = np.arange(150)
    pairs = list(map(tuple, list_pairs(vertex, n, np.zeros(150, int), np.ones(150, int), vertex.copy(), np.full(150, 2), bits, first).tolist()))
    linked = [(a, b) for a, b in combinations(range(150), 2)
              if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    if not first:
        assert set(linked) <= set(pairs)
        return
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    assert len(pairs) < 150 and all(find(a) == find(b) for a, b in linked)


def test_bitmaps_never_exceed_the_distance():
    rng = np.random.default_rng(9)
    for n in (3, 500, 513, 3000, 5000):
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(0.9 * n)], rng.integers(0, 2 ** 63, n // 3 + 1).astype(np.uint64))))
        x, y = (np.frombuffer(bitmap(s), np.uint64) for s in (a, b))
        far = len(np.setxor1d(a, b))
        assert 0.5 * far < int(apart(x, y[None])[0]) <= far and int(apart(folded(x, 16), folded(y, 16))) <= far


def test_needed_and_prefix():
    for nx in range(1, 60):
        for ny in range(1, 60):
            k = needed(nx, ny)
            assert 100 * k >= 80 * (nx + ny - k) and 100 * (k - 1) < 80 * (nx + ny - k + 1)
    assert [prefix_length(n) for n in (1, 5, 10, 100)] == [1, 2, 3, 21]
    assert len(shingles_of(np.arange(4, dtype=np.uint64))) == 1


def test_components(spark, rng):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(50)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame(edges, "a long, b long").limit(0)).count() == 0


def test_sets_that_share_a_name_stay_apart(spark, rng, monkeypatch):
    """With names of a few bits every name is shared; both hashes then tell the sets apart."""
    rows = near_copies(rng)[:150] + [(900, "a b"), (901, "b a"), (902, "A B"), (903, "")]
    monkeypatch.setattr(ngram_jaccard, "set_name", lambda s: len(s) % 4)
    assert found(spark, rows) == brute(rows)


def test_hot_shingles_and_pivots_do_not_matter(spark, rng, monkeypatch):
    from rowsmith.operators import skew
    rows = near_copies(rng)
    want = brute(rows)
    for name, value in (("HOT_ROWS", 3), ("HOT_SHARE", 0.01)):
        monkeypatch.setattr(skew, name, value)
    for pivots, block in ((0, 4), (2, 4), (100, 2)):
        monkeypatch.setattr(ngram_jaccard, "PIVOTS", pivots)
        monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
        assert found(spark, rows) == want, (pivots, block)


def test_clusters_of_a_list_get_pivots_of_their_own():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(4):
        base = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        for _ in range(50):
            s = base.copy()
            s[rng.choice(200, 4, replace=False)] = rng.integers(0, 2 ** 63, 4).astype(np.uint64)
            sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    answers = ngram_jaccard._Answers(n, np.zeros(200, int), list(map(bitmap, sets)), 80)
    for x in range(200):
        answers.answer_all(x)
    assert len(answers.pivots) == 4
    for x in (0, 60, 199):
        y = answers.partners(x, np.arange(200))
        linked = [i for i in range(200) if 100 * len(np.intersect1d(sets[x], sets[i])) >= 80 * len(np.union1d(sets[x], sets[i]))]
        assert set(linked) <= set(y.tolist()) <= set(range(x // 50 * 50, x // 50 * 50 + 50))
