import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest_llm import documents, same_as_sql, words
from rowsmith.llm import lexical_search
from rowsmith.llm.lexical_search import Best, ItemTiles, fold_terms, search


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in wanted.items():
        ranked = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                ranked.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(map(str, out))


def found(spark, docs, items, parts=3, **kw):
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, score string")
    return sorted(str(tuple(r)) for r in search(documents(spark, docs).repartition(parts), benchmark, **kw).collect())


def test_query_matches_sql(spark):
    assert same_as_sql(spark, "op11_lexical_search") > 300


def test_edges(spark, rng):
    docs = [(1, None), (2, ""), (3, "!?"), (4, "Über ÜBER über"), (5, "alpha beta"), (6, "alpha beta"), (7, "ALPHA-Beta, gamma"),
            (7, "ALPHA-Beta, gamma"), (None, "alpha beta"), (8, "x9y\x7fz"), (9, "alpha " + "pad " * 300_000 + "needle"), (10, "tail needle needle")]
    items = [(1, "alpha beta"), (2, None), (3, "?"), (4, "über"), (5, "x9y z"), (6, "needle pad"), (None, "gamma"), (1, "tail"), (7, "nowhere")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, [(2, None)]) == [] == found(spark, [(1, None)], items)
    assert found(spark, [], items) == [] == found(spark, docs, [])


@pytest.mark.parametrize("bounds", [dict(BLOCK_TERMS=5), dict(ITEM_TILE=2, DOC_TILE=7, TERM_TILE=3), dict(MAX_IMPACT=2 ** 53 // 9000)])
def test_blocks_and_tiles_change_nothing(spark, rng, monkeypatch, bounds):
    docs = [(i, words(rng, rng.randrange(0, 30), 40)) for i in range(120)] + [(500 + i, "w1 w2 w3") for i in range(40)]
    items = [(i, words(rng, rng.randrange(0, 9), 60)) for i in range(12)]
    for name, value in bounds.items():
        monkeypatch.setattr(lexical_search, name, value)
    # with a smaller MAX_IMPACT sums end sooner; the impacts themselves stay
    assert found(spark, docs, items, 4) == brute(docs, items)
    assert found(spark, docs, items, 2, k=3) == brute(docs, items, 3)


def test_long_text_is_folded_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical_search, "_PIECE", 3)
    text = "Ab cdefgh  ij,é" * 5
    assert [t.decode() for part in fold_terms(text) for t in part] == split(text)


def test_partial_sums_stay_below_two_to_the_53():
    rng = random.Random(1)
    weights = np.array([rng.randrange(1, 2 ** 31) for _ in range(3000)])
    cuts = ItemTiles.cuts(weights)
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts)][:-1] and cuts[-1][1] == 3000 and len(cuts) > 100
    assert all(int(weights[a:b].sum()) * lexical_search.MAX_IMPACT < 2 ** 53 for a, b in cuts)
    with pytest.raises(OverflowError):
        ItemTiles.cuts(np.array([2 ** 40]))


def test_ties_at_the_cut_are_settled_by_id():
    best = Best(1, 2)
    none = np.zeros(3, bool)
    best.add(0, np.array([[5], [5], [5]]), none, np.array([9, 3, 7]))
    best.add(0, np.array([[5], [0], [4]]), none, np.array([1, 0, 2]))
    assert best.doc.tolist() == [1, 3] and best.score.tolist() == [5, 5]
