import numpy as np

from conftest_llm import crc, documents, words
from rowsmith.llm.quality_classifier import (BITS, dual_coordinate_descent, features, fit, fit_sigmoid, labelled_rows, learn, log_count_ratios,
                                             op9_quality_classifier, score, word_shapes)


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    n1, n0 = labels.sum(), (1 - labels).sum()
    return (order[labels == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, quality[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in quality]
    scores, labels, predicted = map(np.array, zip(*held))
    assert auc(scores, labels) > 0.97 and (predicted == labels).mean() > 0.93


def test_dual_coordinate_descent_is_optimal():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    labels = np.where([r[0] + r[1] < 8 for r in rows], 1, -1)
    values = [np.full(6, 0.4) for _ in rows]
    w, b = dual_coordinate_descent(rows, values, labels, np.ones(60), epochs=3000, tolerance=1e-9)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - y * (w[r] @ v + b)) for r, v, y in zip(rows, values, labels))
    best = loss(w, b)
    for _ in range(300):
        d = np.zeros_like(w)
        d[:30] = rng.normal(0, 0.01, 30)
        assert loss(w + d, b + rng.normal(0, 0.01)) >= best - 1e-6


def test_log_count_ratios():
    r = log_count_ratios([np.array([1, 2]), np.array([1]), np.array([3])], np.array([1, 1, -1]))
    assert r[1] > r[2] > r[5] > r[3]


def test_features_are_sets_and_blocks_do_not_matter():
    seen = np.zeros(1 << BITS, dtype=bool)
    text = "The cat sat. THE CAT sat sat!! on 12 mats*** " * 40
    whole = features(text, seen)
    assert set(features(text, seen, block=7)) == set(whole) and not seen.any()
    assert set(features("ab", seen)) < set(features("ab ab", seen)) and len(features(None, seen)) == 0 == len(features("", seen))
    assert len(features(" ", seen)) and len(features("a", seen))
    assert word_shapes(np.frombuffer(b" Foo foo foo BAR!! x1", np.uint8)).tolist() == [35, 1, 65, 18, 5]


def test_sigmoid_recovers_order_and_rate():
    rng = np.random.default_rng(0)
    m = rng.normal(0, 2, 4000)
    y = np.where(rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m + 0.5))), 1, -1)
    a, b = fit_sigmoid(m, y)
    assert abs(a - 1.5) < 0.2 and abs(b - 0.5) < 0.2


def test_edges(spark, rng):
    good = [(i, words(rng, 30)) for i in range(60)]
    bad = [(100 + i, words(rng, 30).upper() + "!!") for i in range(60)]
    docs = documents(spark, good + bad + [(500, None), (501, ""), (502, "word " * 100_000), (0, good[0][1])])
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = learn(docs, labels)
    out = [(r.doc_id, r.score) for r in score(docs, model).collect()]
    assert len(out) == 124 and all(0 <= s <= 1 for _, s in out)
    by = dict(out)
    assert min(by[i] for i, _ in good) > 0.7 > 0.3 > max(by[i] for i, _ in bad) and by[500] == by[501]
    assert score(docs.limit(0), model).count() == 0
    again = learn(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(again.weights, model.weights) and again.slope == model.slope
    ones = learn(docs, labels.where("quality = 1"))
    assert all(r.score > 0.99 for r in score(docs, ones).collect())
    assert all(r.score == 0.5 for r in score(docs, learn(docs, labels.limit(0))).collect())
    few = learn(docs, labels, max_rows=40)
    assert {r.doc_id: r.score for r in score(docs, few).collect()}[1] > 0.5


def test_fit_without_rows():
    assert fit([], np.zeros(0)).score(np.zeros(0, int)) == 0.5


def test_sample_is_bounded_where_one_id_is_held_by_many(spark, rng):
    many = spark.range(15_000).selectExpr("7L AS doc_id", "concat('text ', id % 9000, ' of many') AS text")
    docs = many.unionByName(spark.createDataFrame([(8, "other"), (9, None)], "doc_id long, text string")).repartition(6)
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 0, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_rows(docs, labels, "doc_id", "text", "quality", 100).collect()
    assert len(rows) == 100
    rows = labelled_rows(docs, labels, "doc_id", "text", "quality", 20_000).collect()
    assert len(rows) == 9002 and sum(r.label for r in rows) == 9000  # equal texts of one id count once
    again = labelled_rows(docs.repartition(3), labels, "doc_id", "text", "quality", 20_000).collect()
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(again) == key(rows)


def brute_features(text):
    """The indicators by a plain loop, as (kind, content) pairs without a hash."""
    raw = (text or "").encode()
    out = {("bytes", raw[i:i + n]) for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
    shapes, last = [], None
    for w in raw.split():
        kinds = 0
        for b in w:
            kinds |= 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 8 if chr(b) in ".,;:'\"()-?" else 16
        shapes.append(kinds + 32 * (65 <= w[0] <= 90 and len(w) > 1 and kinds & 1 > 0) + 64 * (w == last))
        last = w
    return out | {("shapes", tuple(shapes[i:i + n])) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


def test_scores_match_the_definition(spark, rng):
    """The query's scores against the model's formula over plainly listed indicators."""
    docs = [(i, words(rng, 20) if i % 2 else words(rng, 20).upper() + "!") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    frame = documents(spark, docs + [(100, None), (101, "a B 9 ?")])
    model = learn(frame, labels)
    seen = np.zeros(1 << BITS, dtype=bool)
    place = {}
    for _, t in docs:  # where each indicator is hashed to, from texts that hold it
        assert len(features(t, seen)) <= len(brute_features(t)) <= len(features(t, seen)) + 5
        place[t] = features(t, seen)
    for r in score(frame, model).collect():
        t = dict(docs).get(r.doc_id)
        if t is not None:
            x = model.scales[place[t]]
            margin = float(model.weights[place[t]].sum() / np.sqrt((x ** 2).sum())) + model.bias
            assert abs(r.score - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-9
