import hashlib
import re

import pytest

from conftest_llm import SMALL, documents, same_as_sql, words
from rowsmith.llm import decontaminate
from rowsmith.llm.decontaminate import drop_contaminated, op8_decontaminate, scan, word_windows


def brute(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = split(text)
    hit, found = set(), set()
    for item, t in items:
        v = split(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            part = v[i:i + 10]
            for j in range(len(w) - len(part) + 1):
                if w[j:j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_query_matches_sql(spark):
    assert same_as_sql(spark, "op8_decontaminate") == 200


def test_query_matches_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 4000}
    for r in op8_decontaminate(spark, SMALL).collect():
        if r.doc_id in docs:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(docs[r.doc_id], items)


def test_edges(spark, rng):
    long_item = words(rng, 30, 10_000)
    items = [(1, long_item), (1, long_item), (2, "Short Question?"), (3, None), (4, ""), (5, "..."), (10, "über ÉCLAIR"), (6, "a a")]
    w = long_item.split()
    docs = [None, "", "!!", "short  QUESTION", "shortquestion", "xshort question", "one short-question two short question",
            "x " + ", ".join(w[5:15]).upper() + " y", " ".join(w[5:14]), " ".join(w), "über éclair", "über ÉCLAIR", "a a a A",
            "pad " * 60_000 + " ".join(w[20:30])]
    frame = documents(spark, docs)
    out = {r.doc_id: r for r in scan(frame, word_windows(bench(spark, items))).collect()}
    for i, t in enumerate(docs):
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(t, items), t
        for s in r.spans:
            assert t[s.start].isalnum() and t[s.end - 1].isalnum()
    assert docs[6][out[6].spans[0].start:out[6].spans[0].end] == "short-question"
    assert docs[11][out[11].spans[0].start:out[11].spans[0].end] == "über ÉCLAIR"
    kept = drop_contaminated(frame, word_windows(bench(spark, items)))
    assert kept.columns == frame.columns and kept.count() == sum(not r.contaminated for r in out.values())
    assert scan(frame.limit(0), word_windows(bench(spark, items))).count() == 0
    none = word_windows(bench(spark, items).limit(0))
    assert none == {} and not any(r.n_hit for r in scan(frame, none).collect())


def test_item_without_id_marks_but_is_not_listed(spark):
    r = scan(documents(spark, ["what is this"]), word_windows(bench(spark, [(None, "is this")]))).first()
    assert (r.n_hit, r.n_items, r.contaminated) == (2, 0, True)


def test_bound_raises(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WORDS", 3)
    with pytest.raises(ValueError):
        word_windows(bench(spark, [(1, "a b c d")]))


@pytest.mark.parametrize("bound", [1, 25, 60])
def test_benchmark_above_the_bound_is_done_in_blocks(spark, rng, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WORDS", bound)
    long_item, other = words(rng, 80, 10_000), words(rng, 30, 10_000)
    items = [(1, long_item), (2, "Short Question?"), (3, None), (4, ""), (6, long_item), (7, other), (8, "short question")]
    w, v = long_item.split(), other.split()
    texts = [None, "", "!!", "a SHORT,  question here", " ".join(w), "x " + ", ".join(w[20:45]).upper() + " y " + " ".join(v[3:13]),
             "no id", " ".join(w[5:14]), " ".join(v + w)]
    benchmark = bench(spark, items)
    blocks = list(decontaminate.window_blocks(benchmark))
    assert len(blocks) > 1 and len({k for b in blocks for k in b}) == 71 + 21 + 1
    assert all(len(b) <= max(1, bound) for b in blocks)
    docs = documents(spark, [*enumerate(texts), (4, texts[4]), (4, None), (None, texts[3])]).repartition(3)
    found = decontaminate.hits(docs, benchmark)
    assert found.columns == scan(docs, {}).columns
    key = lambda rows: sorted(map(str, rows))
    rows = docs.collect()
    assert key((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == \
        key((r.doc_id, *brute(r.text, items)) for r in rows)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and key(map(tuple, kept.collect())) == key(tuple(r) for r in rows if not brute(r.text, items)[-1])
    # as with one automaton, with spans that several passes found parts of and an item without an id
    benchmark = bench(spark, [*items, (None, "no id")])
    blocks = key(map(tuple, decontaminate.hits(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WORDS", 500_000)
    assert blocks == key(map(tuple, decontaminate.hits(docs, benchmark).collect()))


def test_query_in_blocks_matches_sql(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WORDS", 300)
    assert same_as_sql(spark, "op8_decontaminate") == 200
