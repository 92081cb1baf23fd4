import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline
from conftest_llm import SMALL, documents, words
from rowsmith.llm.mixing import OP5_SQL
from rowsmith.llm.ngram_jaccard import keep_one
from rowsmith.llm.quality_rules import CLASSES, SENTENCE_MARKS
from test_decontaminate import brute as brute_hits
from test_ngram_jaccard import brute as brute_components
from test_quality_rules import brute as brute_base


def class_of(c):
    kinds = (c.islower(), c.isupper(), c.isalpha(), c.isdigit(), c.isspace(), c in SENTENCE_MARKS, True)
    return kinds.index(True)


def js(p, q):
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    kl = lambda a: sum(v * np.log2(v / m[k]) for k, v in a.items() if v)
    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def brute_quality(rows):
    """Rows kept: references and distances from their definitions."""
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    classes, counts, totals = defaultdict(Counter), defaultdict(Counter), Counter()
    for r in rows:
        if r["lang"] is not None and r["text"]:
            classes[r["lang"]].update(map(class_of, r["text"]))
            counts[r["lang"]].update(w for w in letters(r["text"]) if len(w) <= 5)
            totals[r["lang"]] += len(letters(r["text"]))
    refs = []
    for lang, total in totals.items():
        shares = {k: v / sum(classes[lang].values()) for k, v in classes[lang].items()}
        common = {w: n / total for w, n in counts[lang].items() if n >= 0.005 * total}
        refs.append((shares, common | {"": 1 - sum(common.values())}))
    kept = []
    for r in rows:
        t = r["text"] or ""
        if brute_base(t)[-1]:
            continue
        if len(t) >= 200 and min(js({k: v / len(t) for k, v in Counter(map(class_of, t)).items()}, s) for s, _ in refs) > 0.28:
            continue
        w = letters(t)
        if len(w) >= 100:
            far = []
            for _, common in refs:
                c = Counter(x if x in common else "" for x in w)
                far.append(js({k: v / len(w) for k, v in c.items()}, common))
            if min(far) > 0.32:
                continue
        kept.append(r)
    return kept


def brute_run(sf_dir):
    con = duckdb.connect()
    rows = con.execute(f"SELECT * FROM read_parquet('{sf_dir}/documents.parquet')").df().astype(object).to_dict("records")
    items = con.execute(f"SELECT item_id, text FROM read_parquet('{sf_dir}/benchmark.parquet')").fetchall()
    rows = brute_quality(rows)
    smallest = {(i, low) for i, _, low in brute_components([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if (r["doc_id"], r["doc_id"]) in smallest]
    rows = [r for r in rows if not brute_hits(r["text"], items)[-1]]
    documents = pd.DataFrame(rows)
    documents["doc_id"] = documents["doc_id"].astype("int64")
    con.register("documents", documents)
    return Counter(x[0] for x in con.execute(OP5_SQL).fetchall()), {r["doc_id"]: r for r in rows}


def test_run_matches_brute_force(spark):
    want, rows = brute_run(SMALL)
    out = corpus_pipeline.run(spark, SMALL)
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert out.columns == source.columns + ["size", "text_crc32", "shard", "slot"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert all(r[c] == rows[r.doc_id][c] for c in source.columns)
        assert r["size"] == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_stages_keep_columns_and_take_empty_tables(spark, rng):
    docs = documents(spark, [None, "", words(rng, 80), words(rng, 80, 20), "odd " * 4])
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == docs.columns and out.count() <= 4 * frame.count(), name
        out = corpus_pipeline.sharding(spark, frame, SMALL)
        assert out.count() == frame.count() and set(out.columns) == {*docs.columns, "size", "text_crc32", "slot"}
    assert len(CLASSES) == 7


def test_one_of_each_group_stays(spark, rng):
    same, near = words(rng, 60), words(rng, 60, 10_000)
    rows = [(5, same), (3, same), (3, same), (None, same), (9, near), (8, near + " x"), (None, None), (None, None), (4, ""), (7, "alone")]
    out = sorted(((r.doc_id, r.text) for r in keep_one(documents(spark, rows)).collect()), key=str)
    assert out == sorted([(3, same), (8, near + " x"), (None, None), (None, None), (4, ""), (7, "alone")], key=str)
