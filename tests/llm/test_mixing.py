import pytest
from pyspark.sql import functions as F

from conftest_llm import SMALL, documents, same_as_sql, words
from rowsmith.llm.mixing import budgets, mix, mix_documents


def test_query_matches_sql(spark):
    assert same_as_sql(spark, "op5_mixing") > 0


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = leaves(spark, [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s1", 1000), ("b", "x", "s1", 1000)])
    out = {(r.domain, r.lang, r.source): r.budget for r in budgets(rows, {}, {}, {}, 40, 1).collect()}
    # 1204 tokens: 602 for each domain, 301 for each language of a; s1 of a/x lacks 140, which s2 takes
    assert out == {("a", "x", "s1"): 10, ("a", "x", "s2"): 291, ("a", "y", "s1"): 301, ("b", "x", "s1"): 602}
    rows = leaves(spark, [("a", "x", "s1", 10), ("a", "y", "s1", 20), ("b", "x", "s1", 1000), ("c", "x", "s1", 1000)])
    out = {(r.domain, r.lang): r.budget for r in budgets(rows, {"b": 3}, {}, {}, 50, 1).collect()}
    # a's 203 are more than its 30: the rest goes to b and c as 3 to 1
    assert out == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 738, ("c", "x"): 246}


def test_prefix_epochs_and_rows(spark, rng):
    docs = documents(spark, [words(rng, rng.randint(1, 30)) for _ in range(400)], source="big").unionByName(
        documents(spark, [(1000 + i, words(rng, 20)) for i in range(10)], source="small"))
    got = mix(docs, F.lit("d"), docs["lang"], docs["source"], docs["doc_id"], docs["text"], {}, {}, {"small": 1}, 50, 4)
    assert got.select("row.*").columns == docs.columns
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("epoch").alias("e"),
                                                        F.countDistinct("row.doc_id").alias("n")).collect()}
    assert by["small"].t == 800 and by["small"].e == 3 and by["small"].n == 10  # all it has, four times
    total = sum(len(r.text.split()) for r in docs.collect())
    assert total // 2 - 800 - 30 < by["big"].t <= total // 2 - 800 and by["big"].e == 0
    again = mix(docs.repartition(7), F.lit("d"), docs["lang"], docs["source"], docs["doc_id"], docs["text"], {}, {}, {}, 50, 4)
    ids = lambda df: sorted(map(tuple, df.select("row.doc_id", "epoch").collect()))
    assert ids(got) == ids(again)


def test_edges(spark):
    docs = documents(spark, [(1, None), (1, None), (2, ""), (None, "a b c"), (None, "a b c"), (5, "w " * 100_000)], lang=None, source=None)
    out = mix_documents(docs).collect()
    assert {r.lang for r in out} == {""} and len(out) >= 6
    assert mix_documents(docs.limit(0)).count() == 0
    assert mix_documents(docs.where("text is null or text = ''")).count() == 3
    with pytest.raises(ValueError):
        mix(docs, F.lit("d"), docs["lang"], docs["source"], docs["doc_id"], docs["text"], {"d": 0}, {}, {})


def test_query_reads_all(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mix_documents(docs)
    tokens = out.agg(F.sum("tokens")).first()[0]
    total = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert 0.8 * total < tokens <= total
