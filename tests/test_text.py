"""Exact search spans, marks and clearing (N15), against a plain scan."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from rowsmith.functions import text

from helpers import rows


def scan_spans(s, needle):
    """Reference scan: left to right, next search from the end of the match."""
    out, i, k = [], 0, 0
    if not needle:
        return out
    while True:
        j = s.find(needle, i)
        if j < 0:
            return out
        out.append((k, j, j + len(needle)))
        k, i = k + 1, j + len(needle)


def spark_spans(spark, docs, needle):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = rows(text.find_spans(df, "doc_id", "text", needle), "doc_id", "match_no", "start", "end")
    return sorted(got)


def brute(docs, needle):
    return sorted((d, k, a, b) for d, s in enumerate(docs) for k, a, b in scan_spans(s, needle))


FIXTURE = ["no hit here", "ab at start and end ab", "ababab", "aaaa", "AB upper only", "ééé ab é ab",
           "x.y*z \\Q \\E a.b", "", "ab"]


def test_fixture_cases(spark):
    for needle in ("ab", "aa", "a.b", "*", "\\Q", "\\E", "é ab"):
        assert spark_spans(spark, FIXTURE, needle) == brute(FIXTURE, needle), needle


def test_overlapping_candidates_are_not_double_counted(spark):
    assert spark_spans(spark, ["aaaa", "aaa"], "aa") == [(0, 0, 0, 2), (0, 1, 2, 4), (1, 0, 0, 2)]


def test_offsets_are_characters_not_bytes(spark):
    assert spark_spans(spark, ["ééxé"], "x") == [(0, 0, 2, 3)]


def test_case_sensitive(spark):
    assert spark_spans(spark, ["The the THE"], "the") == [(0, 0, 4, 7)]


def test_empty_needle_gives_no_rows(spark):
    assert spark_spans(spark, ["abc"], "") == []


def test_null_text_gives_no_rows(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert text.find_spans(df, "doc_id", "text", "a").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab.\\E é", max_size=30), min_size=1, max_size=6),
       st.text(alphabet="ab.\\E é", min_size=1, max_size=3))
def test_matches_plain_scan(spark, docs, needle):
    assert spark_spans(spark, docs, needle) == brute(docs, needle)


def test_highlight_then_clear_round_trips(spark):
    docs = ["the theme", "nothing", "", "th th"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = df.select("doc_id", "text", text.highlight("text", "th").alias("m"))
    out = out.select("doc_id", "text", "m", text.clear_marks("m").alias("c")).orderBy("doc_id").collect()
    assert out[0]["m"] == "<mark>th</mark>e <mark>th</mark>eme"
    assert out[3]["m"] == "<mark>th</mark> <mark>th</mark>"
    assert all(r["c"] == r["text"] for r in out)


def test_highlight_marks_same_spans_as_find(spark):
    docs = ["aaaa aa", "xaax"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    marked = [r[0] for r in df.orderBy("doc_id").select(text.highlight("text", "aa")).collect()]
    assert marked[0].count("<mark>") == len(scan_spans(docs[0], "aa")) == 3
    assert marked[1] == "x<mark>aa</mark>x"


def test_text_holding_marks_does_not_round_trip(spark):
    """A text that already holds a mark loses it on clearing: T3(T2(x)) = x
    only for texts without marks."""
    df = spark.createDataFrame([(1, "a <mark>th</mark> b th")], "doc_id long, text string")
    r = df.select(text.clear_marks(text.highlight("text", "th")).alias("c"), "text").first()
    assert r["c"] == "a th b th" and r["c"] != r["text"]


def test_dense_needle_and_long_texts(spark):
    docs = ["t" * 5000, "th" * 40_000, "word the other " * 7000, "é𝒳" * 3000 + "t"]
    for needle in ("t", "th", "é"):
        assert spark_spans(spark, docs, needle) == brute(docs, needle), needle


def test_running_sums_over_block_edges(spark, monkeypatch):
    for block in (2, 3, 32):
        monkeypatch.setattr(text, "BLOCK", block)
        data = [(n, [(i * 7) % 5 for i in range(n)]) for n in (0, 1, 2, 3, 4, 8, 9, 27, 31, 32, 33, 64, 65, 1024, 1025, 1500)]
        df = spark.createDataFrame(data, "n int, a array<bigint>")
        for levels in (0, 1, 2, 3):
            out = dict(rows(df.select("n", text.running_sums(F.col("a"), levels).alias("s"))))
            assert out == {n: [sum(a[:i + 1]) for i in range(n)] for n, a in data}, (block, levels)
