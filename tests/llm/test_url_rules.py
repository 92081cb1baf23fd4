from conftest_llm import SMALL, same_as_sql
from rowsmith.llm.url_rules import HOST_RULES, PATTERN_RULES, Rule, judge_urls, rarest_token_index, rule_table

URLS = [None, "", "no scheme/en/", "http://Example.COM/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/x?q=/fr/",
        "http://myexample.com/en/", "http://example.com/EN/", "http://x.net/es/", "http://net/fr/a#b", "http://.com/", "http://com",
        "http://a.com?x=/en/", "https://é.example.com/en/", "http://h.org/login/a/b.php", "http://h.org/login/", "http://big-casinos.org/",
        "http://x-pills.org/", "ftp://x://y.com/", "http://a.com:80/en/", "http://b.example.com/en/" + "y" * 100_000,
        "http://h.org/login/a\nb.php", "http://x.com/", "http://x.com/"]


def brute(url):
    import re
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.verdict
    hit = any(re.search(".*".join(map(re.escape, r.path.split("*"))), host + path, re.S) for r in PATTERN_RULES)
    return host, path, None, "block" if hit else "allow"


def test_edges_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule int".replace("int", "string"))
    out = {r.page_id: r for r in judge_urls(pages, HOST_RULES + PATTERN_RULES).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        r = out[i]
        assert (r.host, r.path, r.rule if r.by_host_rule else None, r.verdict) == brute(u), u
    assert judge_urls(pages.limit(0), HOST_RULES).count() == 0


def test_query_matches_sql(spark):
    assert same_as_sql(spark, "op3_url_rules") == spark.read.parquet(f"{SMALL}/pages.parquet").count()


def test_rarest_literal_is_the_index_key(spark):
    subjects = spark.createDataFrame([("a.example.com/en/1",), ("b.example.com/en/2",), ("c.example.com/x",)], "subject string")
    rules = (Rule("block", "example.com", "/en/"), Rule("block", "", "open"), Rule("allow", "rare.example.com", "/"))
    index = {r.rule: r.token for r in rarest_token_index(subjects, rule_table(spark, rules)).collect()}
    assert index == {"example.com/en/": "en", "open": "", "rare.example.com/": "rare"}


def test_literals_are_whole_tokens():
    assert Rule("block", "", "/ads/*banner-x1.").literals() == ["ads", "x1"]
    assert Rule("block", "h.org", "/a/b").literals() == ["a", "h", "org"]


def test_hot_urls_are_not_shuffled_to_one_task(spark, monkeypatch):
    """Half of all pages without a URL, a sixth with one URL: both are hot, and meet their verdict by broadcast."""
    from pyspark.sql import functions as F
    from rowsmith.operators import skew
    monkeypatch.setattr(skew, "HOT_ROWS", 1000)
    url = F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, "http://example.com/en/x").otherwise(
        F.concat(F.lit("http://h"), F.col("id") % 700, F.lit(".net/es/")))
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), url.alias("url")).repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        judged = judge_urls(pages, HOST_RULES)
        out = {r.page_id: r for r in judged.collect()}
        plan = judged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert len(out) == 12_000 and all(out[i].host == "" and out[i].rule is None and out[i].verdict == "allow" for i in range(0, 12_000, 2))
    assert all((out[i].rule, out[i].verdict) == ("example.com/en/", "block") for i in range(3, 12_000, 6))
    assert all((out[i].rule, out[i].verdict) == ("net/es/", "block") for i in range(1, 12_000, 6))
