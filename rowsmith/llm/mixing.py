"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' content of a tree domain - language - source. A
token budget flows down from the root by the weights of the children. A child
that has too few tokens (even when repeated for ``max_epochs``) gets all it
has, and what it lacks goes to its siblings by their weights; only what a
whole subtree lacks goes to the subtree's siblings, because a node's capacity
is the sum of its children's. Each leaf then takes whole epochs of its
documents and, of one more epoch, a prefix in seeded order: the documents in
order of md5(seed : epoch : id) for as long as their tokens fit.

The prefix needs no sorted leaf. Tokens are summed by the first three hex
digits of the order key; one block of a leaf holds the cut, and only the keys
of that block are sorted. Each leaf's cut key then goes to all tasks, and the
documents themselves never move.

A null domain, language or source is the value '' (shared with the empty
string). A null or empty text has no tokens and is taken wherever its key lies
in the prefix. Documents with equal ids have equal keys: they are taken or
left together. An empty table gives an empty result. Columns of the input are
kept as one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowsmith.llm.common import WORD_PATTERN, stored, table

LEAF = ["domain", "lang", "source"]
#: Up to so many leaves go to every task, at under 200 bytes each.
MAX_BROADCAST_LEAVES = 200_000

# The mix of the catalogued query: weights by name, ``DEFAULT_WEIGHT`` for all other names.
DOMAIN_WEIGHTS = {"prose": 9, "tables": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2}
SOURCE_WEIGHTS = {"src0": 6}
DEFAULT_WEIGHT = 1
SEED = 20
MAX_EPOCHS = 4
BUDGET_PERCENT = 100


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def domain_of(text: Column) -> Column:
    """Domain of a test document: rows of cells or running prose."""
    return F.when(F.contains(text, F.lit(" | ")), "tables").otherwise("prose")


def fill(nodes: DataFrame, parents: list[str], child: str, budget: str) -> DataFrame:
    """Share ``budget`` (equal in all rows of a parent) among children with ``weight`` and ``cap``; adds ``share``.

    Children in order of cap per weight: a child is filled to its cap if an
    even rise of all that are left would pass it; the others split the rest
    by weight (whole tokens, rounded down).
    """
    w = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), child)
    all_of = Window.partitionBy(*parents)
    big = "decimal(20,0)"
    nodes = (nodes.withColumn("left", (F.col(budget) - F.coalesce(
                 F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast(big))
             .withColumn("weights", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(12,0)"))
             .withColumn("full", F.col("cap").cast(big) * F.col("weights")
                         <= F.col("left") * F.col("weight").cast("decimal(10,0)"))
             .withColumn("rest", F.max(F.when(~F.col("full"), F.col("left"))).over(all_of))
             .withColumn("rest_weights", F.max(F.when(~F.col("full"), F.col("weights"))).over(all_of)))
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(
        F.expr("cast((rest * cast(weight as decimal(10,0))) div rest_weights as bigint)"))
    ).drop("left", "weights", "full", "rest", "rest_weights")


def budgets(leaves: DataFrame, domain_weights: dict, lang_weights: dict, source_weights: dict,
            budget_percent: int, max_epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``budget``, the tokens each is to give."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    domains = (caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
               .withColumn("weight", weight_of(F.col("domain"), domain_weights)).withColumn("root", F.lit(0))
               .withColumn("all", F.expr(f"(sum(tokens) over (partition by root) * {int(budget_percent)}) div 100")))
    domains = fill(domains, ["root"], "domain", "all").select("domain", F.col("share").alias("of_domain"))
    langs = (caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
             .withColumn("weight", weight_of(F.col("lang"), lang_weights)))
    langs = fill(langs, ["domain"], "lang", "of_domain").select("domain", "lang", F.col("share").alias("of_lang"))
    found = caps.join(langs, ["domain", "lang"]).withColumn("weight", weight_of(F.col("source"), source_weights))
    return fill(found, ["domain", "lang"], "source", "of_lang").select(*LEAF, "tokens", F.col("share").alias("budget"))


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"),
                          F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, domain: Column, lang: Column, source: Column, doc_id: Column, text: Column,
        domain_weights: dict, lang_weights: dict, source_weights: dict, budget_percent: int = BUDGET_PERCENT,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The chosen documents, one row for each epoch they are taken in: ``row`` (all of the input's columns),
    domain, lang, source, tokens, epoch."""
    if budget_percent < 0 or max_epochs < 1:
        raise ValueError("budget_percent must not be negative and max_epochs at least 1")
    for name, w in {**domain_weights, **lang_weights, **source_weights}.items():
        if w < 1:
            raise ValueError(f"the weight of {name!r} must be a whole number from 1 on")
    spark = docs.sparkSession
    blank = F.lit("")
    based = docs.select(F.struct("*").alias("row"), F.coalesce(domain, blank).alias("domain"),
                        F.coalesce(lang, blank).alias("lang"), F.coalesce(source, blank).alias("source"),
                        doc_id.alias("id"),
                        F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("tokens"))
    slim = stored(based.drop("row"), "mixing_tokens")
    leaves = slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    leaves = stored(budgets(leaves, domain_weights, lang_weights, source_weights, budget_percent, max_epochs)
                    .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
                    .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mixing_budgets")

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df
    few = leaves.count() <= MAX_BROADCAST_LEAVES

    keyed = slim.join(sent(leaves.select(*LEAF, "epochs", "rest")), LEAF).select(
        *LEAF, "rest", "tokens", _key(F.col("epochs"), F.col("id"), seed).alias("key"))
    blocks = keyed.groupBy(*LEAF, "rest", F.substring("key", 1, 3).alias("block")).agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*LEAF).orderBy("block")
    # the block of each leaf in which the prefix ends, with what is left for it
    edge = (blocks.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens"))
            .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest")))
            .select(*LEAF, "block", (F.col("rest") - F.col("before")).alias("room")))
    edge = stored(edge, "mixing_edges")
    keys = (keyed.withColumn("block", F.substring("key", 1, 3)).join(sent(edge), [*LEAF, "block"])
            .groupBy(*LEAF, "block", "room", "key").agg(F.sum("tokens").alias("tokens")))
    upto = Window.partitionBy(*LEAF).orderBy("key")
    last = (keys.withColumn("with", F.sum("tokens").over(upto)).where(F.col("with") <= F.col("room"))
            .groupBy(*LEAF).agg(F.max("key").alias("last")))
    # without an edge the whole epoch fits; without a fitting key in the edge's block, the prefix ends before it
    cut = (leaves.join(edge, LEAF, "left").join(last, LEAF, "left")
           .select(*LEAF, "epochs", F.coalesce("last", "block", F.lit("g")).alias("cut")))
    cut = stored(cut, "mixing_cuts")
    copies = F.col("epochs") + F.when(_key(F.col("epochs"), F.col("id"), seed) <= F.col("cut"), 1).otherwise(0)
    return (based.join(sent(cut), LEAF).withColumn("copies", copies.cast("int")).where("copies > 0")
            .select("row", *LEAF, "tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix of the catalogued query over a documents table."""
    return mix(docs, domain_of(docs["text"]), docs["lang"], docs["source"], docs["doc_id"], docs["text"],
               DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for a training set of as many tokens as the table has, by the target weights."""
    return mix_documents(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), *LEAF, "tokens", "epoch")


def _case(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT_WEIGHT} END"


def _fill_sql(name: str, source: str, parents: str, child: str, budget: str) -> str:
    return f"""{name}_a AS (SELECT *, {budget} - coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap::DOUBLE / weight, {child}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(weight) OVER (PARTITION BY {parents}
    ORDER BY cap::DOUBLE / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {source}),
{name}_b AS (SELECT *, cap::HUGEINT * ws <= lft::HUGEINT * weight AS filled FROM {name}_a),
{name}_c AS (SELECT *, max(CASE WHEN NOT filled THEN lft END) OVER (PARTITION BY {parents}) AS rst,
    max(CASE WHEN NOT filled THEN ws END) OVER (PARTITION BY {parents}) AS rws FROM {name}_b),
{name} AS (SELECT *, CASE WHEN filled THEN cap ELSE (rst::HUGEINT * weight) // rws END::BIGINT AS share FROM {name}_c)"""


OP5_SQL = f"""
WITH based AS (
  SELECT doc_id, CASE WHEN contains(text, ' | ') THEN 'tables' ELSE 'prose' END AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {MAX_EPOCHS})::BIGINT AS cap FROM based GROUP BY ALL),
d0 AS (SELECT domain, sum(cap)::BIGINT AS cap, {_case('domain', DOMAIN_WEIGHTS)} AS weight, 0 AS root,
    (SELECT (sum(tokens) * {BUDGET_PERCENT} // 100)::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain),
{_fill_sql('d', 'd0', 'root', 'domain', 'budget')},
l0 AS (SELECT domain, lang, sum(leaves.cap)::BIGINT AS cap, {_case('lang', LANG_WEIGHTS)} AS weight, any_value(d.share) AS budget
    FROM leaves JOIN d USING (domain) GROUP BY domain, lang),
{_fill_sql('l', 'l0', 'domain', 'lang', 'budget')},
s0 AS (SELECT domain, lang, source, tokens, leaves.cap, {_case('source', SOURCE_WEIGHTS)} AS weight, l.share AS budget
    FROM leaves JOIN l USING (domain, lang)),
{_fill_sql('s', 's0', 'domain, lang', 'source', 'budget')},
cuts AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs,
    share - CASE WHEN tokens > 0 THEN (share // tokens) * tokens ELSE 0 END AS rest FROM s),
keyed AS (SELECT based.*, epochs, rest, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS k
    FROM based JOIN cuts USING (domain, lang, source)),
taken AS (SELECT *, epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest THEN 1 ELSE 0 END AS copies
    FROM keyed)
SELECT doc_id, domain, lang, source, tokens, unnest(range(copies::BIGINT))::INTEGER AS epoch FROM taken
"""
