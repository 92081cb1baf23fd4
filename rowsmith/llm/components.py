"""Connected components of an edge list, by alternating star contractions.

Each round ties every vertex's larger neighbours, then its smaller ones, to
the smallest vertex it knows. Only grouped minima and joins on vertices are
used, so a hub with very many edges is pre-aggregated and its join can be
split; every round is written to the shared folder. Nothing is collected but
one digest of the edges a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowsmith.llm.common import stored


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    r = edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor(h)).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    tied = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of all vertices of ``edges`` (columns a, b): the component is its smallest vertex."""
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = _digest(state)
    while digest[0]:
        # of every edge the first vertex is the larger one, before and after
        state = stored(_small_star(_large_star(state)), "edges")
        before, digest = digest, _digest(state)
        if digest == before:
            break
    return (state.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
            .unionByName(state.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct())
