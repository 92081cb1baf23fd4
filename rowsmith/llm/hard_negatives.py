"""Hard negatives by Strassen products of anchor and candidate tiles.

Every row is a candidate; the rows whose id is divisible by ``every`` are the
anchors, a stated query set. A row's score for an anchor is the integer inner
product of the two vectors. An anchor's positives are its ``n_positives`` best
other rows of the same label; for each positive, its hard negatives are the
``n_negatives`` best rows of another label whose score lies between 50 and 95 %
of the positive's (a negative positive score has no such rows, 0 only 0).
Higher scores come first, ties by smaller id.

How it runs: anchors are read as a stream and dealt into blocks of
``BLOCK_BYTES``, of which the driver holds one. A block goes to all tasks, and each
task multiplies it with the candidates it reads, tile by tile, in int64:
``strassen`` halves both matrices, pads odd sides with zeros, and takes
7 products and 18 additions of integers instead of 8 products, down to ``LEAF``.
Two's-complement arithmetic is exact modulo 2^64, so
intermediate sums may wrap and the product is still exact where it fits 64 bits.
A first pass keeps a heap of the best positives of each anchor, a second one a heap
of the best negatives of each (anchor, positive) window. Heaps of tiles and
tasks merge by the same order, so a task sends some rows an anchor,
never a row a pair. Candidates are not shuffled.

A row with a null id, a null label, a null vector, or a null or non-finite
component takes no part. A vector shorter than another is padded with zeros, an
empty one scores 0. An anchor's id never names its own positive; otherwise a repeated row counts
each time it comes, as an anchor too. Fewer rows than asked for are all returned. A score that does not
fit 64 bits raises ``OverflowError``. Without anchors the result is empty. Only the named
columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowsmith.llm.common import slices, table
from rowsmith.session import scratch_path

POSITIVES = 5
NEGATIVES = 3
#: Vectors of a block of anchors.
BLOCK_BYTES = 16 << 20
ANCHOR_TILE = 128
CANDIDATE_TILE = 512
#: Strassen's recursion ends where a side is this short.
LEAF = 32
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, modulo 2^64 (exact where the entries fit)."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    p, q, r = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * p, 2 * r), np.int64)
    out[:p, :r] = m1 + m4 - m5 + m7
    out[:p, r:] = m3 + m5
    out[p:, :r] = m2 + m4
    out[p:, r:] = m1 - m2 + m3 + m6
    return out[:m, :n]


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``c``, or ``OverflowError``."""
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    most = np.abs(a.astype(np.float64)).sum(axis=1).max() * np.abs(c.astype(np.float64)).max()
    if most >= 2.0 ** 62 and np.abs(a.astype(np.float64) @ c.T.astype(np.float64)).max() >= 2.0 ** 62:
        raise OverflowError("an inner product does not fit 64 bits")
    return strassen(a, np.ascontiguousarray(c.T))


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and int64 vectors floor(256 x) of the rows that take part; short vectors padded with zeros."""
    batch = batch.filter(pc.and_(batch.column(0).is_valid(), pc.and_(batch.column(1).is_valid(), batch.column(2).is_valid())))
    lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = batch.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not a number here
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.ones(len(lengths), bool)
    good[row[~np.isfinite(x)]] = False
    x = np.floor(256.0 * x)
    column = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = good[row]
    if kept.any() and np.abs(x[kept]).max() >= 2.0 ** 62:
        raise OverflowError("a component does not fit 64 bits")
    matrix = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)
    matrix[row[kept], column[kept]] = x[kept].astype(np.int64)
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return ids[good], labels[good], matrix[good]


class Heaps:
    """The best ``k`` (score, id) of each slot; they merge in any order to the same content."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.full = np.full(slots, _LEAST)  # a slot's k-th best score, once it has k
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))  # ~score falls as the score rises, without overflow
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate((first, [len(slot)]))))
        keep, last = rank < self.k, rank == self.k - 1
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        self.full[slot[last]] = score[last]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.slot, self.score, self.id)], names=["slot", "score", "id"])


def _tiles(batches, vectors: np.ndarray) -> Iterator[tuple]:
    """(first anchor, scores, candidate ids, candidate labels) of every pair of tiles."""
    for batch in slices(batches, CANDIDATE_TILE):
        ids, labels, matrix = usable(batch)
        if len(ids):
            for at in range(0, len(vectors), ANCHOR_TILE):
                yield at, scores(vectors[at:at + ANCHOR_TILE], matrix), ids, labels


def _merged(df: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each slot of all tasks' heaps, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_positives(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(slot = number of the anchor in its block, score, id, rank)."""
    def run(batches):
        heaps = Heaps(len(ids), k)
        for at, score, other, label in _tiles(batches, vectors):
            mine = slice(at, at + len(score))
            a, c = np.nonzero((labels[mine, None] == label) & (ids[mine, None] != other) & (score >= heaps.full[mine, None]))
            heaps.add(a + at, score[a, c], other[c])
        yield heaps.batch()

    return _merged(rows.mapInArrow(run, "slot long, score long, id long"), k)


def best_negatives(rows: DataFrame, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """(slot = anchor * positives + positive, score, id, rank) within ``low`` to ``high`` (anchors x positives)."""
    width = low.shape[1]

    def run(batches):
        heaps = Heaps(low.size, k)
        for at, score, other, label in _tiles(batches, vectors):
            mine = slice(at, at + len(score))
            foreign = labels[mine, None] != label
            least = np.maximum(low, heaps.full.reshape(low.shape))[mine]
            found = []
            for j in range(width):
                a, c = np.nonzero(foreign & (score <= high[mine, j, None]) & (score >= least[:, j, None]))
                found.append(((a + at) * width + j, score[a, c], other[c]))
            heaps.add(*(np.concatenate(x) for x in zip(*found)))
        yield heaps.batch()

    return _merged(rows.mapInArrow(run, "slot long, score long, id long"), k)


def anchor_blocks(rows: DataFrame, every: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors' ids, labels and vectors, in blocks of ``BLOCK_BYTES``."""
    def pack(batches):
        for batch in slices(batches):
            ids, labels, matrix = usable(batch)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array([r.tobytes() for r in matrix], pa.binary())],
                                             names=["id", "label", "vector"])

    def block(held):
        width = max(len(v) for *_, v in held)
        return (np.array([i for i, *_ in held], np.int64), np.array([x for _, x, _ in held], np.int64),
                np.array([np.frombuffer(v.ljust(width, b"\0"), np.int64) for *_, v in held]).reshape(len(held), width // 8))

    held, size = [], 0
    for r in rows.where(F.col("id") % every == 0).mapInArrow(pack, "id long, label long, vector binary").toLocalIterator():
        if held and size + len(r.vector) > BLOCK_BYTES:
            yield block(held)
            held, size = [], 0
        held.append((r.id, r.label, bytes(r.vector)))
        size += len(r.vector) + 64
    if held:
        yield block(held)


def window_of(positive: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest scores with 50 p <= 100 s <= 95 p; an empty window where there is no positive."""
    low = positive // 2 + positive % 2
    high = positive + (-positive) // 20
    return np.where(there, low, 1), np.where(there, high, 0)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, every: int = 50, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """The hard negatives of every anchor and positive (columns of ``RESULT``).

    The rows are read twice for each block of anchors, and once for the anchors.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    parts = []
    for ids, labels, vectors in anchor_blocks(rows, every):
        best = np.zeros((3, len(ids), n_positives), np.int64)  # score, id, whether there is one
        # some rows an anchor of this block
        for r in best_positives(rows, ids, labels, vectors, n_positives).collect():
            best[:, r.slot, r.rank - 1] = r.score, r.id, 1
        low, high = window_of(best[0], best[2] > 0)
        found = best_negatives(rows, labels, vectors, low, high, n_negatives)
        known = spark.createDataFrame(pa.table({"slot": np.arange(low.size), "anchor_id": np.repeat(ids, n_positives),
                                                "positive_id": best[1].ravel(), "positive_score": best[0].ravel()}))
        path = scratch_path(spark, "hard_negatives")
        (found.join(F.broadcast(known), "slot")
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score")).write.parquet(path))
        parts.append(path)
    return spark.read.schema(RESULT).parquet(*parts) if parts else spark.createDataFrame([], RESULT)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in ``embeddings``; every seventh row is first given the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"))


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, c.r AS cr, c.vec_id, c.label, list_inner_product(a.e, c.e)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.r <> c.r),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS p
    FROM scored WHERE label = al AND vec_id <> anchor_id) WHERE p <= {POSITIVES})
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.ar, p.p ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n ON n.ar = p.ar AND n.label <> n.al AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
WHERE rank <= {NEGATIVES}
"""
