"""Ranked lexical search by dense blocked matrix products.

Queries (items) are ranked against all documents with an integer BM25-like
score. A term is a maximal run of ASCII letters, digits and characters beyond
ASCII, A-Z lower-cased. Of N documents with terms, L terms in all and n terms
in one document, a term in df documents weighs
``floor(1000 * ln((2N + 2) / (2 df + 1)))``; with tf occurrences in the document
its impact is ``(1000000000 tf) div (1000 tf + 8 m)``, m = 10 + (90 n N) div L.
A document's score sums weight * impact over the item's terms, once each.

How it runs:

1. Items are read as a stream and dealt into blocks whose distinct terms, one
   item after the other, number at most ``BLOCK_TERMS``; the driver holds one
   block. One pass over all whole texts keeps, per document, n and the
   (term, tf) pairs of the block's vocabulary, as a stored table of numbers.
2. N, L and df are sums over that table.
3. Every task multiplies tiles: items in groups of ``ITEM_TILE`` with a
   vocabulary of their own (compact: only the terms these items have), documents
   in groups of ``DOC_TILE``. A tile of document impacts (float64) times a tile
   of item weights (float64) goes through BLAS. A vocabulary tile ends before
   the sum of its weights times the largest impact reaches 2^53, so every partial sum is
   an integer that float64 holds exactly, in any order of additions; partial sums
   are added up in int64.
4. Each tile product gives an item's best ``k`` documents, merged with those of
   the tiles before: whatever is not below the k-th best score stays in until
   equal scores are settled by doc_id. Tasks send at most k rows an item; these are
   merged in two steps, so no task merges more than its share.

A null or empty text, of a document or an item, has no terms and no rows.
Very long texts are read whole, folded a megabyte at a time. A repeated
document is a document each time; a document without an id comes last among
equal scores. Rows of one item_id (null included) are one item with the terms of all of
them. With no documents or no items the result is empty. Only the named
columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowsmith.llm.common import slices, stored, table
from rowsmith.session import scratch_path

K = 10
#: Distinct terms of all items of a block, and so the size of the dictionary a task holds.
BLOCK_TERMS = 200_000
ITEM_TILE = 256
DOC_TILE = 512
#: Columns of a vocabulary tile.
TERM_TILE = 2048
#: tf / (tf + something positive) scaled by a million: no impact reaches this.
MAX_IMPACT = 1_000_000
#: Pieces of a text that are folded at a time.
_PIECE = 1 << 20

# Bytes of terms stay (A-Z lower-cased), all others become spaces.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


def fold_terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of ``text`` as UTF-8, piece by piece; pieces end where a term does."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[dict]:
    """Blocks of whole items: {item id: set of terms}, at most ``BLOCK_TERMS`` distinct terms a block (one item at least).

    Rows are streamed ordered by item id, so the rows of one item come together and the driver holds one block.
    """
    block: dict = {}
    seen: set[bytes] = set()
    rows = (items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
            .orderBy(F.col("i").asc_nulls_first()).toLocalIterator())
    for item, text in rows:
        terms = set().union(*fold_terms(text))
        if block and item not in block and len(seen | terms) > BLOCK_TERMS:
            yield block
            block, seen = {}, set()
        block[item] = block.get(item, set()) | terms
        seen |= terms
    if block:
        yield block


def block_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document with terms: id, n (all its terms), and the numbers and occurrences of its vocabulary terms."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        get = vocabulary.get
        for batch in slices(batches):
            ids, ns, ends, terms, tfs = [], [], [0], [], []
            for at, text in enumerate(batch.column(1)):
                n, found = 0, Counter()
                for part in fold_terms(text.as_py()):
                    n += len(part)
                    for term, tf in Counter(part).items():
                        number = get(term)
                        if number is not None:
                            found[number] += tf
                if n:
                    ids.append(at)
                    ns.append(n)
                    terms.extend(found.keys())
                    tfs.extend(found.values())
                    ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(ns, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], names=["doc", "n", "terms", "tfs"])

    return (docs.select(id_col, F.col(text_col).cast("string"))
            .mapInArrow(run, f"doc {id_type}, n long, terms array<int>, tfs array<int>"))


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemTiles:
    """The items of a block as tiles of ``ITEM_TILE``: each with its compact vocabulary, cut into vocabulary tiles."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.n_items, self.n_terms = len(items), len(weights)
        self.tiles = []
        for start in range(0, len(items), ITEM_TILE):
            group = items[start:start + ITEM_TILE]
            own = np.unique(np.concatenate([np.asarray(x, np.int64) for x in group] or [np.empty(0, np.int64)]))
            own = own[weights[own] > 0]
            column = np.full(self.n_terms, -1, np.int32)
            column[own] = np.arange(len(own))
            pairs = [(column[t], j) for j, x in enumerate(group) for t in x if column[t] >= 0]
            cols, rows = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
            self.tiles.append((start, len(group), own, cols, rows, self.cuts(weights[own]), weights[own].astype(np.float64)))

    @staticmethod
    def cuts(weights: np.ndarray) -> list[tuple[int, int]]:
        """Vocabulary tiles: at most ``TERM_TILE`` columns, weights * MAX_IMPACT below 2^53 in sum."""
        out, at = [], 0
        total = np.cumsum(weights)
        limit = (2 ** 53 - 1) // MAX_IMPACT
        while at < len(weights):
            before = total[at - 1] if at else 0
            end = min(at + TERM_TILE, int(np.searchsorted(total, before + limit, side="right")))
            if end == at:
                raise OverflowError("the weight of one term does not fit a partial sum")
            out.append((at, end))
            at = end
        return out

    def scores(self, tile, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int) -> np.ndarray:
        """int64 scores (documents x items of the tile) of a batch of (row, term, impact) triples."""
        _, width, own, cols, of, cuts, weights = tile
        column = np.full(self.n_terms, -1, np.int32)
        column[own] = np.arange(len(own))
        at = column[terms]
        total = np.zeros((n_docs, width), np.int64)
        for low, high in cuts:
            inside = (at >= low) & (at < high)
            if not inside.any():
                continue
            left = np.zeros((n_docs, high - low))
            left[rows[inside], at[inside] - low] = impacts[inside]
            right = np.zeros((high - low, width))
            mine = (cols >= low) & (cols < high)
            right[cols[mine] - low, of[mine]] = weights[cols[mine]]
            total += (left @ right).astype(np.int64)
        return total


class Best:
    """The best ``k`` (score, document) pairs of each item seen so far; equal scores by smaller id, no id last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)  # a score of 0 is no match
        self.item, self.score, self.none, self.doc = (np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, start: int, scores: np.ndarray, none: np.ndarray, docs: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.least[start:start + scores.shape[1]])
        if not len(at):
            return
        item, score = np.concatenate((self.item, item + start)), np.concatenate((self.score, scores[at, item]))
        none, doc = np.concatenate((self.none, none[at])), np.concatenate((self.doc, docs[at]))
        order = np.lexsort((doc, none, -score, item))
        item, score, none, doc = item[order], score[order], none[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.concatenate((first, [len(item)]))))
        keep = rank < self.k
        self.item, self.score, self.none, self.doc = item[keep], score[keep], none[keep], doc[keep]
        last = rank == self.k - 1
        self.least[item[last]] = score[last]


def impacts_of(ns: list[int], rows: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = np.array([10 + 90 * n * n_docs // n_terms for n in ns], np.int64)
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[rows])


def block_best(counts: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best ``k`` documents of each item: (item number, doc, score)."""
    def run(batches):
        tiles, best = ItemTiles(items, weights), Best(len(items), k)
        for batch in slices(batches, DOC_TILE):
            terms, tfs = batch.column(2), batch.column(3)
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            numbers = terms.flatten().to_numpy(zero_copy_only=False)
            impacts = impacts_of(batch.column(1).to_pylist(), rows, tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                 n_docs, n_terms).astype(np.float64)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for tile in tiles.tiles:
                best.add(tile[0], tiles.scores(tile, rows, numbers, impacts, batch.num_rows), none, docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=best.none), pa.array(best.score, pa.int64())],
            names=["item", "doc", "score"])

    return counts.mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", doc_text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best ``k`` documents of each item, of integer ids: (item_id, rank, doc_id, score).

    The texts are read once for each block of items, the stored counts three times.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType.simpleString()
    schema = f"`{item_id}` {item_type}, rank int, `{doc_id}` long, score long"
    parts = []
    for block in item_blocks(items, item_id, item_text):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
        names = [i for i in block if block[i]]
        if not names:
            continue
        counts = stored(block_counts(docs, vocabulary, doc_id, doc_text), "search_counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(vocabulary), np.int64)
        # one row a term of the block, which is bounded
        for term, df in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weights[term] = term_weight(n_docs, df)
        numbers = [[vocabulary[t] for t in block[i]] for i in names]
        found = block_best(counts, numbers, weights, n_docs, n_terms, k)
        order = [F.desc("score"), F.col("doc").asc_nulls_last()]
        # the rows of one item come from all tasks: merged in groups first, then the groups' best
        found = (found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64)))
                 .withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
                 .where(F.col("rank") <= k)
                 .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k))
        named = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"__item long, `{item_id}` {item_type}"))
        path = scratch_path(spark, "search_best")
        (found.join(named, found["item"] == named["__item"]).select(item_id, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score")
         .write.parquet(path))
        parts.append(path)
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every ``benchmark`` item, all ``documents`` ranked."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
stats AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
    FROM tf, stats GROUP BY term, n_docs),
scores AS (SELECT item_id, r, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM tf JOIN weights USING (term) JOIN items USING (term), stats GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= {K}
"""
