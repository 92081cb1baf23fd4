"""Quality classifier: naive-Bayes support vectors.

A document's features are indicators: which character n-grams (one to three
bytes), and which n-grams of word shapes (one to three words; a shape says
whether a word is lower-case, capitalised, upper-case, has digits or signs,
or repeats the word before) occur in it, hashed into a fixed range. Each
indicator is scaled by the log ratio of its smoothed rates in the two
classes, the vector is brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. Margins from cross-validation turn the margin into a
probability.

The fit uses a bounded sample of labelled rows (``max_rows``): of all labels,
chosen by a hash of the id, and of the documents with these ids, chosen by a hash of
the text where an id is held by many. The sample's ids are few enough to send to
all tasks, so no text is shuffled. Scoring reads every whole text, very long ones in
blocks.

A null text counts as empty; an empty text has no features and its score is
that of the bias alone. Ids labelled more than once count once for each
label, and an id that several documents hold once for each different text; a null label or id is not learned from. If only one class is labelled
every score is that class, and without labels it is 0.5. Repeated rows get
equal scores, an empty table gives an empty result. Only id and text are read
for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowsmith.llm.common import slices, stored, table

BITS = 18
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 6000
THRESHOLD = 0.7
_MIX = np.uint32(0x9E3779B1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Kinds of bytes: 1 lower-case or beyond ASCII, 2 upper-case, 4 digit, 8 sign that ends sentences, 16 other sign
_KIND = np.array([0 if _SPACE[b] else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57
                  else 8 if chr(b) in ".,;:'\"()-?" else 16 for b in range(256)], dtype=np.uint8)


def _hash(codes: np.ndarray, salt: int) -> np.ndarray:
    h = (codes.astype(np.uint32) + np.uint32(salt)) * _MIX
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def word_shapes(raw: np.ndarray) -> np.ndarray:
    """One small number for each word: the kinds of bytes in it, a capital first byte, and whether it repeats."""
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint32)
    kinds = np.bitwise_or.reduceat(_KIND[raw], start)
    capital = (_KIND[raw[start]] == 2) & (end - start > 1) & (kinds & 1 > 0)
    where = np.arange(len(raw), dtype=np.uint64)
    value = np.where(_SPACE[raw], 0, (raw.astype(np.uint64) + np.uint64(1)) * (where - np.repeat(
        np.concatenate((start[:1] * 0, start)), np.diff(np.concatenate(([0], start, [len(raw)])))).astype(np.uint64) + np.uint64(3)))
    value = value * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(31)
    word = np.add.reduceat(value, start)
    again = np.concatenate(([False], word[1:] == word[:-1]))
    return kinds.astype(np.uint32) + np.uint32(32) * capital + np.uint32(64) * again


def features(text: str | None, seen: np.ndarray, block: int = 1_000_000) -> np.ndarray:
    """Sorted indices of the indicators that hold for a text. ``seen`` is a scratch array of False, returned as such."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, len(raw), block):
        c = raw[at:at + block + 2].astype(np.uint32)
        seen[_hash(c, 0x1000000)] = True
        two = c[:-1] << np.uint32(8) | c[1:]
        seen[_hash(two, 0x2000000)] = True
        seen[_hash(two[:-1] << np.uint32(8) | c[2:], 0)] = True
    if len(raw):
        s = word_shapes(raw)
        seen[_hash(s, 0x3000000)] = True
        two = s[:-1] << np.uint32(7) | s[1:]
        seen[_hash(two, 0x4000000)] = True
        seen[_hash(two[:-1] << np.uint32(7) | s[2:], 0x5000000)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    weights: np.ndarray  # of each indicator, the naive-Bayes scale included
    scales: np.ndarray  # the naive-Bayes scale alone, for the length of the vector
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(np.sum(self.scales[found] ** 2))) or 1.0
        return float(self.weights[found].sum()) / length + self.bias

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.offset
        return float(1 / (1 + np.exp(-min(max(z, -700.0), 700.0))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of each indicator's smoothed share among label 1 and label 0."""
    p = np.full(1 << BITS, smoothing)
    q = np.full(1 << BITS, smoothing)
    for found, y in zip(rows, labels):
        (p if y > 0 else q)[found] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray,
                            epochs: int = 40, seed: int = 3, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model: weights and bias (an extra feature of value 1). ``cost`` bounds each row's dual."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            y, at, v = labels[i], rows[i], values[i]
            gradient = y * (float(w[at] @ v) + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                step = (new - alpha[i]) * y
                alpha[i] = new
                w[at] += step * v
                bias += step
        if worst < tolerance:
            break
    return w, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the probability of label 1: damped Newton steps on the smoothed likelihood."""
    ones, zeros = int((labels > 0).sum()), int((labels <= 0).sum())
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float((np.logaddexp(0, z) - target * z).sum()) + 1e-4 * a * a

    a, b = 0.0, float(np.log((ones + 1) / (zeros + 1)))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - target) * margins).sum() + 2e-4 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins * margins).sum() + 2e-4, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step, size, before = np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-8 and loss(a - size * step[0], b - size * step[1]) > before:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if size <= 1e-8 or np.abs(size * step).max() < 1e-6:
            break
    return max(0.0, float(a)), float(b)


def _fit_margins(rows: list[np.ndarray], labels: np.ndarray, c: float) -> Model:
    scales = log_count_ratios(rows, labels)
    values = [scales[f] / (np.sqrt(np.sum(scales[f] ** 2)) or 1.0) for f in rows]
    share = np.where(labels > 0, (labels > 0).mean(), (labels <= 0).mean())
    w, bias = dual_coordinate_descent(rows, values, labels, c * 0.5 / share)  # both classes weigh the same
    return Model(w * scales, scales, bias, 1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, folds: int = 3) -> Model:
    """Model of indicator rows with labels +1 and -1, calibrated on margins that each fold gets from the other folds."""
    if not len(labels) or len(np.unique(labels)) < 2:
        empty = np.zeros(1 << BITS)
        return Model(empty, empty, 0.0, 0.0, 0.0 if not len(labels) else 30.0 * int(labels[0]))
    model = _fit_margins(rows, labels, c)
    fold = np.empty(len(labels), dtype=np.int64)
    for y in (1, -1):  # every fold has both classes wherever there are enough rows
        own = np.flatnonzero(labels == y)
        fold[own] = np.arange(len(own)) % folds
    margins = np.array([model.margin(f) for f in rows])
    for k in range(folds):
        rest, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(np.unique(labels[rest])) == 2:
            part = _fit_margins([rows[i] for i in rest], labels[rest], c)
            margins[held] = [part.margin(rows[i]) for i in held]
    model.slope, model.offset = fit_sigmoid(margins, labels)
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(found: indices, label) of at most ``max_rows`` labelled documents.

    The first ``max_rows`` labels by a hash of the id; if several documents hold one of these ids, the first ``max_rows`` of all of
    them, by a hash of id, text and label, different texts counted once.
    """
    order = F.xxhash64(id_col, F.lit(11))
    few = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), order.alias("o"))
           .orderBy("o", "id", "label").limit(max_rows).select("id", "label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # a hash of the text stands for it, so no text is shuffled
    texts = texts.withColumn("t", F.xxhash64("text", F.lit(13)))
    keys = (texts.join(F.broadcast(few), "id").select("id", "t", "label").distinct()
            .orderBy(F.xxhash64("id", "t", "label", F.lit(12)), "id", "t", "label").limit(max_rows))
    keys = stored(keys, "quality_keys")
    rows = texts.join(F.broadcast(keys), ["id", "t"]).select("id", "t", "label", "text")

    def run(batches):
        seen, done = np.zeros(1 << BITS, dtype=bool), set()
        for batch in slices(batches):
            at = []  # one row of each key: a task sends max_rows at most, however often a row is repeated
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if key not in done:
                    done.add(key)
                    at.append(i)
            one = batch.take(pa.array(at, pa.int32()))
            found = [features(t.as_py(), seen).astype(np.int32) for t in one.column(3)]
            yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["id", "t", "label", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, t long, label int, found array<int>").dropDuplicates(["id", "t", "label"]).select("found", "label")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = MAX_ROWS) -> Model:
    """A model from a bounded sample of the labelled documents."""
    sample = stored(labelled_rows(docs, labels, id_col, text_col, label_col, max_rows), "quality_sample").toArrow()
    found = [f.values.to_numpy() for f in sample["found"]]
    label = np.where(sample["label"].to_numpy() == 1, 1, -1)
    # a fixed order whatever the partitioning, so that equal input gives an equal model
    order = sorted(range(len(found)), key=lambda i: (len(found[i]), found[i].tobytes(), label[i]))
    return fit([found[i] for i in order], label[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id and the probability of label 1."""
    # at most 4 MB; plain arrays, because a broadcast value is unpickled without this module
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.scales, model.bias, model.slope, model.offset))

    def run(batches):
        fitted, seen = Model(*sent.value), np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            scores = [fitted.score(features(t.as_py(), seen)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~is_held_out(F.col("doc_id")))
    return score(docs, learn(docs, labels)).select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
