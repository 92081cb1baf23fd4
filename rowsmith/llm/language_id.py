"""Language identification with interpolated Kneser-Ney character models.

One model for each language over the letters of its texts (lower-cased, runs
of anything else become one space). Counts of the longest n-grams come from a
bounded sample of labelled rows; shorter orders use continuation counts (in
how many different contexts an n-gram follows). Each order subtracts its own
discount and passes the freed mass to the next shorter one. All this is done
with DataFrame aggregates. All languages that have labelled rows are learned.

Models are built in groups of languages. A group has one array of sorted
64-bit hashes for each order, with a row of log-probabilities (one a language) for
every n-gram that any of its languages has seen, and takes languages until
these rows reach ``GROUP_BYTES``; so the driver and each task hold a bounded
model at a time, however many languages there are. A text is scored by
looking up the hashes of its n-grams; those unknown to all languages of the group fall back
to shorter ones. The language with the lowest cross-entropy a character
wins. With one group that is one pass over the texts without a shuffle; with
more, each group takes a pass and the cross-entropies meet by row.

A part of the sample that gave no counts calibrates the confidence and, for
each language, the cross-entropy above which a text is rejected as none of the
learned languages. A language with fewer than ``CALIBRATE_FROM`` labelled rows
gives all of them to its counts, and has no such limit.

A null text, or one without a letter, is ``und`` with score 0. Very long texts are read
whole, scored in blocks. Rows without a
language are never learned from. If nothing can be learned every row is
``und``. Repeated rows and ties (the first language in order wins) give equal
results. Only the id and the text are read for a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowsmith.llm.common import codepoints, slices, stored, table
from rowsmith.session import small

ORDER = 4
PAD = " " * (ORDER - 1)
#: Labelled rows a language that a model is fitted on.
ROWS_PER_LANGUAGE = 1500
#: Labelled rows a language from which on a fifth of them calibrates.
CALIBRATE_FROM = 24
#: Log-probabilities and back-off weights of a group of languages; one language at least.
GROUP_BYTES = 64 << 20
UNDETERMINED = "und"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_folded: np.ndarray | None = None


def letters_only(points: np.ndarray) -> np.ndarray:
    """Code points lower-cased, each run of others than letters as one space, padded for the first n-gram."""
    global _folded
    if _folded is None:
        _folded = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 32 for i in range(0x10000)], dtype=np.uint32)
    c = _folded[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points >= 0x10000)
    if len(high):  # beyond the basic plane: letters of rare scripts, and signs
        kinds, place = np.unique(points[high], return_inverse=True)
        c[high] = np.array([ord(chr(p).lower()[0]) if chr(p).isalpha() else 32 for p in kinds], dtype=np.uint32)[place]
    space = c == 32
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = c[keep]
    if len(c) and c[0] == 32:
        c = c[1:]
    if len(c) and c[-1] == 32:
        c = c[:-1]
    return np.concatenate((np.full(ORDER - 1, 32, np.uint32), c, np.array([32], np.uint32)))


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each position (the last n - 1 positions have none)."""
    c = points.astype(np.uint64)
    m = len(c) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h = (h + c[k:k + m]) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """For each order n (index n - 1): sorted hashes, log-probabilities, and log back-off weights as a history."""
    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    unseen: np.ndarray  # log-probability of a character that no text had

    def _at(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n - 1]
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return i, keys[i] == h

    def log_probability(self, n: int, grams: list[np.ndarray], pick) -> np.ndarray:
        """Log-probabilities (a row for each n-gram) of the last characters. grams: hashes by order of each
        position in a text; pick: the positions where the n-grams start."""
        if n == 0:
            return np.broadcast_to(self.unseen, (len(pick), len(self.languages)))
        i, known = self._at(n, grams[n - 1][pick])
        out = self.logp[n - 1][i]
        missing = np.flatnonzero(~known)
        if len(missing):
            rest = pick[missing]
            out[missing] = self.log_probability(n - 1, grams, rest + 1)
            if n > 1:
                j, seen = self._at(n - 1, grams[n - 2][rest])
                out[missing] += np.where(seen[:, None], self.back[n - 2][j], 0.0)
        return out

    def cross_entropy(self, points: np.ndarray, block: int = 250_000) -> tuple[np.ndarray, int]:
        """Mean negative log-probability of a character under each language, and the number of characters."""
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(points) - ORDER + 1, block):
            c = points[at:at + block + ORDER - 1]
            grams = [hashes(c, k) if k == ORDER else None for k in range(1, ORDER + 1)]
            pick = np.arange(len(grams[-1]))
            i, known = self._at(ORDER, grams[-1])
            total -= self.logp[ORDER - 1][i[known]].sum(axis=0, dtype=np.float64)
            missing = pick[~known]
            if len(missing):
                grams = [hashes(c, k) for k in range(1, ORDER)] + [grams[-1]]
                total -= self.log_probability(ORDER, grams, missing).sum(axis=0, dtype=np.float64)
            n += len(pick)
        return total / max(1, n), n

    def of_text(self, text: str | None) -> tuple[np.ndarray, int]:
        """``cross_entropy`` of a text; no characters where it has no letter."""
        folded = letters_only(codepoints(text) if text else np.zeros(0, np.uint32))
        if len(folded) <= ORDER or not self.languages:
            return np.zeros(len(self.languages)), 0
        return self.cross_entropy(folded)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The prediction of this group alone, not calibrated."""
        return decide(self.languages, *self.of_text(text), None, 1.0)


def decide(languages: list[str], h: np.ndarray, n: int, limits: np.ndarray | None, sharpness: float) -> tuple[str, float, bool]:
    """Language, confidence in 0..1, and whether the text is rejected as none of the languages."""
    if not n or not languages:
        return UNDETERMINED, 0.0, True
    best = int(np.argmin(h))
    score = float(1 / np.exp(-sharpness * np.minimum(n, 200) * (h - h[best])).sum())
    return languages[best], score, bool(limits is not None and h[best] > limits[best])


@dataclass
class Fitted:
    """All languages, in groups; ``limits`` and ``sharpness`` are of the languages of all groups, in their order."""
    groups: list[Model]
    limits: np.ndarray | None = None  # cross-entropy above which a language is rejected
    sharpness: float = 1.0

    @property
    def languages(self) -> list[str]:
        return [x for g in self.groups for x in g.languages]


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def _bucket(doc_id: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 20))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int) -> DataFrame:
    """About ``rows_per_language`` rows (text, lang, calibrate) of each language, chosen by a hash of the id."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = small(stored(usable.groupBy("lang").agg(F.count("*").alias("n")), "language_rows"))
    rate = F.least(F.lit(1.0), rows_per_language / F.col("n")) * (1 << 20)
    held = (F.col("n") >= CALIBRATE_FROM) & (_bucket(F.col("id"), 2) < (1 << 20) // 5)
    return usable.join(counts, "lang").where(_bucket(F.col("id"), 1) < rate).select("text", "lang", held.alias("calibrate"))


def _count_grams(batches):
    from collections import Counter
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = letters_only(codepoints(text)).tobytes().decode("utf-32-le", "surrogatepass")
            counts = Counter(c[i:i + ORDER] for i in range(len(c) - ORDER + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "c"])


def gram_levels(sample: DataFrame) -> list[DataFrame]:
    """For each order a stored table (lang, gram, p, history, free): ``free`` is the mass that goes to the shorter order."""
    level = stored(sample.where("not calibrate").select("text", "lang").mapInArrow(_count_grams, "lang string, gram string, c long")
                   .groupBy("lang", "gram").agg(F.sum("c").alias("c")), "language_counts")
    levels = [level]
    for _ in range(ORDER - 1):  # continuation counts: different characters before it
        level = level.groupBy("lang", F.expr("substr(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        levels.append(level)
    levels.reverse()
    rows, prob = [], None
    for n, level in enumerate(levels, start=1):
        once = F.sum(F.when(F.col("c") == 1, 1).otherwise(0))
        twice = F.sum(F.when(F.col("c") == 2, 1).otherwise(0))
        discount = level.groupBy("lang").agg(
            F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5).alias("d"), F.count("*").alias("types"))
        history = F.expr(f"substr(gram, 1, {n - 1})").alias("history")
        totals = level.groupBy("lang", history).agg(F.sum("c").alias("total"), F.count("*").alias("t"))
        found = (level.withColumn("history", history).join(totals, ["lang", "history"]).join(F.broadcast(discount), "lang")
                 .withColumn("free", F.col("d") * F.col("t") / F.col("total")))
        if prob is None:
            found = found.withColumn("lower", 1 / (F.col("types") + 1))
        else:
            found = found.join(prob.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower")).withColumnRenamed("lang", "l"),
                               (F.col("lang") == F.col("l")) & (F.expr("substr(gram, 2)") == F.col("shorter")))
        prob = found.withColumn("p", (F.col("c") - F.col("d")) / F.col("total") + F.col("free") * F.col("lower"))
        prob = stored(prob.select("lang", "gram", "p", "history", "free"), "language_model")
        rows.append(prob)
    return rows


def language_groups(levels: list[DataFrame]) -> list[list[str]]:
    """The languages in order, cut where the cells (n-grams of the group times its languages) would exceed ``GROUP_BYTES``."""
    sizes: dict[str, int] = {}
    for level in levels:  # an n-gram has a log-probability and a back-off weight of 4 bytes, and may come as a history too
        for lang, n in level.groupBy("lang").count().collect():
            sizes[lang] = sizes.get(lang, 0) + n
    groups: list[list[str]] = []
    grams = 0
    for lang in sorted(sizes):
        if groups and (grams + sizes[lang]) * 8 * (len(groups[-1]) + 1) <= GROUP_BYTES:
            groups[-1].append(lang)
            grams += sizes[lang]
        else:
            groups.append([lang])
            grams = sizes[lang]
    return groups


def kneser_ney(sample: DataFrame) -> tuple[list[str], list]:
    """Languages, and for each order a pandas frame (lang, gram, p, history, free), of a sample of few languages."""
    levels = gram_levels(sample)
    return _frames(levels, sorted(r[0] for r in levels[0].select("lang").distinct().collect()))


def _frames(levels: list[DataFrame], languages: list[str]) -> tuple[list[str], list]:
    return languages, [level.where(F.col("lang").isin(languages)).toPandas() for level in levels]


def build(languages: list[str], rows: list) -> Model:
    """Sorted hash arrays from the rows of each order."""
    at = {lang: i for i, lang in enumerate(languages)}
    size = rows[0].groupby("lang").size()
    unseen = np.array([-np.log((size[lang] + 1) * 50.0) for lang in languages], dtype=np.float32)
    model = Model(languages, [], [], [], unseen)
    for n, frame in enumerate(rows, start=1):
        # the n-grams of this order and, as n-grams without a probability, those met as histories of the next
        grams = sorted(set(frame["gram"]) | (set(rows[n]["history"]) if n < ORDER else set()))
        points = np.array([[ord(c) for c in g] for g in grams], dtype=np.uint32).reshape(len(grams), n)
        flat = points.reshape(-1)
        every = np.arange(len(grams)) * n
        by_order = [hashes(flat, k) for k in range(1, n + 1)]
        logp = np.empty((len(grams), len(languages)), dtype=np.float32)
        logp[:] = model.log_probability(n - 1, by_order, every + 1)
        if n > 1:
            i, known = model._at(n - 1, by_order[n - 2][every])
            logp += np.where(known[:, None], model.back[n - 2][i], 0.0)
        place = {g: i for i, g in enumerate(grams)}
        cells = (frame["gram"].map(place).to_numpy(), frame["lang"].map(at).to_numpy())
        logp[cells] = np.log(frame["p"].to_numpy())
        back = np.zeros_like(logp)
        if n < ORDER:
            nxt = rows[n].drop_duplicates(["lang", "history"])
            back[nxt["history"].map(place).to_numpy(), nxt["lang"].map(at).to_numpy()] = np.log(nxt["free"].to_numpy())
        order = np.argsort(by_order[n - 1][every], kind="stable")
        model.keys.append(by_order[n - 1][every][order])
        model.logp.append(logp[order])
        model.back.append(back[order])
    return model


def entropies(rows: DataFrame, groups: list[Model], keep: list[str]) -> DataFrame:
    """(keep, n, h: the cross-entropies under all languages) of every row of (text, keep)."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def scored(frame: DataFrame, model: Model, names: list[str], schema: str) -> DataFrame:
        # bounded by GROUP_BYTES; plain arrays, because a broadcast value is unpickled without this module
        sent = frame.sparkSession.sparkContext.broadcast([getattr(model, f.name) for f in fields(model)])

        def run(batches):
            fitted = Model(*sent.value)
            for batch in slices(batches):
                found = [fitted.of_text(t.as_py()) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array([n for _, n in found], pa.int64()),
                     pa.array([h.tolist() for h, _ in found], pa.list_(pa.float64()))], [*names, "n", "h"])

        return frame.mapInArrow(run, f"{schema}, n long, h array<double>")

    if len(groups) == 1:
        return scored(rows.select("text", *keep), groups[0], keep, kinds)
    numbered = stored(rows.select("text", *keep, F.monotonically_increasing_id().alias("__row")), "language_rows")
    parts = None
    for i, model in enumerate(groups):  # one group's model at a time on the tasks
        part = stored(scored(numbered.select("text", "__row"), model, ["__row"], "__row long").withColumn("group", F.lit(i)), "language_entropies")
        parts = part if parts is None else parts.unionByName(part)
    every = parts.groupBy("__row").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("group", "h"))).alias("hs"))
    return (numbered.drop("text").join(every, "__row")
            .select(*keep, "n", F.flatten(F.transform("hs", lambda x: x["h"])).alias("h")))


def calibrate(groups: list[Model], sample: DataFrame, slack: float = 0.25) -> Fitted:
    """Sharpness of the confidence by likelihood, and limits a little above all but the last 0.2 % of own cross-entropies."""
    fitted = Fitted(groups)
    fitted.limits = np.full(len(fitted.languages), np.inf)
    place = {x: i for i, x in enumerate(fitted.languages)}
    grid = 2.0 ** np.arange(-6, 2)

    def run(batches):
        for batch in batches:
            kept = [(place[x], n, np.array(h)) for x, n, h in zip(*(c.to_pylist() for c in batch.columns)) if n]
            losses = [np.log(np.exp(np.minimum(-grid[:, None] * min(n, 200) * (h - h[i]), 50)).sum(axis=1)).tolist() for i, n, h in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in kept], pa.int32()), pa.array([float(h[i]) for i, _, h in kept], pa.float64()),
                 pa.array([n for _, n, _ in kept], pa.int64()), pa.array(losses, pa.list_(pa.float64()))], ["lang", "own", "n", "losses"])

    # a few numbers a calibration row come to the driver
    rows = (entropies(sample.where("calibrate"), groups, ["lang"])
            .mapInArrow(run, "lang int, own double, n long, losses array<double>").toPandas())
    if len(rows):
        fitted.sharpness = float(grid[int(np.argmin(np.array(rows["losses"].tolist()).sum(axis=0)))])
        for i, own in rows[rows["n"] >= 50].groupby("lang")["own"]:
            fitted.limits[i] = own.quantile(0.998) + slack
    return fitted


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE) -> Fitted:
    """Models of all languages of ``docs`` from a bounded sample of each one's rows."""
    sample = stored(labelled_sample(docs, id_col, text_col, lang_col, rows_per_language), "language_sample")
    levels = gram_levels(sample)
    groups = [build(*_frames(levels, languages)) for languages in language_groups(levels)]
    return calibrate(groups, sample) if groups else Fitted([])


def identify(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, lang_pred, score, and rejected (no learned language fits well)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not fitted.groups:
        return rows.select(F.col("id").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(True).alias("rejected"))
    languages, limits, sharpness = fitted.languages, fitted.limits, fitted.sharpness

    def run(batches):
        for batch in batches:
            out = [decide(languages, np.array(h), n, limits, sharpness) for n, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_()))],
                ["id", "lang_pred", "score", "rejected"])

    kind = rows.schema["id"].dataType.simpleString()
    return (entropies(rows, fitted.groups, ["id"]).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
            .withColumnRenamed("id", id_col))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~is_held_out(F.col("doc_id"))))
    return identify(docs, model).select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
