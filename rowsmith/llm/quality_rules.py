"""Quality rules by distribution divergence.

Two passes over the corpus. The first gathers, for each language, the counts
of character classes and of short words over all documents; from these come
the language references: the share of each character class, and the share of
each common word. The second pass holds every document against its nearest
reference with the Jensen-Shannon distance (base 2, so it lies in 0..1). A
distance is judged only where the document is long enough for it to mean
something; shorter documents pass that test.

The references of the main languages (those with a share of all words) are
few and are held against documents of every judged language. A language below
that share that has enough words of its own has a reference too; these may be
many, so they stay in a table that is joined to the documents of their
language, and only those documents are held against them. The same goes for a
word reference without any common word: it is near to all texts without
common words, in whatever language. A document whose language has no
reference, or that has no language, passes both distance tests, because other
languages' shares say nothing about it.

A null text has no words and an empty one neither: both fail the base rule
(fewer than ``min_words`` words). Very long texts are counted whole, one at a time. Repeated rows are judged row by row. An
empty table gives an empty result. ``keep_documents`` returns the input's own
columns only and ``judge`` returns fresh ones next to the id, so extra
columns of any name do no harm. A null language counts towards no reference.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsmith.llm.common import codepoints, stored, table

# The character classes of the histograms.
CLASSES = ("lower", "upper", "other letter", "digit", "space", "sentence mark", "other sign")
SENTENCE_MARKS = ".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Limits:
    """What a document may show.

    ``max_class_distance`` and ``max_word_distance`` bound the Jensen-Shannon
    distance of its character classes and its common words to the nearest
    language reference; they are judged from ``min_chars`` characters and
    ``min_hist_words`` words on.
    """
    min_words: int = 50
    max_repeat_percent: int = 50
    min_chars: int = 200
    min_hist_words: int = 100
    max_class_distance: float = 0.28
    max_word_distance: float = 0.32


@dataclass(frozen=True)
class References:
    """Per main language: shares of the classes, the common words, and their shares (last: all other words).

    ``others`` has a row (lang, total, found) for each further language with a reference, ``found`` being its class
    and common word counts; None if there is none.
    """
    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, tuple[list[str], np.ndarray]] = field(default_factory=dict)
    others: DataFrame | None = None


_class_table: np.ndarray | None = None


def _classes_of(points: np.ndarray) -> np.ndarray:
    global _class_table
    if _class_table is None:
        def kind(c: str) -> int:
            if c.islower():
                return 0
            if c.isupper():
                return 1
            if c.isalpha():
                return 2
            if c.isdigit():
                return 3
            if c.isspace():
                return 4
            return 5 if c in SENTENCE_MARKS else 6
        _class_table = np.array([kind(chr(i)) for i in range(0x10000)], dtype=np.int8)
    # beyond the basic plane: scripts and signs alike count as other letters
    return np.where(points < 0x10000, _class_table[np.minimum(points, 0xFFFF)], 2)


def class_counts(text: str) -> np.ndarray:
    return np.bincount(_classes_of(codepoints(text)), minlength=len(CLASSES)).astype(np.int64)


def letter_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (square root of the divergence, base 2) of two share vectors."""
    m = (p + q) / 2

    def kl(a):
        on = a > 0
        return float(np.sum(a[on] * np.log2(a[on] / m[on])))
    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def _reference_counts(max_letters: int, flush_at: int = 200_000):
    def run(batches):
        counts: Counter = Counter()

        def emit():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
                ["lang", "kind", "key", "n"])
            counts.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                if lang is None or not text:
                    continue
                for i, n in enumerate(class_counts(text).tolist()):
                    counts[lang, "class", str(i)] += n
                words = letter_words(text)
                counts[lang, "words", ""] += len(words)
                for w, n in Counter(w for w in words if len(w) <= max_letters).items():
                    counts[lang, "word", w] += n
                if len(counts) > flush_at:
                    yield emit()
        if counts:
            yield emit()
    return run


def _shares(total: int, found) -> tuple[np.ndarray, tuple[list[str], np.ndarray]]:
    """Class shares, and common words with their shares, from a language's rows (kind, key, n)."""
    classes = np.zeros(len(CLASSES))
    for kind, key, n in found:
        if kind == "class":
            classes[int(key)] = n
    words = sorted((key, n) for kind, key, n in found if kind == "word")
    p = np.array([n for _, n in words], dtype=float) / total
    return classes / classes.sum(), ([w for w, _ in words], np.append(p, max(0.0, 1 - p.sum())))


def learn_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_letters: int = 5,
                     min_share: float = 0.005, min_language_share: float = 0.001,
                     min_language_words: int = 10_000) -> References:
    """Language references from all documents.

    Common words are words of at most ``max_letters`` letters that make up at
    least ``min_share`` of their language's words. Main languages have at
    least ``min_language_share`` of all words. Both bounds follow from shares,
    so at most 1 / share of each can exist and the rows brought to the driver
    are few at any input size. The references of all other languages of at
    least ``min_language_words`` words stay in a stored table, with at most
    ``len(CLASSES)`` + 1 / ``min_share`` counts a language.
    """
    counts = (docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
              .mapInArrow(_reference_counts(max_letters), "lang string, kind string, key string, n long")
              .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    counts = stored(counts, "quality_references")
    totals = counts.where("kind = 'words'").select("lang", F.col("n").alias("total"))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    is_main = F.col("total") >= max(1.0, min_language_share * everything)
    wanted = (F.col("kind") == "class") | ((F.col("kind") == "word") & (F.col("n") >= min_share * F.col("total")))
    rows = (counts.join(F.broadcast(totals.where(is_main)), "lang").where(wanted)
            .select("lang", "kind", "key", "n", "total").collect())
    found: dict[str, list] = {}
    for r in rows:
        found.setdefault(r.lang, [r.total]).append((r.kind, r.key, r.n))
    main = {lang: _shares(total, counted) for lang, (total, *counted) in found.items()}
    further = totals.where(~is_main & (F.col("total") >= max(1, min_language_words)))
    others = None
    if not further.isEmpty():
        # without the main languages no key of the join has more than a small share of the rows
        others = stored(counts.where(~F.col("lang").isin(list(main))).join(further, "lang").where(wanted)
                        .groupBy("lang", "total").agg(F.collect_list(F.struct("kind", "key", "n")).alias("found")),
                        "quality_other_references")
    return References({k: v[0] for k, v in main.items()}, {k: v[1] for k, v in main.items()}, others)


def _base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.translate(None, SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 2_000_000:  # keep the product below 2^63
            pairs = np.unique(pairs, return_inverse=True)[1]
            base = len(pairs)
        else:
            base = len(seen)
        triples = pairs[:-1] * base + ids[2:]
        _, inverse, times = np.unique(triples, return_inverse=True, return_counts=True)
        hot = np.flatnonzero(times[inverse] >= 2)
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[hot + k] = True
        repeated = int(covered.sum())
    return n, word_chars, n_symbols, n_dup_lines, repeated


def judge_text(text: str | None, lang: str | None, refs: References, limits: Limits, own=None):
    """The base counts, base_failed, the two distances (None where not judged) and the verdict of one text.

    ``own`` is the reference of a language that is none of the main ones.
    """
    text = text or ""
    n, word_chars, symbols, dup_lines, repeated = _base(text)
    base_failed = n < limits.min_words or 100 * repeated > limits.max_repeat_percent * n
    class_distance = word_distance = None
    has_reference = own is not None or lang in refs.classes
    if has_reference and len(text) >= limits.min_chars:
        p = class_counts(text) / len(text)
        class_distance = min(distance(p, q) for q in [*refs.classes.values(), *([own[0]] if own else [])])
    found = letter_words(text) if has_reference else []
    if len(found) >= limits.min_hist_words:
        counts = Counter(found)
        best = []
        for words, q in [*(v for k, v in refs.words.items() if v[0] or k == lang), *([own[1]] if own else [])]:
            c = np.array([counts.get(w, 0) for w in words] + [0], dtype=float)
            c[-1] = len(found) - c.sum()
            best.append(distance(c / len(found), q))
        word_distance = min(best)
    kept = not (base_failed or (class_distance or 0) > limits.max_class_distance
                or (word_distance or 0) > limits.max_word_distance)
    return n, word_chars, symbols, dup_lines, repeated, base_failed, class_distance, word_distance, kept


OTHERS = "array<struct<kind: string, key: string, n: long>>"


def _with_references(docs: DataFrame, cols: list, lang_col: str, refs: References) -> DataFrame:
    """The columns ``cols`` as a struct row, with lang, and with total and found of a language in ``refs.others``."""
    rows = docs.select(F.struct(*cols).alias("row"), F.col(lang_col).cast("string").alias("lang"))
    plain = rows.withColumns({"total": F.lit(None).cast("long"), "found": F.lit(None).cast(OTHERS)})
    if refs.others is None:
        return plain
    # rows of the main languages, and those without one, stay where they are
    is_main = F.coalesce(F.col("lang").isin(list(refs.classes)), F.lit(True))
    return plain.where(is_main).unionByName(rows.where(~is_main).join(refs.others, "lang", "left").select(plain.columns))


def _verdicts(refs: References, limits: Limits, at: int):
    """A function that gives the verdict of each row of a batch (row, lang, total, found), the text being field ``at``."""
    own: dict[str, tuple] = {}

    def run(batch):
        text = batch.column(0).field(at)
        for i, (lang, total) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if total is not None and lang not in own:
                if len(own) > 1000:
                    own.clear()
                own[lang] = _shares(total, [(x["kind"], x["key"], x["n"]) for x in batch.column(3)[i].as_py()])
            yield judge_text(text[i].as_py(), lang, refs, limits, None if total is None else own[lang])
    return run


JUDGED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, class_distance double, word_distance double, kept boolean")


def judge(docs: DataFrame, refs: References, id_col: str = "doc_id", text_col: str = "text",
          limits: Limits = Limits(), lang_col: str = "lang") -> DataFrame:
    """One row per document: the id, the base counts, the distances and the verdict."""
    names = [x.split()[0] for x in JUDGED.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    main = References(refs.classes, refs.words)  # tasks cannot hold the table

    def run(batches):
        verdicts = _verdicts(main, limits, 1)
        for batch in batches:
            cols = list(zip(*verdicts(batch))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).field(0)] + [pa.array(c, t) for c, t in zip(cols, types)], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = _with_references(docs, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], lang_col, refs)
    return rows.select("row", "lang", "total", "found").mapInArrow(run, f"`{id_col}` {kind}, {JUDGED}")


def keep_documents(docs: DataFrame, refs: References, text_col: str = "text", limits: Limits = Limits(),
                   lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is kept."""
    names, main = docs.columns, References(refs.classes, refs.words)

    def run(batches):
        verdicts = _verdicts(main, limits, names.index(text_col))
        for batch in batches:
            left = batch.column(0).filter(pa.array([v[-1] for v in verdicts(batch)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(left.flatten(), names)

    rows = _with_references(docs, names, lang_col, refs)
    return rows.select("row", "lang", "total", "found").mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document of ``documents`` with references from all of them."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn_references(docs))
