"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words is one window). All windows of all items go into one
automaton over word numbers, and each document's words run through it once.
Words are compared after lower-casing A-Z; a word is a run of digits, letters
a-z and characters beyond ASCII. Hits are mapped back to spans of the original
text.

One automaton has the windows of at most ``MAX_BENCHMARK_WORDS`` words;
``word_windows`` raises above that. ``hits`` and ``clean`` take a benchmark of
any size: they deal its windows into blocks of that bound. With one block the
documents are read whole, one batch at a time, and are never shuffled. With
more, each block's automaton runs over the documents in a pass of its own, and
what the passes found is united by the document's position in a stored table,
so repeated ids do no harm.

A null or empty text, of a document or an item, has no words and no hits.
Repeated documents are judged row by row; repeated items count once by id, and
an item without an id marks words but is not listed. An empty benchmark hits
nothing. ``drop_contaminated`` returns the input's columns unchanged and
``scan`` fresh ones next to the id, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsmith.llm.common import stored, table
from rowsmith.session import scratch_path

WINDOW = 10
#: Words of one automaton: it has at most WINDOW nodes a word, of some 60 bytes each.
MAX_BENCHMARK_WORDS = 500_000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Bytes of words stay (A-Z lower-cased), all others become spaces.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def benchmark_words(benchmark: DataFrame, text_col: str = "text") -> int:
    return benchmark.agg(F.sum(F.regexp_count(text_col, F.lit(_WORD)))).first()[0] or 0


def word_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Each window of words with the ids (as text) of the items that have it."""
    n = benchmark_words(benchmark, text_col)
    if n > MAX_BENCHMARK_WORDS:
        raise ValueError(f"the benchmark has {n} words, the automaton is bounded to {MAX_BENCHMARK_WORDS}")
    return next(window_blocks(benchmark, id_col, text_col, window), {})


def window_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  window: int = WINDOW) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """The windows of ``word_windows`` in blocks of at most ``MAX_BENCHMARK_WORDS`` words, one at a time.

    A window may be in several blocks, with the ids of other items in each. An item that is too long for a block has
    its windows in several ones.
    """
    found: dict[tuple[bytes, ...], set] = {}
    size = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = fold_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            key = tuple(words[i:i + window])
            more = len(key) if i == 0 or not found else 1
            if found and size + more > MAX_BENCHMARK_WORDS:
                yield {k: sorted(v) for k, v in found.items()}
                found, size, more = {}, 0, len(key)
            size += more
            ids = found.setdefault(key, set())
            if item is not None:
                ids.add(item)
    if found:
        yield {k: sorted(v) for k, v in found.items()}


class Scanner:
    """The automaton over numbers of the benchmark's words; all other words are number 0."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in windows.items():
            self.automaton.add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in key), (len(key), ids))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items found."""
        words = fold_words(text)
        hit = np.zeros(len(words), dtype=bool)
        items: set[str] = set()
        if self.number and words:
            get = self.number.get
            for end, (n, ids) in self.automaton.iter(tuple([get(w, 0) for w in words])):
                hit[end - n + 1:end + 1] = True
                items.update(ids)
        return len(words), hit, items


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as (start, end) code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    points = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [{"start": points(at[a][0]), "end": points(at[b - 1][1])} for a, b in zip(edges[::2], edges[1::2])]


FOUND = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
         "spans array<struct<start: long, end: long>>")


def scan(docs: DataFrame, windows: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, counts, a digest of the items found, and the hit spans of the original text."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), spans_type]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def run(batches):
        scanner = Scanner(windows)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                n, hit, items = scanner.scan(text)
                n_hit = int(hit.sum())
                rows.append((n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                             n_hit > 0, original_spans(text, hit) if n_hit else []))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {FOUND}")


def drop_contaminated(docs: DataFrame, windows: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, in which no window occurs."""
    at = docs.columns.index(text_col)

    def run(batches):
        scanner = Scanner(windows)
        for batch in batches:
            yield batch.filter(pa.array([not scanner.scan(t.as_py())[1].any() for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


RUNS = "array<struct<first: long, last: long, start: long, end: long>>"


def _block_hits(rows: DataFrame, windows: dict) -> DataFrame:
    """For each row (position, text) that is hit: its runs of hit words, with their original spans, and the items."""
    runs_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))

    def run(batches):
        scanner = Scanner(windows)
        for batch in batches:
            at, runs, items = [], [], []
            for position, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                _, hit, found = scanner.scan(text)
                if hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
                    at.append(position)
                    runs.append([{"first": a, "last": b - 1, **span} for a, b, span in
                                 zip(edges[::2], edges[1::2], original_spans(text, hit))])
                    items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(runs, runs_type),
                                              pa.array(items, pa.list_(pa.string()))], ["position", "runs", "items"])

    return rows.mapInArrow(run, f"position long, runs {RUNS}, items array<string>")


def _all_hits(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What the passes of all blocks over the stored ``rows`` (position, text) found: a row a block and row that is hit."""
    path = scratch_path(rows.sparkSession, "benchmark_hits")
    schema = None
    for windows in window_blocks(benchmark):
        hit = _block_hits(rows, windows)  # written at once: one block's windows are held at a time
        hit.write.mode("append").parquet(path)
        schema = hit.schema
    return rows.sparkSession.read.schema(schema).parquet(path)


def _united(batches):
    """Rows (position, lists of runs, lists of items) to counts, the digest and the spans of each document."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for position, runs, items in zip(*(batch.column(i) for i in range(3))):
            whole: list[dict] = []
            for r in sorted((r for part in runs.as_py() for r in part), key=lambda r: (r["first"], r["last"])):
                if whole and r["first"] <= whole[-1]["last"] + 1:
                    if r["last"] > whole[-1]["last"]:
                        whole[-1].update(last=r["last"], end=r["end"])
                else:
                    whole.append(dict(r))
            ids = sorted({i for part in items.as_py() for i in part})
            out.append((position.as_py(), sum(r["last"] - r["first"] + 1 for r in whole), len(ids),
                        hashlib.sha256(",".join(ids).encode()).hexdigest(),
                        [{"start": r["start"], "end": r["end"]} for r in whole]))
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         ["position", "n_hit", "n_items", "items_sha256", "spans"])


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` with all windows of a benchmark (item_id, text) of any size."""
    if benchmark_words(benchmark) <= MAX_BENCHMARK_WORDS:
        return scan(docs, next(window_blocks(benchmark), {}), id_col, text_col)
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                              F.monotonically_increasing_id().alias("position")), "decontaminate_rows")
    spans = "array<struct<start: long, end: long>>"
    found = (_all_hits(rows.select("position", "text"), benchmark)
             .groupBy("position").agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
             .mapInArrow(_united, f"position long, n_hit long, n_items long, items_sha256 string, spans {spans}"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return (rows.select("position", "id", n_words.alias("n_words")).join(found, "position", "left")
            .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items_sha256", F.lit(hashlib.sha256().hexdigest())).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("spans", F.array().cast(spans)).alias("spans")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``drop_contaminated`` with all windows of a benchmark (item_id, text) of any size."""
    if benchmark_words(benchmark) <= MAX_BENCHMARK_WORDS:
        return drop_contaminated(docs, next(window_blocks(benchmark), {}), text_col)
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("position")),
                  "decontaminate_rows")
    found = _all_hits(rows.select("position", F.col(f"row.`{text_col}`").cast("string").alias("text")), benchmark)
    return rows.join(found.select("position").distinct(), "position", "left_anti").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against all windows of ``benchmark``."""
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM grams JOIN wins USING (n, win)),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
