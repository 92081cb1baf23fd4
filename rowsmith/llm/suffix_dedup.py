"""Removal of repeated byte strings by sorting suffixes.

A byte goes if some string of ``length`` bytes that covers it starts at another
place too, in any document. All such strings (windows) are found exactly:

1. Every window has one anchor: the leftmost of its ``gram``-byte strings with
   the smallest hash. Equal windows have their anchor at the same offset, and
   neighbouring windows mostly share one, so there is about one anchor for
   each ``(length - gram) / 2`` bytes. An anchor stands for a run of windows, its segment.
2. Segments that occur twice as a whole (128-bit hash) are settled, which
   covers copies and the inside of shared passages. An anchor whose own bytes
   occur nowhere else has no repeated window.
3. What is left are segments at the edges of repeats. Their suffixes (the
   bytes from the anchor on, then those before it, backwards) go through the
   distributed merge sort of ``suffix_runs``, and once more with the two sides
   exchanged. The common prefixes of neighbours say how far a segment agrees with
   any other to the right and to the left, and give its repeated windows.
4. Windows that these bounds allow but no neighbour showed are compared by the
   hash of their bytes.

Sorting only the suffixes at anchors, and only of unsettled segments, keeps
what is exchanged well below the text itself; a suffix array of all positions
would take several times the text.

Texts are UTF-8 bytes; a null text is an empty one. Texts shorter than
``length`` lose nothing, very long ones are worked through in blocks. Matches never cross documents. Repeated rows are
places of their own, so their common strings go. Rows with equal texts get
equal results; a text that very many rows have meets its result by broadcast (``operators.skew``). ``n_bytes`` is the length
of the input text, whatever is removed; ``n_removed`` and ``n_spans`` say what was. An empty table gives an empty result. Of the input only id and
text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowsmith.llm.common import slices, stored, table
from rowsmith.llm.suffix_runs import RANGE_SIZE, common, merge, sorted_ranges
from rowsmith.operators import skew
from rowsmith.operators.skew import join_unique
from rowsmith.session import free

LENGTH = 400
GRAM = 32
_LOW = 20
_MASK = np.uint64((1 << _LOW) - 1)
_TABLE = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(18).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Between the sides of a sort key; not a byte of UTF-8.
_SEPARATOR = b"\xff"


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from every position on."""
    h, span = _TABLE[raw], 1
    while span < gram:
        h = h[:-span] * _FACTORS[span.bit_length()] + h[span:]
        span *= 2
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    return h


def _window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest hash (its upper bits) among ``width`` from every position on."""
    m = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    return (m & _MASK).astype(np.int64)


def anchors_of(texts: list[bytes], length: int, gram: int, chunk: int = 1 << 19):
    """For each text: first window, anchor, last window and the anchor's hash of each segment (int64 and uint64 arrays).

    Short texts are hashed together; a long one in blocks, whose segments are joined again where they meet.
    """
    width, limit = length - gram + 1, (1 << _LOW) - length
    at = 0
    while at < len(texts):
        start, part, total = at, [], 0
        while at < len(texts) and (not part or total + len(texts[at]) < chunk):
            part.append(texts[at])
            total += len(texts[at])
            at += 1
        raw = np.frombuffer(b"".join(part), dtype=np.uint8)
        blocks = range(0, max(1, len(raw) - length + 1), limit) if len(part) == 1 else [0]
        where, h_all = [], []
        for b in blocks:
            piece = raw[b:b + limit + length - 1] if len(part) == 1 else raw
            if len(piece) >= length:
                h = gram_hashes(piece, gram)
                a = _window_anchors(h, width)
                where.append(a + b)
                h_all.append(h[a])
        anchor = np.concatenate(where) if where else np.zeros(0, np.int64)
        hashes = np.concatenate(h_all) if h_all else np.zeros(0, np.uint64)
        offset = 0
        for text in part:
            n = len(text) - length + 1
            own = anchor[offset:offset + max(0, n)]
            if len(own):
                first = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
                last = np.concatenate((first[1:], [len(own)])) - 1
                yield first, own[first] - offset, last, hashes[offset:offset + n][first]
            else:
                yield (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
            offset += len(text)
        assert at > start


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), _key(text).alias("doc"))


def _segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, first, anchor, last, gram_hash, segment) of all texts; of equal texts in a task, the first two."""
    names = ["doc", "first", "anchor", "last", "gram_hash", "segment"]

    def run(batches):
        seen: dict[bytes, int] = {}
        for batch in slices(batches):
            docs, raw = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[d] = seen.get(d, 0) + 1
                if len(t) >= length and seen[d] <= 2:  # two are enough to tell a repeat
                    docs.append(d)
                    raw.append(t)
            out: list[list] = [[] for _ in names]
            for d, t, (first, anchor, last, h) in zip(docs, raw, anchors_of(raw, length, gram)):
                out[0] += [d] * len(first)
                out[1].append(first), out[2].append(anchor), out[3].append(last), out[4].append(h.view(np.int64))
                digest = xxhash.xxh3_128_digest
                out[5] += [digest(t[a:b + length], seed=x - a) for a, x, b in zip(first.tolist(), anchor.tolist(), last.tolist())]
                if len(out[0]) > 20_000:
                    yield batch_of(out)
                    out = [[] for _ in names]
            if out[0]:
                yield batch_of(out)

    def batch_of(out):
        longs = [pa.array(np.concatenate(c)) for c in out[1:5]]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *longs, pa.array(out[5], pa.binary())], names)

    return texts.select("doc", "text").mapInArrow(run, "doc binary, first long, anchor long, last long, gram_hash long, segment binary")


def _copies(texts: DataFrame) -> DataFrame:
    """(doc, n): the texts that very many rows have."""
    return stored(texts.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > skew.HOT_ROWS), "suffix_copies")


def _edges(texts: DataFrame, picked: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """(segment, gram_hash, low, high, right, left): both sides of the anchor of each picked segment, and its range of
    window offsets (bytes before the anchor)."""
    lists = picked.groupBy("doc").agg(F.collect_list(F.struct("segment", "gram_hash", "first", "anchor", "last")).alias("segments"))
    names = ["segment", "gram_hash", "low", "high", "right", "left"]

    def run(batches):
        done = set()  # equal texts
        for batch in slices(batches, 64):
            out: list[list] = [[] for _ in names]
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if doc in done:
                    continue
                done.add(doc)
                text = batch.column(1)[i].as_py()
                for s in batch.column(2)[i].as_py():
                    first, a, last = s["first"], s["anchor"], s["last"]
                    row = (s["segment"], s["gram_hash"], a - last, a - first, text[a:a + length], text[first:a][::-1])
                    for c, v in zip(out, row):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary())] + [pa.array(c, pa.int64()) for c in out[1:4]]
                                                 + [pa.array(c, pa.binary()) for c in out[4:]], names)

    rows = join_unique(texts.select("doc", "text"), lists, ["doc"], counts=(copies, "n")).select("doc", "text", "segments")
    found = rows.mapInArrow(run, "segment binary, gram_hash long, low long, high long, right binary, left binary")
    # a hot text is not gathered in one task, so several tasks may have it
    return found if copies.isEmpty() else found.dropDuplicates(["segment", "low", "high"])


def _neighbours(edges: DataFrame, n_rows: int, length: int, backwards: bool, range_size: int) -> DataFrame:
    """(segment, reach, spans): of each segment the longest agreement of its sorted side with any other, and the ranges of
    offsets at which its windows repeat in a neighbour of the sorted order (low, high, low, high, ...)."""
    a, b = ("left", "right") if backwards else ("right", "left")
    tag = F.concat("segment", F.to_binary(F.lpad(F.hex(F.col("low")), 8, "0"), F.lit("hex")),
                   F.to_binary(F.lpad(F.hex(F.col("high")), 8, "0"), F.lit("hex")),
                   F.to_binary(F.lpad(F.hex(F.octet_length(a)), 8, "0"), F.lit("hex")))
    rows = edges.select(F.concat(F.col(a), F.lit(_SEPARATOR), F.col(b)).alias("key"), tag.alias("tag"))

    def run(group: pa.Table) -> pa.Table:
        names, reaches, spans = [], [], []
        last = None  # key, segment, low, high, length of its sorted side
        last_reach, last_spans = 0, []

        def close():
            if last is not None:
                names.append(last[1]), reaches.append(last_reach), spans.append(last_spans)

        for key, t, n in merge(group.column("block").to_pylist()):
            segment = t[:16]
            low, high, side = (int.from_bytes(t[i:i + 4], "big") for i in (16, 20, 24))
            if last is not None and last[1] == segment:
                continue  # the same segment from another part of its texts
            reach, own = 0, []
            if last is not None:
                reach = min(n, side, last[4])
                if n > side:
                    other = n - side - 1
                else:
                    other = common(key[side + 1:], last[0][last[4] + 1:])
                to_right, to_left = (other, reach) if backwards else (reach, other)
                x, y = max(length - to_right, low), min(to_left, high)
                if x <= y:
                    own = [x, y]
                x, y = max(length - to_right, last[2]), min(to_left, last[3])
                if x <= y:
                    last_spans += [x, y]
                last_reach = max(last_reach, reach)
            close()
            last, last_reach, last_spans = (key, segment, low, high, side), reach, own
        close()
        return pa.table([pa.array(names, pa.binary()), pa.array(reaches, pa.int64()), pa.array(spans, pa.list_(pa.int64()))],
                        names=["segment", "reach", "spans"])

    runs = sorted_ranges(rows, "key", "tag", n_rows, range_size)
    return runs.groupBy("part").applyInArrow(run, "segment binary, reach long, spans array<long>")


def _gaps(low: int, high: int, spans: list[int]) -> list[int]:
    """What of low..high no span covers, as (low, high, ...)."""
    out = []
    for x, y in sorted(zip(spans[::2], spans[1::2])):
        if x > low:
            out += [low, min(high, x - 1)]
        low = max(low, y + 1)
        if low > high:
            break
    if low <= high:
        out += [low, high]
    return out


def _settle(edges: DataFrame, length: int, range_size: int) -> DataFrame:
    """(segment, spans): all offsets at which windows of the edge segments repeat."""
    n = edges.count()
    to_right = _neighbours(edges, n, length, False, range_size).select("segment", F.col("reach").alias("right_reach"),
                                                                       F.lit(0).cast("long").alias("left_reach"), "spans")
    to_left = _neighbours(edges, n, length, True, range_size).select("segment", F.lit(0).cast("long").alias("right_reach"),
                                                                     F.col("reach").alias("left_reach"), "spans")
    reach = (to_right.unionByName(to_left).groupBy("segment")
             .agg(F.max("right_reach").alias("right_reach"), F.max("left_reach").alias("left_reach"),
                  F.flatten(F.collect_list("spans")).alias("spans")))

    def open_gaps(batches):
        for batch in batches:
            gaps = []
            for low, high, right, left, spans in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "right_reach", "left_reach", "spans"))):
                gaps.append(_gaps(max(low, length - right), min(high, left), spans))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("segment", "gram_hash", "low", "high", "right_reach", "left_reach", "spans")]
                                             + [pa.array(gaps, pa.list_(pa.int64()))],
                                             ["segment", "gram_hash", "low", "high", "right_reach", "left_reach", "spans", "gaps"])

    known = stored(edges.select("segment", "gram_hash", "low", "high").join(reach, "segment")
                   .mapInArrow(open_gaps, "segment binary, gram_hash long, low long, high long, right_reach long, left_reach long, "
                                          "spans array<long>, gaps array<long>"), "suffix_reach")
    asked = (known.where(F.size("gaps") > 0).groupBy("gram_hash")
             .agg(F.min(F.array_min("gaps")).alias("from"), F.max(F.array_max("gaps")).alias("to")))

    def windows(batches):
        for batch in batches:
            names, at, digests = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("segment", "right", "left", "x", "y")]
            for segment, right, left, x, y in zip(*cols):
                for o in range(x, y + 1):
                    names.append(segment), at.append(o)
                    digests.append(xxhash.xxh3_128_digest(left[:o][::-1] + right[:length - o], seed=o))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(at, pa.int64()), pa.array(digests, pa.binary())],
                                             ["segment", "at", "window"])

    # of all segments with the same anchor bytes, the windows in the range asked for that their reaches allow
    x = F.greatest("low", F.lit(length) - F.col("right_reach"), "from")
    y = F.least("high", "left_reach", "to")
    ranges = known.join(asked, "gram_hash").select("segment", x.alias("x"), y.alias("y")).where("x <= y")
    shown = stored(edges.select("segment", "right", "left").join(ranges, "segment")
                   .select("segment", "right", "left", "x", "y").mapInArrow(windows, "segment binary, at long, window binary"), "suffix_windows")
    repeated = shown.groupBy("window").agg(F.countDistinct("segment").alias("n")).where("n > 1").select("window")
    more = (shown.join(repeated, "window", "left_semi").select("segment", F.array("at", "at").alias("spans")))
    spans = stored(known.select("segment", "spans").where(F.size("spans") > 0).unionByName(more), "suffix_spans")
    free(known, shown)
    return spans


def repeated_windows(texts: DataFrame, copies: DataFrame, length: int, gram: int, range_size: int) -> DataFrame:
    """(doc, runs): the runs (first, last) of starts of repeated windows, of every different text that has any."""
    segments = stored(_segments(texts, length, gram), "suffix_segments")
    whole = stored(segments.groupBy("segment").agg(F.count("*").alias("n"), F.min("gram_hash").alias("gram_hash"),
                                                   F.min(F.struct("doc", "first", "anchor", "last")).alias("at")), "suffix_counts")
    # anchors whose bytes occur in another segment too, where at least one of these is not settled
    unsettled = (whole.groupBy("gram_hash").agg(F.count("*").alias("m"), F.min("n").alias("n")).where("m > 1 AND n = 1")
                 .select("gram_hash"))
    picked = whole.join(unsettled, "gram_hash", "left_semi").select("segment", "gram_hash", "at.*")
    edges = stored(_edges(texts, picked, copies, length), "suffix_edges")
    spans = _settle(edges, length, range_size)
    free(edges)
    single = whole.where("n = 1").select("segment", F.col("at.doc").alias("doc"), F.col("at.anchor").alias("anchor"))
    at_edges = (spans.join(single, "segment")
                .withColumn("i", F.explode(F.sequence(F.lit(0), F.expr("size(spans) div 2 - 1"))))
                .select("doc", (F.col("anchor") - F.expr("spans[2 * i + 1]")).alias("first"), (F.col("anchor") - F.expr("spans[2 * i]")).alias("last")))
    settled = segments.join(whole.where("n > 1").select("segment"), "segment", "left_semi").select("doc", "first", "last")
    runs = stored(settled.distinct().unionByName(at_edges).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "suffix_found")
    free(segments, whole, spans)
    return runs


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
           range_size: int = RANGE_SIZE) -> DataFrame:
    """Per document: id, kept (the bytes left), n_bytes (of the input text), n_removed, n_spans."""
    if gram & (gram - 1) or not 1 <= gram <= length:
        raise ValueError("gram must be a power of two of at most length")
    texts = _texts(docs, id_col, text_col)
    copies = _copies(texts)
    found = repeated_windows(texts, copies, length, gram, range_size)
    names = ["id", "kept", "n_bytes", "n_removed", "n_spans"]

    def run(batches):
        for batch in slices(batches):
            kept, counts = [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                pieces, at, removed, spans, covered = [], 0, 0, 0, -1
                for r in sorted((r["first"], r["last"]) for r in runs.as_py() or []):
                    first, end = r[0], r[1] + length
                    if first > covered:  # not even touching what is removed already
                        pieces.append(text[at:first])
                        spans += 1
                        removed += end - first
                        at = covered = end
                    elif end > covered:
                        removed += end - covered
                        at = covered = end
                pieces.append(text[at:])
                kept.append(b"".join(pieces))
                counts.append((len(text), removed, spans))
            cols = list(zip(*counts)) if counts else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())] + [pa.array(c, pa.int64()) for c in cols], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return (join_unique(texts, found, ["doc"], "left", counts=(copies, "n")).select("id", "text", "runs")
            .mapInArrow(run, f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start anywhere else too."""
    out = remove(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, i, md5(b[i:i + {LENGTH - 1}]) AS h
    FROM (SELECT r, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
hits AS (SELECT r, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)),
-- a run of removed bytes goes on while the next repeated string begins inside it or right behind it
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM hits)),
runs AS (SELECT r, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM numbered GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM runs
    UNION ALL SELECT r, max(z) + 1, 9223372036854775807 FROM runs GROUP BY r),
kept AS (SELECT r, unhex(string_agg(hex(CASE WHEN g.z >= g.a THEN b[g.a:least(g.z, octet_length(b))] ELSE encode('') END), '' ORDER BY g.a)) AS kept
    FROM gaps g JOIN d USING (r) GROUP BY r),
counts AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(CASE WHEN n_spans IS NULL THEN b ELSE kept END) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""
