"""Sorted suffix runs: front coding, a loser tree that never re-compares known prefixes, and the distributed merge sort.

Every task sorts its suffixes into runs and front-codes each run's part of
every key range (common prefix with the one before, and the rest). The parts
are exchanged by range; the task of a range merges them with a loser tree. A
loser keeps the length of the prefix it shares with the winner that beat it,
and a run's next suffix brings the length it shares with its predecessor from the
front coding, so two suffixes are compared only where these lengths are
equal, and only from there on. The lengths that come out with the winners are
the common prefixes of neighbours.

Ranges are cut at keys that occur; such a key is sent to both its ranges, so
every pair of neighbours meets in one of them. The driver cuts at most
``MAX_RANGES`` ranges from a sample of bounded size, and tasks know only these cuts.
Where such a range holds more than ``RANGE_SIZE`` suffixes, it is cut again by
keys sampled on the executors; its blocks are split there, and the parts
exchanged once more.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowsmith.llm.common import stored

#: Suffixes of a sorted run, and of a key range, that a task holds at once.
RUN_SIZE = 40_000
RANGE_SIZE = 60_000
#: Ranges that the driver cuts, and keys of its sample for each.
MAX_RANGES = 2_000
SAMPLE = 20
#: Shuffle partitions that ranges are dealt to, at most.
MAX_PARTITIONS = 100_000


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which is known to be at least ``at``."""
    n = min(len(a), len(b))
    while at < n:
        end = min(n, at + 64)
        x, y = a[at:end], b[at:end]
        if x == y:
            at = end
            continue
        lo, hi = 0, end - at  # the first lo bytes agree, the first hi do not
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid
        return at + lo
    return n


def front_code(run: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (key, tag) with tags of one length as bytes."""
    shared, tails, last = [], [], b""
    for key, _ in run:
        n = common(last, key)
        shared.append(n)
        tails.append(key[n:])
        last = key
    head = np.array([shared, [len(t) for t in tails]], dtype=np.uint32).tobytes()
    width = len(run[0][1]) if run else 0
    return struct.pack("<II", len(run), width) + head + b"".join(t for _, t in run) + b"".join(tails)


def read_run(block: bytes):
    """(key, tag, length shared with the key before) of a front-coded run, in order."""
    n, width = struct.unpack_from("<II", block)
    head = np.frombuffer(block, np.uint32, 2 * n, 8).reshape(2, n).tolist()
    tags = 8 + 8 * n
    at, key = tags + width * n, b""
    for i, (shared, size) in enumerate(zip(*head)):
        key = key[:shared] + block[at:at + size]
        at += size
        yield key, block[tags + i * width:tags + (i + 1) * width], shared


def merge(blocks: list[bytes]):
    """(key, tag, length shared with the key before) of all runs in order of key, equal keys by tag."""
    runs = [read_run(b) for b in blocks]
    k = 1
    while k < len(runs):
        k *= 2
    key: list = [None] * k  # None: the run has ended
    tag: list = [b""] * k
    shared = [0] * k  # with the last key that came out, or, for a loser, with its winner
    for i, run in enumerate(runs):
        head = next(run, None)
        if head is not None:
            key[i], tag[i] = head[0], head[1]

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; the loser's ``shared`` becomes that with the winner."""
        x, y = key[a], key[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        n = common(x, y, shared[a])
        if n == len(x) == len(y):
            first = (tag[a], a) < (tag[b], b)
        else:
            first = n == len(x) or (n < len(y) and x[n] < y[n])
        shared[b if first else a] = n
        return first

    loser = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if not beats(a, b):
            a, b = b, a
        loser[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while key[winner] is not None:
        yield key[winner], tag[winner], shared[winner]
        head = next(runs[winner], None)
        if head is None:
            key[winner] = None
        else:
            key[winner], tag[winner], shared[winner] = head
        node = (winner + k) // 2
        while node:
            if not beats(winner, loser[node]):
                winner, loser[node] = loser[node], winner
            node //= 2


def _split(names: list[bytes], cuts: list[bytes]):
    """(number of the range, first, end) of each range that sorted ``names`` have a share in; a cut key is in both its ranges."""
    for part in range(len(cuts) + 1):
        a = bisect_left(names, cuts[part - 1]) if part else 0
        b = bisect_right(names, cuts[part]) if part < len(cuts) else len(names)
        if b > a:
            yield part, a, b


def _even_cuts(keys: list[bytes], parts: int) -> list[bytes]:
    """At most ``parts`` - 1 different keys that cut sorted ``keys`` evenly."""
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def sorted_ranges(rows: DataFrame, key: str, tag: str, n_rows: int, range_size: int = RANGE_SIZE,
                  run_size: int = RUN_SIZE) -> DataFrame:
    """(part, block) front-coded runs of ``rows`` (binary key and tag), cut into key ranges of about ``range_size``.

    Dealt by range: as many shuffle partitions as ranges (and as the session asks for at least), so that a task's share does not
    grow with the input.
    """
    wanted = max(1, -(-n_rows // range_size))
    parts = min(wanted, MAX_RANGES)
    cuts: list[bytes] = []
    if parts > 1:  # keys chosen by a hash of the tag: some SAMPLE for each range
        few = rows.where(F.pmod(F.xxhash64(tag), F.lit(1 << 30)) < int(min(1.0, SAMPLE * parts / n_rows) * (1 << 30)))
        cuts = _even_cuts(sorted({bytes(r[0]) for r in few.select(key).toLocalIterator()}), parts)

    def run(batches):
        def blocks(held):
            held.sort()
            out = [(part, front_code(held[a:b])) for part, a, b in _split([h[0] for h in held], cuts)]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["part", "block"])

        held: list = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held) >= run_size:
                yield blocks(held)
                held = []
        if held:
            yield blocks(held)

    runs = rows.select(key, tag).mapInArrow(run, "part long, block binary")
    if wanted > MAX_RANGES:
        runs = _cut_again(stored(runs, "suffix_runs"), n_rows, range_size)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(min(MAX_PARTITIONS, max(least, 2 * wanted)), "part")


def _cut_again(runs: DataFrame, n_rows: int, range_size: int) -> DataFrame:
    """``runs`` with every range cut into ranges of about ``range_size`` by keys of its own, all on the executors."""
    every = max(1, range_size // SAMPLE)

    def sample(batches):
        for batch in batches:
            parts, keys, sizes = [], [], []
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                names = [k for k, _, _ in read_run(block.as_py())]
                own = names[len(names) // 2 % every::every]
                parts += [part] * (len(own) + 1)
                keys += [*own, None]
                sizes += [0] * len(own) + [len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())],
                                             ["part", "key", "n"])

    def choose(batches):
        for batch in batches:
            cuts = [_even_cuts(keys, -(-n // range_size)) for keys, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.list_(pa.binary()))], ["part", "cuts"])

    # a range's sample: SAMPLE keys for each range that it is cut into
    cuts = (runs.mapInArrow(sample, "part long, key binary, n long").groupBy("part")
            .agg(F.sort_array(F.collect_list("key")).alias("keys"), F.sum("n").alias("n"))
            .mapInArrow(choose, "part long, cuts array<binary>"))
    cuts = stored(cuts, "suffix_cuts")
    most = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0

    def cut(batches):
        for batch in batches:
            parts, blocks = [], []
            for part, block, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                held = [(k, t) for k, t, _ in read_run(block.as_py())]
                for i, a, b in _split([k for k, _ in held], cuts):
                    parts.append(part * (most + 1) + i)
                    blocks.append(front_code(held[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blocks, pa.binary())], ["part", "block"])

    return runs.join(cuts, "part").select("part", "block", "cuts").mapInArrow(cut, "part long, block binary")
