"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct word shingles (64-bit hashes). Documents
of equal sets are one vertex. Two 64-bit hashes of a set tell sets apart; the first one alone names
the vertex, and where different sets are found to share it, both together do.
The join finds the links between vertices by prefix lists:

1. One pass counts shingles that are frequent within a task's documents. The
   most frequent come last in the global order of shingles; the order decides
   only how long the lists get, never what is found.
2. A set of n shingles with a partner has one of its first
   n - ceil(0.8 n) + 1 shingles (in that order) among the partner's first. These
   prefixes are listed by shingle. Lists with one vertex vanish, lists with
   the same members become one.
3. Inside a list, members are kept in blocks by size and position. A block is
   skipped where no member can share enough with the set at hand. For the
   others a parity bitmap of each set bounds the overlap from above. In long lists
   a set that is unlike all sets answered so far is answered against the whole list, up to
   ``PIVOTS`` times. Every other set derives its answers from those: distances of bitmaps differ by no more
   than the two sets' own distance, so only members at about the same distance
   from each answered set are looked at again.
4. A first round checks, against the whole sets, only pairs that would tie a
   list together; connected sets need no more pairs among them. A set without
   any such pair has no partner, and takes no further part. The second round
   checks every pair left between sets that are still not connected.

So all links are found, and copies and near copies cost a link or a few each
instead of all pairs. A list with more than ``LIST_LIMIT`` members is split
into blocks, and each pair of blocks is a task of its own.

Null and empty texts have an empty set and are linked with nothing: each is
its own component. Repeated rows are equal sets, so they are linked. A null id
is a member like any other but never names a component, unless all ids in it
are null. An empty table gives an empty result. Of the input only id and text
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowsmith.llm.common import lean_batches, slices, stored, table
from rowsmith.llm.components import components
from rowsmith.operators import skew
from rowsmith.operators.skew import join_unique
from rowsmith.session import free, small

SHINGLE = 5
PERCENT = 80
BITS = 1024
#: Members of a list that one task holds at once.
LIST_LIMIT = 20_000
#: Frequent shingles that are moved to the end of the order (8 bytes each).
FREQUENT = 200_000
BLOCK = 64
#: Sets of a list whose answers others reuse, at most.
PIVOTS = 12
#: Rows (id and two hashes) up to which the documents of checked vertices go to every task.
MAX_BROADCAST_ROWS = 200_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _K3
    h ^= h >> np.uint64(29)
    return h


def _block_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[a]
    first = ~space
    first[1:] &= space[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), start
    a, space = a[start[0]:], space[start[0]:]
    at = np.arange(start[0], start[0] + len(a)) - np.repeat(start, np.diff(np.append(start, start[0] + len(a))))
    v = _mix((a.astype(np.uint64) + np.uint64(1)) * _K1 + at.astype(np.uint64) * _K2)
    v[space] = 0
    return _mix(np.add.reduceat(v, start - start[0])), start


def words_of(raw: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of lower-cased ``raw``, in blocks that end at a space."""
    if len(raw) <= block:
        return _block_words(raw)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + block)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        h, s = _block_words(raw[at:end])
        hashes.append(h), starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingles_of(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size`` consecutive words; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * _K2 + words[i:n - k + 1 + i]
    return np.unique(_mix(h))


def sets_of(texts: list, size: int = SHINGLE, chunk: int = 1 << 19):
    """The shingle set of each text (str or None), many short texts hashed at once."""
    at = 0
    while at < len(texts):
        part, total = [], 0
        while at < len(texts) and (not part or total < chunk):
            part.append((texts[at] or "").encode("utf-8", "surrogatepass").lower())
            total += len(part[-1]) + 1
            at += 1
        words, start = words_of(b" ".join(part))
        edges = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in part]))
        for a, b in zip(edges[:-1], edges[1:]):
            yield shingles_of(words[a:b], size)


def set_name(s: np.ndarray) -> int:
    """Hash of a set of sorted hashes (signed, as Spark's long)."""
    if not len(s):
        return 0
    h = _mix(s * _K1 + np.arange(len(s), dtype=np.uint64) * _K2)
    return int(_mix(np.array([h.sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def set_check(s: np.ndarray) -> int:
    """A second hash of a set, independent of its name."""
    if not len(s):
        return 0
    h = _mix((s ^ _K3) * _K2 + np.arange(len(s), dtype=np.uint64) * _K1)
    return int(_mix(np.array([np.bitwise_xor.reduce(h) * _K1 + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each hash cell; the cells are a power of two from twice the elements on."""
    cells = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(7)).astype(np.int64) % cells, minlength=cells) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with fewer cells."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of different cells of bitmap ``a`` and each row of ``b``, at the size of the smaller."""
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=-1, dtype=np.int64)


def needed(nx, ny, percent: int = PERCENT):
    """Overlap from which two sets of these sizes are linked."""
    return (percent * (nx + ny) + 99 + percent) // (100 + percent)


def _frequent(docs: DataFrame, size: int, at_least: int = 4) -> np.ndarray:
    """The most frequent shingles, least frequent first, from the counts of every task's documents.

    A task counts all its documents in rounds of some million shingles and
    reports those in ``at_least`` documents of a round.
    """
    def run(batches, round_size=4_000_000):
        held, total = [], 0

        def report():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= at_least
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["shingle", "n"])

        for batch in slices(batches):
            for s in sets_of(batch.column(0).to_pylist(), size):
                held.append(s)
                total += len(s)
                if total >= round_size:
                    yield report()
                    held, total = [], 0
        if held:
            yield report()

    found = (docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect())
    return np.array([r[0] for r in reversed(found)], dtype=np.int64).view(np.uint64)


def _vertices(docs: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """(id, text_hash, n, vertex, check, bits, prefix) of every document; bitmap and prefix only at the first document of its
    set in a task."""
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int64)))
    schema = docs.select("id").schema
    names = ["id", "text_hash", "n", "vertex", "check", "bits", "prefix"]

    def run(batches):
        keys, rank = sent.value
        known = set()
        for batch in slices(batches):
            ns, vertices, checks, bits, prefixes = [], [], [], [], []
            for s in sets_of(batch.column(2).to_pylist(), size):
                v = set_name(s), set_check(s)
                ns.append(len(s))
                vertices.append(v[0] if len(s) else None)
                checks.append(v[1] if len(s) else None)
                if not len(s) or v in known:
                    bits.append(None), prefixes.append(None)
                    continue
                known.add(v)
                bits.append(bitmap(s))
                p = prefix_length(len(s), percent)
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    last = keys[i] == s
                    late = s[last][np.argsort(rank[i[last]], kind="stable")]
                    head = np.concatenate((s[~last][:p], late))[:p]
                else:
                    head = s[:p]
                prefixes.append(head.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(vertices, pa.int64()), pa.array(checks, pa.int64()),
                 pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names)

    return docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"id {schema['id'].dataType.simpleString()}, text_hash long, n long, vertex long, check long, bits binary, prefix array<long>")


def _told_apart(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vertices`` with a name for each set, and the names that very many rows have (vertex, times).

    Sets that differ in their check but share a name get names of both hashes.
    """
    names = (vertices.where("vertex is not null").groupBy("vertex")
             .agg(F.min("check").alias("a"), F.max("check").alias("b"), F.count("*").alias("times")))
    names = stored(names.where((F.col("a") < F.col("b")) | (F.col("times") > skew.HOT_ROWS)), "jaccard_names")
    # by chance n^2 / 2^65 names for n sets: some hundred for 10^11
    shared = [r[0] for r in names.where("a < b").select("vertex").collect()]
    if shared:
        own = F.when(F.col("vertex").isin(shared), F.xxhash64("vertex", "check")).otherwise(F.col("vertex"))
        vertices = vertices.withColumn("vertex", own)
    return vertices, names.where("a = b").select("vertex", "times")


def _lists(vertices: DataFrame) -> DataFrame:
    """(list, members, vertex, pos, shared): lists with different vertices, one of those with equal members; pos is that of
    the first shingle that the members share, shared their number."""
    entries = vertices.where("prefix is not null").select("vertex", F.posexplode("prefix").alias("pos", "shingle"))
    # counted in every task first: a shingle that a third of all sets begin with sends one row a task
    member = F.xxhash64("vertex").bitwiseAND(F.lit((1 << 38) - 1))
    shingles = stored(entries.groupBy("shingle").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high"), F.count("*").alias("members"),
                                                     F.sum(member).alias("list")).where("low < high")
                      .withColumn("list", F.col("list") * 31 + F.col("members")), "jaccard_shingles")
    shared = join_unique(entries, shingles, ["shingle"], counts=(shingles, "members"))
    lists = stored(shared.groupBy("list", "low", "high", "members", "vertex").agg(F.min("pos").alias("pos"), F.count("*").alias("shared")),
                   "jaccard_lists")
    free(shingles)
    return lists


def _sets(docs: DataFrame, vertices: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(vertex, shingles) of the vertices in pairs, each from one of its documents."""
    wanted = pairs.select(F.col("a").alias("vertex")).unionByName(pairs.select(F.col("b").alias("vertex"))).distinct()
    pick = stored(vertices.where("prefix is not null").join(wanted, "vertex", "left_semi")
                  .groupBy("vertex").agg(F.min(F.struct("id", "text_hash", "check")).alias("doc")).select("vertex", "doc.*"), "jaccard_wanted")

    def run(batches):
        done = set()  # repeated rows of one document
        for batch in slices(batches):
            found = []
            for v, check, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets_of(batch.column(1).to_pylist(), size)):
                if v not in done and set_check(s) == check:
                    done.add(v)
                    found.append((v, s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())],
                ["vertex", "shingles"])

    texts = docs.select(F.col("id").alias("doc"), F.xxhash64("text").alias("hash"), "text")
    # without a shuffle of all texts where the wanted ones are counted to be few
    rows = texts.join(small(pick, MAX_BROADCAST_ROWS), (F.col("text_hash") == F.col("hash")) & F.col("id").eqNullSafe(F.col("doc")))
    return rows.select("vertex", "text", "check").mapInArrow(run, "vertex long, shingles binary")


class _Answers:
    """Bitmap distances from one set to the members of a list, by blocks; sets reuse the answers of pivots."""

    def __init__(self, n, pos, bitmaps, percent):
        self.n, self.pos, self.percent = n, pos, percent
        fine = [np.frombuffer(b, dtype=np.uint64) for b in bitmaps]
        self.words = np.array([len(f) for f in fine])
        self.place = np.empty(len(n), dtype=np.int64)  # of a member among those with bitmaps of its size
        self.fine = {}
        for w in np.unique(self.words):
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.fine[w] = np.stack([fine[i] for i in own])
        self.bits = np.stack([folded(f, BITS // 64) for f in fine])
        self.edges = np.arange(0, len(n), BLOCK)
        self.low_n, self.high_n = np.minimum.reduceat(n, self.edges), np.maximum.reduceat(n, self.edges)
        self.left = np.maximum.reduceat(n - pos, self.edges)  # most that a member of the block has from its position on
        self.pivots: list[np.ndarray] = []  # the distances of each answered set to all members
        self.own_limit = 2 * n - 2 * needed(n, n, percent)

    def partners(self, x: int, among: np.ndarray) -> np.ndarray:
        """Of the members ``among`` (sorted), those that may be linked with member x."""
        n, percent = self.n, self.percent
        fits = ((100 * self.low_n <= (10000 * n[x]) // percent) & (100 * self.high_n >= percent * n[x])
                & (np.minimum(self.left, n[x] - self.pos[x]) >= needed(n[x], np.maximum(self.low_n, (percent * n[x]) // 100), percent)))
        y = among[fits[among // BLOCK]]
        if not len(y):
            return y
        need = needed(n[x], n[y], percent)
        y = y[(100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
              & (np.minimum(n[x] - self.pos[x], n[y] - self.pos[y]) >= need)]
        limit = n[x] + n[y] - 2 * needed(n[x], n[y], percent)
        for distance in self.pivots:
            near = np.abs(distance[y] - distance[x]) <= limit
            y, limit = y[near], limit[near]  # the others are beyond the limit whatever x has
        out = [y[:0]]
        for at in range(0, len(y), 4096):  # bounded memory
            part, bound = y[at:at + 4096], limit[at:at + 4096]
            near = apart(self.bits[x], self.bits[part]) <= bound
            part, bound = part[near], bound[near]
            for w in np.unique(self.words[part]):  # long sets: by their larger bitmaps
                same = self.words[part] == w
                if min(w, self.words[x]) > BITS // 64:
                    mine = self.fine[self.words[x]][self.place[x]]
                    same[same] = apart(mine, self.fine[w][self.place[part[same]]]) <= bound[same]
                out.append(part[same])
        return np.sort(np.concatenate(out))

    def answer_all(self, x: int) -> None:
        """Make x a set whose answers others reuse, unless one like it is there already or there are enough."""
        if len(self.n) <= BLOCK or len(self.pivots) >= PIVOTS or any(d[x] <= self.own_limit[x] for d in self.pivots):
            return
        out = np.empty(len(self.n), dtype=np.int32)
        for at in range(0, len(out), 4096):
            out[at:at + 4096] = apart(self.bits[x], self.bits[at:at + 4096])
        self.pivots.append(out)


def list_pairs(vertex, n, pos, central, comp, side, bits, first_round: bool, percent: int = PERCENT) -> np.ndarray:
    """Pairs of a list that must be checked. comp: component so far; side: 0 and 1 for a list's two blocks (only pairs
    across are wanted), 2 where all pairs are. In the first round, pairs that tie the list together; else all pairs that are left."""
    by = np.lexsort((vertex, pos, n))
    vertex, n, pos, central, comp, side = (a[by] for a in (vertex, n, pos, central, comp, side))
    answers = _Answers(n, pos, [bits[i] for i in by], percent)
    group = np.unique(comp, return_inverse=True)[1]
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    # sets that share most go first: a centre answers for its copies, the same one in all lists
    todo = np.lexsort((vertex, -central))
    if not first_round:
        for x in todo:
            answers.answer_all(x)
            y = answers.partners(x, np.flatnonzero((group != group[x]) & (vertex > vertex[x]) & ((side == 2) | (side != side[x]))))
            pairs.append(np.stack((np.full(len(y), vertex[x]), vertex[y]), axis=1))
        return np.concatenate(pairs)
    done = np.zeros(len(n), dtype=bool)
    for x in todo:
        if done[x]:
            continue
        queue = [x]
        done[x] = True
        while queue:
            x = queue.pop()
            answers.answer_all(x)
            y = answers.partners(x, np.flatnonzero((group != group[x]) & ((side == 2) | (side != side[x]))))
            y = y[np.lexsort((vertex[y], -central[y]))]
            tied, first = np.unique(group[y], return_index=True)  # one pair for each group that is tied now
            k = y[np.sort(first)]
            pairs.append(np.stack((np.minimum(vertex[x], vertex[k]), np.maximum(vertex[x], vertex[k])), axis=1))
            group[np.isin(group, tied)] = group[x]
            new = y[~done[y]]
            done[new] = True
            queue.extend(new.tolist())
    return np.concatenate(pairs)


def _bitmaps(vertices: DataFrame, lists: DataFrame) -> DataFrame:
    """(vertex, n, bits, central) of the vertices in lists, each once; central is the number of prefix shingles it shares."""
    central = lists.groupBy("vertex").agg(F.sum("shared").alias("central"))
    return (vertices.where("bits is not null").select("vertex", "n", "bits").join(central, "vertex").dropDuplicates(["vertex"]))


def _candidates(lists: DataFrame, bitmaps: DataFrame, comps: DataFrame | None, first_round: bool, percent: int) -> DataFrame:
    """Distinct pairs (a, b) to check, over all lists whose members are not all connected yet."""
    if comps is None:
        rows = lists.withColumn("comp", F.col("vertex"))
    else:
        rows = lists.join(comps, "vertex", "left").withColumn("comp", F.coalesce("component", "vertex")).drop("component")
        of = ["list", "low", "high", "members"]
        open_ = stored(rows.groupBy(*of).agg((F.min("comp") < F.max("comp")).alias("open")).where("open").drop("open"), "jaccard_open")
        # a list tells by itself how many members it has
        rows = join_unique(rows, open_, of, "left_semi", counts=(open_, "members"))
    # large lists: each member goes to the pairs of blocks that its own block is in
    blocks = F.ceil(F.col("members") / LIST_LIMIT).cast("int")
    mine = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    rows = (rows.withColumn("blocks", blocks).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
            .withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("mine") == F.col("i"), 0).otherwise(1)))
    key = ["list", "low", "high", "members", "i", "j"]
    rows = rows.join(bitmaps, "vertex").select(*key, "vertex", "n", "pos", "central", "comp", "side", "bits")

    def run(batches):
        held, last = [], None

        def pairs_of(part):
            col = lambda c, t: part.column(c).to_numpy(zero_copy_only=False).astype(t)
            vertex = col("vertex", np.int64)
            if len(vertex) < 2:
                return np.zeros((0, 2), dtype=np.int64)
            return list_pairs(vertex, col("n", np.int64), col("pos", np.int64), col("central", np.int64), col("comp", np.int64),
                              col("side", np.int8), part.column("bits").to_pylist(), first_round, percent)

        sent = set()  # of the last lists; lists of one cluster ask for the same pairs again and again

        def out(pairs):
            if len(sent) > 500_000:
                sent.clear()
            new = [p for p in dict.fromkeys(map(tuple, np.concatenate(pairs).tolist())) if p not in sent]
            sent.update(new)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], ["a", "b"])

        for batch in batches:  # sorted by key: a list may go on in the next batch
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            keys = np.stack([whole.column(c).to_numpy() for c in key], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = tuple(keys[a].tolist())
                if held and k != last:
                    found.append(pairs_of(pa.concat_tables(held).combine_chunks()))
                    held = []
                    if sum(map(len, found)) > 20_000:
                        yield out(found)
                        found = []
                held.append(whole.slice(a, b - a))
                last = k
            if found:
                yield out(found)
        if held:
            yield out([pairs_of(pa.concat_tables(held).combine_chunks())])

    rows = rows.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key)
    return rows.mapInArrow(run, "a long, b long").distinct()


def _checked(pairs: DataFrame, docs: DataFrame, vertices: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose exact overlap makes a link."""
    sets = stored(_sets(docs, vertices, pairs, size), "jaccard_sets")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("y"))
    links = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard_links")
    free(sets)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: id, text_hash, n (size of its set), vertex (null: empty set), component (a vertex; null: empty set)."""
    lean_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = stored(_vertices(docs, _frequent(docs, size), size, percent), "jaccard_vertices")
    vertices, copies = _told_apart(found)
    lists = _lists(vertices)
    bitmaps = stored(_bitmaps(vertices, lists), "jaccard_bitmaps")
    first = stored(_candidates(lists, bitmaps, None, True, percent), "jaccard_pairs")
    links = _checked(first, docs, vertices, size, percent)
    comps = stored(components(links), "jaccard_components")
    # a set that could be linked at all has a pair in the first round
    active = stored(first.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "jaccard_active")
    left = lists.join(active, "vertex", "left_semi")
    rest = stored(_candidates(left, bitmaps, comps, False, percent).join(first, ["a", "b"], "left_anti"), "jaccard_pairs")
    more = _checked(rest, docs, vertices, size, percent)
    if not more.isEmpty():
        comps = stored(components(links.unionByName(more)), "jaccard_components")
    free(lists, bitmaps, first, active, rest, links, more)
    joined = (join_unique(vertices.select("id", "text_hash", "n", "vertex"), comps, ["vertex"], "left", counts=(copies, "times"), nulls_apart=True)
                .select("id", "text_hash", "n", "vertex", F.coalesce("component", "vertex").alias("component")))
    joined = stored(joined, "jaccard_joined")
    free(found, comps)
    return joined


def with_smallest_id(joined: DataFrame) -> DataFrame:
    """(id, n, vertex, component_id): the smallest id of the component; documents without words are their own."""
    smallest = stored(joined.where("component is not null").groupBy("component").agg(F.min("id").alias("smallest"), F.count("*").alias("times")),
                      "jaccard_smallest")
    return (join_unique(joined, smallest, ["component"], "left", counts=(smallest, "times"), nulls_apart=True)
            .select("id", "n", "vertex", F.coalesce("smallest", "id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, unchanged, without those that are linked with a row that stays.

    Of each component the row with the smallest id stays (null ids last, then by a hash of the text; of rows equal in
    both, one). Rows without words are linked with nothing and stay.
    """
    joined = join(docs, id_col, text_col, size, percent)
    first = (joined.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")).alias("doc"))
             .select("doc.*").distinct())
    key = lambda id_, hash_: [F.xxhash64(id_, id_.isNull()).alias("k1"), hash_.alias("k2")]
    first = stored(first.select(*key(F.col("id"), F.col("text_hash")), F.lit(True).alias("stays")), "jaccard_stays")
    free(joined)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("row"), *key(F.col(id_col), F.xxhash64(text)),
                       F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"))
    left = rows.join(first, ["k1", "k2"], "left").where("stays OR NOT has_words")
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("has_words"))
    return left.withColumn("place", place).where("NOT has_words OR place = 1").select("row.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by a Jaccard similarity of 0.8 of their 5-word shingles."""
    out = with_smallest_id(join(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
    FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN sizes USING (r)
JOIN (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x) USING (r)
"""
