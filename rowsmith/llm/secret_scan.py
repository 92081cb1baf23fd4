"""Secret scans judged by how widely each candidate is held in the corpus.

Three base patterns find credentials in whole texts (``BASE``), leftmost and
non-overlapping per kind: an assignment to a name such as ``password``, an
access key id, a long run of lower-case hex digits. A fourth one, ``token``,
finds runs of 20 or more letters, digits, ``_`` and ``-`` that no base span
touches and that look drawn at random: at least ``MIN_MIXED`` letters and as many
digits, and ``MIN_BITS`` bits of entropy a character.

No pattern tells a live credential from a value that many people copied out of
a manual, so candidates are judged over the corpus: every candidate's hash (128
bits; values never leave the task that read them) is counted over distinct
owners, and over distinct repositories of these owners.

* ``example``: held by more than ``max_owners`` owners or ``max_repos`` repositories. Widely copied.
* ``live``: held by few, and it looks drawn at random and like no placeholder.
* ``weak``: held by few but plain, such as ``changeme``.

Base spans always stay; a ``token`` span is added where its value is ``live``.

An owner is the value of ``owner_col`` and a repository a pair of it and ``repo_col``;
all rows without an owner count as one owner, without a repository likewise.
A null text is empty. Texts are read whole; matching is linear in them. A
repeated document is judged each time and adds no owner. An empty table gives an empty
result. Only the named columns are read, so extra columns of any name do no harm.

How it runs: one pass over the texts in Arrow batches stores a short row per
document with its candidates. Counts per (hash, owner, repository) and per hash are
map-side combined. The verdicts are joined back through
``operators.skew.join_unique``: a value that a third of all rows hold meets its
verdict by broadcast and is never gathered in one task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsmith.llm.common import slices, stored, table
from rowsmith.operators.skew import join_unique

KINDS = ("assign", "access", "hex", "token")
MAX_OWNERS = 2
MAX_REPOS = 4
MIN_BITS = 3.0
MIN_MIXED = 2

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A name of an assignment, to pass over the texts without any.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
_PLACEHOLDER = re.compile(r"example|sample|change_?me|dummy|placeholder|your|test|x{4}|0{6}|1234", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base kinds, in code points, ordered by start and kind.

    A run of key characters or hex digits is maximal, so asking for its least length finds what matching any length
    and dropping the short ones does. An assignment's value is matched at any length first: a short one uses up the
    text that it matched.
    """
    found = []
    lower = text.lower()
    if any(n in lower for n in _NAMES):
        found = [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    """Shannon entropy of the characters of ``value``, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    # a hair below the limit, so that rounding cannot decide
    return min(digits, letters) >= MIN_MIXED and entropy(value) >= MIN_BITS - 1e-9 and not _PLACEHOLDER.search(value)


def token_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs that look drawn at random and that no base span touches."""
    out, at = [], 0
    reach = 0  # the furthest end of the base spans that begin before the run
    for m in _TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and looks_random(m[0]):
            out.append((m.start(), m.end(), 3, m[0]))
    return out


def spell(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind, *_ in spans)


_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("hash", pa.binary()), ("random", pa.bool_())])
_SCANNED = ("n_assign long, n_access long, n_hex long, base_sha256 string, "
            "candidates array<struct<start: long, end: long, kind: int, hash: binary, random: boolean>>")


def scan_texts(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row a document: id, owner, repository, counts and digest of the base spans, and all candidates."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            counts, digests, candidates = [], [], []
            for t in batch.column(4):
                text = t.as_py() or ""
                base = base_spans(text)
                counts.append([sum(s[2] == kind for s in base) for kind in range(3)])
                digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
                candidates.append([{"start": a, "end": b, "kind": kind, "random": looks_random(value),
                                    "hash": hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
                                   for a, b, kind, value in sorted(base + token_spans(text, base))])
            n = list(zip(*counts)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(c, pa.int64()) for c in n), pa.array(digests, pa.string()),
                 pa.array(candidates, pa.list_(_CANDIDATE))],
                names=["row", "id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"])

    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                        F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
                        F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"row long, id {id_type}, owner string, repo string, {_SCANNED}"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per hash of (hash, owner, repo) rows: distinct owners, distinct repositories of owners, all occurrences."""
    held = (candidates.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
            .agg(F.count(F.lit(1)).alias("n")))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n"))


def _spelled(spans) -> F.Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "lang", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per document: the id, n_assign, n_access, n_hex, base_sha256, the spans (base and live tokens), and by verdict
    the spans that are live and those that are widely copied examples, each as ``kind:start:end`` texts."""
    scanned = stored(scan_texts(docs, id_col, text_col, owner_col, repo_col), "secret_scan")
    counts = ["n_assign", "n_access", "n_hex", "base_sha256"]
    with_any = scanned.where(F.size("candidates") > 0)
    single = stored(with_any.select("row", "owner", "repo", F.explode("candidates").alias("c")).select("row", "owner", "repo", "c.*"),
                    "secret_candidates")
    verdict = (F.when((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos), "example")
               .when(F.col("random"), "live").otherwise("weak"))
    judged = (join_unique(single.drop("owner", "repo"), ownership(single).drop("n"), ["hash"])
              .select("row", F.struct("start", "kind", "end", verdict.alias("verdict")).alias("span"))
              .where("span.kind < 3 or span.verdict = 'live'"))
    # the candidates of one document: no more than its own text holds
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    of = lambda v: F.filter("spans", lambda s: s["verdict"] == v)
    found = spans.select("row", _spelled(F.col("spans")).alias("spans"), _spelled(of("live")).alias("live_spans"),
                         _spelled(of("example")).alias("example_spans"))
    texts = ["spans", "live_spans", "example_spans"]
    some = with_any.select("row", "id", *counts).join(found, "row", "left")
    none = scanned.where(F.size("candidates") == 0).select("row", "id", *counts, *(F.lit(None).cast("string").alias(c) for c in texts))
    return (some.select("row", "id", *counts, *texts).unionByName(none)
            .select(F.col("id").alias(id_col), *counts, *(F.coalesce(c, F.lit("")).alias(c) for c in texts)))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets; sources own documents, a source's repositories are its languages."""
    return find_secrets(table(spark, sf_dir, "documents"))


_NAME_SQL = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token")) \
    + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN_SQL = rf"""({_NAME_SQL})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches_sql(kind: int, pattern: str, value: int = 0) -> str:
    return (f"SELECT r, o, l, {kind} AS kind, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS m, "
            f"regexp_extract_all(t, '{pattern}', {value}) AS v FROM d")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, coalesce(lang, '') AS l FROM documents),
lists AS ({_matches_sql(0, _ASSIGN_SQL, 2)} UNION ALL {_matches_sql(1, 'AKIA[A-Z0-9]+')}
    UNION ALL {_matches_sql(2, '[0-9a-f]{24,}')} UNION ALL {_matches_sql(3, '[A-Za-z0-9_-]{20,}')}),
pieces AS (SELECT r, o, l, kind, unnest(m) AS m, unnest(v) AS v, generate_subscripts(m, 1) AS i, gaps, m AS ms FROM lists WHERE len(m) > 0),
spans AS (SELECT r, o, l, kind, v, s AS s, s + length(m) AS e FROM (SELECT *,
    coalesce(list_sum([length(x) FOR x IN gaps[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS s FROM pieces)
    WHERE kind IN (2, 3) OR (kind = 0 AND length(v) >= 6) OR (kind = 1 AND length(m) >= 20)),
marked AS (SELECT *, least(length(regexp_replace(v, '[^0-9]', '', 'g')), length(regexp_replace(v, '[^A-Za-z]', '', 'g'))) >= {MIN_MIXED}
    AND list_entropy(string_split(v, '')) >= {MIN_BITS} - 1e-9
    AND NOT regexp_matches(lower(v), '{_PLACEHOLDER.pattern}') AS random FROM spans),
candidates AS (SELECT * FROM marked a WHERE kind < 3 OR (random AND NOT EXISTS (
    SELECT 1 FROM marked b WHERE b.r = a.r AND b.kind < 3 AND b.s < a.e AND a.s < b.e))),
owned AS (SELECT v, count(DISTINCT o) AS owners, count(DISTINCT struct_pack(o := o, l := l)) AS repos FROM candidates GROUP BY v),
judged AS (SELECT r, s, kind, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || s || ':' || e AS span,
    CASE WHEN owners > {MAX_OWNERS} OR repos > {MAX_REPOS} THEN 'example' WHEN random THEN 'live' ELSE 'weak' END AS verdict
    FROM candidates JOIN owned USING (v)),
lines AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR verdict = 'live') AS spans,
    string_agg(span, ',' ORDER BY s, kind) FILTER (verdict = 'live') AS live,
    string_agg(span, ',' ORDER BY s, kind) FILTER (verdict = 'example' AND kind < 3) AS examples FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, '') AS live_spans, coalesce(examples, '') AS example_spans
FROM d LEFT JOIN lines USING (r)
"""
