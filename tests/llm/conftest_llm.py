import os
import random
import sys
import zlib

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def documents(spark, texts, lang="en", source="s"):
    """A documents table of (id, text) pairs or of texts, with two extra columns whose names clash."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        [(i, t, lang, source, None if t is None else len(t), "x", 1) for i, t in rows],
        DOCS + ", kept string, shard long")


def words(rng: random.Random, n: int, vocabulary: int = 500) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def same_as_sql(spark, name, sf_dir=SMALL, views=None):
    """A catalogued query's rows equal its DuckDB SQL's, as sorted tuples of strings."""
    import duckdb

    from rowsmith.llm.catalog import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if views else ''}')")
    found = QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    expected = con.execute(ORACLE_SQL[name])
    at = [d[0] for d in expected.description]
    assert sorted(at) == names
    key = lambda rows: sorted(map(str, rows))
    want = key(tuple(r[at.index(n)] for n in names) for r in expected.fetchall())
    assert key(tuple(r) for r in found.select(names).collect()) == want
    return len(want)
