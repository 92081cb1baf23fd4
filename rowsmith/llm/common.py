"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rowsmith.session import stored  # noqa: F401  (the operators cut their lineage with it)

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

# UTF-8 bytes that separate words: space and \\x09-\\x0D, exactly what bytes.split() splits at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def lean_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Documents are wide rows: from now on at most ``rows`` of this session's rows go to Python in one Arrow batch.

    A batch lies outside the heap of the executor's JVM and once more in its Python worker, and so does what comes back. A session
    that asks for fewer rows already keeps its setting.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows, so that few of their texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def codepoints(text: str) -> np.ndarray:
    """The code points of ``text`` as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
