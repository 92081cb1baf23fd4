"""M7's key generator: a sequence whose mark outlives the rows it numbered.

The state is a folder of small files, one a reservation, numbered without
gaps: each holds the reserved range and the name of the run that holds it. A
new file appears by a rename that fails when the name is taken, so of two jobs that
reserve at once one wins and the other reads again; a job that dies before the
rename leaves nothing, one that dies after it leaves a range that nobody
else gets. A run that is repeated under its name finds its own range again and
gives the same keys.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class KeyGenerator:
    """Ranges of keys from the state in ``folder`` (on a file system whose rename is atomic, as HDFS is)."""

    def __init__(self, spark: SparkSession, folder: str):
        sc = spark.sparkContext
        self._jvm, self._gateway = sc._jvm, sc._gateway
        self._root = self._path(folder.rstrip("/"))
        conf = sc._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), conf)
        self._fs.mkdirs(self._root)

    def _path(self, *parts):
        return self._jvm.org.apache.hadoop.fs.Path(*parts)

    def _reservations(self) -> list[dict]:
        """All reservations, oldest first."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._root))
        out = []
        for name in names:
            if name.isdigit():
                stream = self._fs.open(self._path(self._root, name))
                try:
                    out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return out

    def mark(self) -> int:
        """The highest key ever reserved (0 at first)."""
        return max((r["end"] for r in self._reservations()), default=0)

    def _commit(self, number: int, start: int, end: int, run: str) -> bool:
        """Make reservation ``number`` visible at once, or not at all; False if another job has made it."""
        hidden = self._path(self._root, f"_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden)
        stream.writeBytes(json.dumps({"start": start, "end": end, "run": run}))  # plain ASCII
        stream.close()
        no_options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        final = self._path(self._root, f"{number:012d}")
        try:
            self._files.rename(hidden, final, no_options)
            return True
        except Exception:
            self._fs.delete(hidden, False)
            if self._fs.exists(final):
                return False
            raise

    def reserve(self, n: int, run: str | None = None) -> int:
        """The first of ``n`` keys that no other run gets, all above every key reserved before.

        A ``run`` that reserved before gets its range again if it has room for ``n`` keys, else a new one.
        """
        if n < 0:
            raise ValueError("a negative number of keys")
        run = run or uuid.uuid4().hex
        while True:
            done = self._reservations()
            for r in done:
                if r["run"] == run and r["end"] - r["start"] + 1 >= n:
                    return r["start"]
            start = max((r["end"] for r in done), default=0) + 1
            if not n or self._commit(len(done), start, start + n - 1, run):
                return start

    def advance_to(self, key: int) -> None:
        """Never give out ``key`` or a smaller one from now on."""
        while (mark := self.mark()) < key:
            self._commit(len(self._reservations()), mark + 1, key, f"advance-{uuid.uuid4().hex}")


__all__ = ["KeyGenerator"]
