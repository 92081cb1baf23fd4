"""Exact text search over a corpus.

Semantics of the search: case-sensitive, literal (no pattern signs), matches
found left to right and never overlapping (the next search starts where the
last match ended, so ``aa`` occurs twice in ``aaaa``), offsets counted in
characters (code points), 0-based, end exclusive. An empty needle finds
nothing. Whole texts are searched.

T1 splits each text at the needle, and a match ends where the pieces before it
and the needles between them end: a running sum over the pieces' lengths. It
is summed in blocks, whose totals are summed the same way (``running_sums``),
so its cost is in proportion to the matches, dense needles included. All of it
is one expression of the JVM on each row: nothing is shuffled, rows are
independent, and repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks placed around a highlighted match.
MARK_OPEN = "<mark>"
MARK_CLOSE = "</mark>"


def quote_pattern(needle: str) -> str:
    """Java-regex quoting of a literal (what ``Pattern.quote`` returns): the
    text between ``\\Q`` and ``\\E``, with any ``\\E`` inside split out."""
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: Numbers that are summed one by one, each sum appended to an array (a copy of at most this length).
BLOCK = 32


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda a Column used twice is evaluated twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column, levels: int = 2) -> Column:
    """The running sums of an array of numbers, as array<bigint>.

    Blocks of ``BLOCK`` numbers get running sums of their own, then the sums of
    the block totals (by the same rule, ``levels`` deep) are added to
    them. With two levels the one-by-one part has at most one number for every 1024.
    """
    if not levels:
        def append(sums, x):
            return F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0).cast("long")) + x)
        return F.aggregate(numbers, F.array().cast("array<bigint>"), append)

    def from_blocks(blocks):
        before = F.array_insert(running_sums(F.transform(blocks, lambda b: F.element_at(b, -1)), levels - 1), 1, F.lit(0).cast("long"))
        return F.flatten(_bound(before, lambda sums: F.transform(
            blocks, lambda b, i: _bound(F.get(sums, i), lambda more: F.transform(b, lambda x: x + more)))))

    def in_blocks(all_numbers):
        return F.transform(F.sequence(F.lit(1), F.size(all_numbers), F.lit(BLOCK)),
                           lambda at: running_sums(F.slice(all_numbers, at, F.lit(BLOCK)), 0))
    return _bound(numbers, lambda n: F.when(F.size(n) == 0, F.array().cast("array<bigint>")).otherwise(_bound(in_blocks(n), from_blocks)))


def find_spans(df: DataFrame, id_col: str, text_col: str, needle: str) -> DataFrame:
    """Every match of ``needle`` in every text, as
    (``id_col``, match_no, start, end); match_no counts from 0 per text."""
    width = len(needle)
    if not needle:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, match_no int, start long, end long")
    pieces = F.split(F.col(text_col), quote_pattern(needle), -1)
    # the last piece ends at the end of the text, all others at a match
    ends = running_sums(_bound(pieces, lambda all_pieces: F.transform(
        F.slice(all_pieces, F.lit(1), F.size(all_pieces) - 1), lambda p: (F.length(p) + width).cast("long"))))
    # every text left has a match, so the outer generator adds no rows; it gets no inferred filter that splits again
    return (df.where(F.col(text_col).contains(needle))
            .select(F.col(id_col), F.posexplode_outer(ends).alias("match_no", "end"))
            .select(id_col, "match_no", (F.col("end") - width).alias("start"), "end"))


def highlight(text: Column | str, needle: str, open_mark: str = MARK_OPEN,
              close_mark: str = MARK_CLOSE) -> Column:
    """Every match wrapped in the marks (same matches as ``find_spans``)."""
    t = F.col(text) if isinstance(text, str) else text
    if not needle:
        return t
    return F.replace(t, F.lit(needle), F.lit(open_mark + needle + close_mark))


def clear_marks(text: Column | str, open_mark: str = MARK_OPEN, close_mark: str = MARK_CLOSE) -> Column:
    """Remove all marks, leaving the plain text (inverse of ``highlight``
    for a text that held no mark before)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.replace(F.replace(t, F.lit(open_mark), F.lit("")), F.lit(close_mark), F.lit(""))
