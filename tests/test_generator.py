"""M7's generator: marks that outlive rows, ranges that never overlap, runs that can be repeated."""

import os
import threading

import pytest
from hypothesis import given, settings, strategies as st

from helpers import local_path, rows
from rowsmith.operators import changes
from rowsmith.operators.generator import KeyGenerator
from rowsmith.session import scratch_path


def frame(spark, *names, keyed=()):
    return spark.createDataFrame([(k, n) for k, n in keyed] + [(None, n) for n in names], "k int, n string")


def test_a_deleted_highest_key_is_not_given_again(spark):
    folder = scratch_path(spark, "generator")
    first = changes.assign_keys(frame(spark, "a", "b", keyed=[(7, "z")]), "k", ["n"], generator=KeyGenerator(spark, folder), run="1")
    assert rows(first) == [(7, "z"), (8, "a"), (9, "b")]
    left = first.where("k < 9")
    second = changes.assign_keys(left.unionByName(frame(spark, "c")), "k", ["n"], generator=KeyGenerator(spark, folder), run="2")
    assert rows(second) == [(7, "z"), (8, "a"), (10, "c")]
    # the mark alone would give 9 a second time
    assert rows(changes.assign_keys(left.unionByName(frame(spark, "c")), "k", ["n"]))[-1] == (9, "c")


def test_a_repeated_run_gives_the_same_keys_and_a_failed_one_no_overlap(spark):
    folder = scratch_path(spark, "generator")
    keys = KeyGenerator(spark, folder)
    once = rows(changes.assign_keys(frame(spark, "a", "b"), "k", ["n"], generator=keys, run="load-7"))
    dead = keys.reserve(5, "died after its reservation")
    open(local_path(folder) + "/_died-before-the-rename", "w").close()
    other = rows(changes.assign_keys(frame(spark, "c"), "k", ["n"], generator=keys, run="load-8"))
    again = rows(changes.assign_keys(frame(spark, "a", "b"), "k", ["n"], generator=KeyGenerator(spark, folder), run="load-7"))
    assert once == again == [(1, "a"), (2, "b")] and dead == 3 and other == [(8, "c")]
    # more rows than the run's range holds: a new range
    assert rows(changes.assign_keys(frame(spark, "a", "b", "d"), "k", ["n"], generator=keys, run="load-7"))[0] == (9, "a")


def test_jobs_at_once_get_different_ranges(spark):
    folder = scratch_path(spark, "generator")
    got = []

    def job(i):
        keys = KeyGenerator(spark, folder)
        got.extend((keys.reserve(3, f"{i}-{j}"), 3) for j in range(4))

    threads = [threading.Thread(target=job, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    taken = sorted(k for start, n in got for k in range(start, start + n))
    assert taken == list(range(1, 61)) and KeyGenerator(spark, folder).mark() == 60


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.booleans()), max_size=12))
def test_ranges_never_overlap(spark, steps):
    keys = KeyGenerator(spark, scratch_path(spark, "generator"))
    ranges = {}
    for n, run, advance in steps:
        if advance:
            keys.advance_to(keys.mark() + n)
            continue
        start = keys.reserve(n, str(run))
        if n:
            ranges[(str(run), start)] = max(n, ranges.get((str(run), start), 0))
    taken = [k for (_, start), n in ranges.items() for k in range(start, start + n)]
    assert len(taken) == len(set(taken)) and max(taken, default=0) <= keys.mark()


def test_refusals(spark):
    keys = KeyGenerator(spark, scratch_path(spark, "generator"))
    with pytest.raises(ValueError):
        keys.reserve(-1)
    with pytest.raises(ValueError):
        changes.assign_keys(frame(spark, "a"), "k", ["n"], start_after=3, generator=keys)
    assert keys.mark() == 0 and rows(changes.assign_keys(frame(spark), "k", ["n"], generator=keys)) == []
    assert os.listdir(local_path(keys._root.toString())) == []
