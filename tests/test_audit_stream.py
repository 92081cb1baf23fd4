"""D1 on a stream: batches of files, restarts, late and repeated versions, against the snapshot diff."""

import glob

from pyspark.sql import functions as F

from helpers import local_path, rows
from rowsmith.operators import audit
from rowsmith.session import delete_path, list_names, scratch_path
from rowsmith.streaming import audit_stream
from rowsmith.streaming.audit_stream import audit_files, follow, read_audit, start_audit

AS_OF = "2000-01-01 00:00:00"
SCHEMA = "k long, v double, version int"


def arrive(spark, folder, data, schema=SCHEMA):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, root, **kw):
    schema = spark.createDataFrame([], SCHEMA).schema
    q = start_audit(spark, folder, schema, ["k"], "v", "version", root, f"{root}/_cp", AS_OF, "me", **kw)
    q.awaitTermination()
    assert q.exception() is None
    return rows(read_audit(spark, root, schema, ["k"]), "k", "old_value", "new_value")


def test_arrivals_in_batches_and_after_a_restart(spark):
    folder, root = scratch_path(spark, "in"), scratch_path(spark, "out")
    arrive(spark, folder, [(1, 10.0, 0), (2, 20.0, 0), (3, None, 0), (None, 1.0, 0), (4, 0.0, 0)])
    assert run(spark, folder, root) == []
    arrive(spark, folder, [(1, 11.0, 1), (2, 20.0, 1), (3, 5.0, 1), (5, 1.0, 1), (4, 1.0, 1)])
    assert run(spark, folder, root) == [(1, 10.0, 11.0), (4, 0.0, 1.0)]  # the stream goes on with its state
    arrive(spark, folder, [(1, 12.0, 3), (1, 11.5, 2), (2, None, 2), (3, 6.0, 2), (1, 12.0, 4)])
    arrive(spark, folder, [(1, 99.0, 1), (2, 21.0, 3), (2, 22.0, None), (5, 2.0, 2), (5, 3.0, 5)])  # a late one, a NULL before, one without an order
    want = [(1, 10.0, 11.0), (1, 11.0, 11.5), (1, 11.5, 12.0), (3, 5.0, 6.0), (4, 0.0, 1.0), (5, 1.0, 2.0), (5, 2.0, 3.0)]
    assert run(spark, folder, root, max_files_per_trigger=1) == want
    assert run(spark, folder, root) == want  # nothing new, nothing twice
    assert len([n for n in list_names(spark, f"{root}/state")]) == 2
    zero = spark.read.parquet(f"{root}/rows").where("k = 4").first()
    assert zero["percent_change"] is None and zero["updater_id"] == "me"


def test_equals_the_snapshot_diff(spark):
    folder = scratch_path(spark, "in")
    old = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("v"))
    new = old.withColumn("v", F.when(F.col("k") % 3 == 0, F.col("v") * 1.1).otherwise(F.col("v")))
    old.withColumn("version", F.lit(0)).write.mode("append").parquet(folder)
    new.withColumn("version", F.lit(1)).write.mode("append").parquet(folder)
    assert len(glob.glob(local_path(folder) + "/*.parquet")) > 2
    want = rows(audit.audit_changes(old, new, ["k"], "v", AS_OF, "me"))
    schema = spark.read.parquet(folder).schema
    got = audit_files(spark, folder, schema, ["k"], "v", "version", AS_OF, "me", max_files_per_trigger=2)
    assert got.columns == audit.audit_changes(old, new, ["k"], "v", AS_OF, "me").columns
    assert rows(got) == want and len(want) > 900


def test_a_batch_that_runs_again_writes_the_same(spark):
    """A batch dies after its state and rows are written, before the stream's commit: the next start runs it again."""
    folder, root = scratch_path(spark, "in"), scratch_path(spark, "out")
    for version in range(3):
        arrive(spark, folder, [(k, float(k * version), version) for k in range(4)])
        want = run(spark, folder, root)
    commits = sorted(int(n) for n in list_names(spark, f"{root}/_cp/commits") if n.isdigit())
    delete_path(spark, f"{root}/_cp/commits/{commits[-1]}")
    delete_path(spark, f"{root}/_cp/commits/.{commits[-1]}.crc")
    delete_path(spark, f"{root}/state/{commits[-1]}/_SUCCESS")
    assert run(spark, folder, root) == want and len(want) == 6


def test_follow_equals_a_plain_walk(spark):
    import random
    rng = random.Random(3)
    state, kept, audits = None, {}, []
    for batch in range(4):
        data = [(rng.randrange(12), rng.randrange(6 * (batch + 1)), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(40)]
        out = follow(state, spark.createDataFrame(data, "k int, __at long, __value double"), ["k"]).collect()
        state = spark.createDataFrame([tuple(r)[:3] for r in out if r["last"]], "k int, __at long, __value double")
        seen, want = dict(kept), []
        for k, at, v in sorted(data, key=lambda r: (r[0], r[1], (r[2] is not None, r[2] or 0))):
            if k in seen and at < seen[k][0]:
                continue
            if k in kept and None not in (v, kept[k][1]) and v != kept[k][1]:
                want.append((k, kept[k][1], v))
            kept[k] = (at, v)
        assert sorted((r["k"], r["__old"], r["__value"]) for r in out if r["changed"]) == sorted(want)
        assert {r["k"]: (r["__at"], r["__value"]) for r in out if r["last"]} == kept
        audits += want
    assert len(audits) > 40


def test_a_batch_exchanges_and_writes_its_own_keys_only(spark, monkeypatch):
    """Small batches against a large state: a batch follows on the state's rows of its keys, which are read where they lie."""
    folder, root, states = scratch_path(spark, "in"), scratch_path(spark, "out"), []

    def seen(state, *a):
        if state is not None:
            states.append((state.count(), state._jdf.queryExecution().executedPlan().toString()))
        return follow(state, *a)

    monkeypatch.setattr(audit_stream, "follow", seen)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # neither side is small
    try:
        arrive(spark, folder, [(k, 1.0, 0) for k in range(2000)])
        run(spark, folder, root)
        for version in range(1, 7):
            arrive(spark, folder, [(k, 1.0 + version, version) for k in range(version, 2000, 200)])
        got = run(spark, folder, root, max_files_per_trigger=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == sorted((k, 1.0, 1.0 + k % 200) for k in range(2000) if 1 <= k % 200 <= 6)
    assert [n for n, _ in states] == [10] * 6
    assert all(plan.count("Exchange hashpartitioning") == 1 and "Join" in plan for _, plan in states)  # that of the batch's keys
    written = spark.read.parquet(f"{root}/parts")
    assert written.count() <= 2000 + 6 * 10 * 3


def test_parts_are_few_and_hold_the_newest(spark, monkeypatch):
    """Many batches on the same keys: the state is merged on the way and no audit row is lost or comes twice."""
    folder, root = scratch_path(spark, "in"), scratch_path(spark, "out")
    monkeypatch.setattr(audit_stream, "MERGE_AT", 2)
    for version in range(9):
        arrive(spark, folder, [(k, None if k == 3 else float(version * k), version) for k in range(version % 2, 6)] + [(None, 1.0, version)])
        got = run(spark, folder, root)
        assert len([n for n in list_names(spark, f"{root}/parts") if n.startswith("__part=")]) <= 8
    want, last = [], {}
    for version in range(9):
        for k in range(version % 2, 6):
            new = None if k == 3 else float(version * k)
            if None not in (new, last.get(k)) and new != last[k]:
                want.append((k, last[k], new))
            last[k] = new
    assert got == sorted(want) and len(want) == 32
    listed = spark.read.parquet(f"{root}/state/8").orderBy("__part").collect()
    assert len(listed) <= 4 and sum(r["rows"] for r in listed) <= 6 * 3


def test_which_parts_are_merged():
    assert [audit_stream._merge_from(n) for n in ([], [5], [1, 1, 1], [1, 1, 1, 1], [9, 1, 1, 1], [9, 1, 1, 1, 1], [9, 8, 9, 10])] == [0, 1, 3, 0, 4, 1, 0]


def test_batches_without_rows_and_a_restart(spark):
    folder, root = scratch_path(spark, "in"), scratch_path(spark, "out")
    arrive(spark, folder, [(None, 1.0, 0)])
    assert run(spark, folder, root) == []
    arrive(spark, folder, [(1, 1.0, 0)])
    assert run(spark, folder, root) == []
    arrive(spark, folder, [(1, 1.0, None)])
    assert run(spark, folder, root) == []
    arrive(spark, folder, [(1, 2.0, 1)])
    assert run(spark, folder, root) == [(1, 1.0, 2.0)]
