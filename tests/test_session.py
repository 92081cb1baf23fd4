"""Session helpers: the checkpoint folder comes from the session; scale sizing."""

import pytest

from rowsmith.session import checkpoint_root, path_kind, require_unique, scale_conf, scratch_path, small, stored


def test_checkpoint_root_is_the_sessions(spark):
    root = checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root.rstrip("/") + "/x/")


def test_cluster_without_a_shared_folder_raises():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"
        getCheckpointDir = getConf = lambda self: None

    class Session:
        sparkContext, conf = Context(), Conf()
    Context.getConf = lambda self: Conf()
    with pytest.raises(RuntimeError):
        checkpoint_root(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_stored_small_and_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, v string")
    kept = stored(df, "test")
    assert kept.schema == df.schema and kept.exceptAll(df).count() == 0 and kept.count() == 4
    assert path_kind(spark, kept.inputFiles()[0]) == "file" and path_kind(spark, "/nowhere/at/all") is None
    assert require_unique(df, ["k"], "t") is df
    with pytest.raises(ValueError):
        require_unique(df.unionByName(df), ["k"], "t")
    assert "broadcast" in small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(df, 3)._jdf.queryExecution().logical().toString().lower()


def test_scale_conf(caplog):
    big = scale_conf(100 * 2**40, 8000)
    assert "instead of 409600" in caplog.text  # a shuffle of the whole input would be larger a partition than asked
    assert big["spark.sql.shuffle.partitions"] == "200000"
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(1 << 30, 64)
    assert small["spark.sql.shuffle.partitions"] == "128"  # two waves of cores
    mid = scale_conf(1 << 40, 64)
    assert mid["spark.sql.shuffle.partitions"] == str((1 << 40) // (256 << 20))


def test_cli_list_and_run(spark, capsys):
    import glob
    from rowsmith.__main__ import main
    from helpers import local_path
    from rowsmith.plans.catalog import all_queries
    assert main(["list"]) == 0
    listed = capsys.readouterr().out.splitlines()
    assert len(listed) == len(all_queries()) >= 69 and any(line.endswith("report_phone_list") for line in listed)
    out = scratch_path(spark, "cli")
    assert main(["run", "report_phone_list", "--tables", "/root/testdata/sf0.001", "--out", out]) == 0
    assert spark.read.parquet(out).count() == 342
    assert glob.glob(local_path(out) + "/*.parquet")


def test_uniqueness_is_counted_in_the_jobs_that_run_anyway(spark):
    import pytest
    from rowsmith import session
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "b"), (None, "b")], "k int, v string")
    assert session.key_counts(df, ["k"]) == (4, 1) and session.key_counts(df, ["v"]) == (4, 3)
    assert session.key_counts(df.limit(0), ["k"]) == (0, 0) and session.require_all_unique([]) == []
    assert session.require_all_unique([(df, ["k"], "x"), (df.where("v = 'a'"), ["v"], "y")])[0] is df
    with pytest.raises(ValueError, match="y holds a key more than once: v"):
        session.require_all_unique([(df, ["k"], "x"), (df, ["v"], "y")])
    assert session.stored_lookup(df, ["k"], "t").count() == 4  # a NULL is no key
    assert session.stored_lookup(df, ["k"], "t", max_rows=3).count() == 4
    assert session.stored_lookup(df.limit(0), ["k"], "t").columns == ["k", "v"]
    with pytest.raises(ValueError, match="more than once: v"):
        session.stored_lookup(df, ["v"], "t")
