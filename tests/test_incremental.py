from datetime import datetime, timedelta

import pytest

from symgraph.operators.incremental import CommitLog, committed_files, last_sights, pending_entries, pending_of, process_pending

T = datetime(2031, 3, 1)
WALK = "entry_id long, repo_id string, rel_path string, mtime_ns long, size long, hash string, seen_at timestamp, f string"
FILES = "file_id long, repo_id string, rel_path string, hash string, mtime_ns long, size long, indexed_at timestamp, w string"
RUNS = "run_id long, repo_id string, started_at timestamp, finished_at timestamp, status string, why string"


def h(n):
    return T + timedelta(hours=n)


def tables(spark, walk, files, runs):
    return spark.createDataFrame(walk, WALK), spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS)


def test_reasons(spark):
    runs = [(1, "r", h(0), h(30), "OK", ""), (2, "r", h(40), h(41), "failed", ""), (3, "r", h(50), None, "ok", "")]
    files = [
        (1, "r", "same", "h1", 5, 9, h(1), ""), (2, "r", "bytes", "h2", 5, 9, h(29), ""), (3, "r", "stat", "", None, 9, h(0), ""), (4, "r", "zero", None, None, 9, h(30), ""),
        (5, "r", "failed", "h5", 5, 9, h(40), ""), (6, "r", "open", "h6", 5, 9, h(55), ""), (7, "r", "newer", "old", 5, 9, h(1), ""), (7, "r", "newer", "new", 5, 9, h(2), ""),
    ]
    walk = [
        (1, "r", "./same", 6, 8, "h1", h(60), ""), (2, "r", "bytes", 5, 9, "h2x", h(60), ""), (3, "r", "stat", 1, 9, "h3", h(60), ""), (4, "r", "zero", 0, 9, "", h(60), ""),
        (5, "r", "failed", 5, 9, "h5", h(60), ""), (6, "r", "open", 5, 9, "h6", h(60), ""), (7, "r", "newer", 5, 9, "new", h(60), ""), (8, "r", "unseen", 5, 9, None, h(60), ""),
    ]
    got = {r.rel_path: r.why for r in pending_entries(*tables(spark, walk * 2, files * 2, runs * 2)).collect()}
    assert got == {"bytes": "bytes", "stat": "stat", "failed": "new", "open": "new", "unseen": "new"}


def test_last_sight_wins_and_ties_go_to_the_larger_entry(spark):
    walk = [(5, "r", "a", 1, 1, "x", h(1), ""), (9, "r", "./a", 2, 1, "y", h(1), ""), (20, "r", "a", 3, 1, "z", h(0), ""), (3, None, None, None, None, None, None, "")]
    got = {r.rel_path: r.entry_id for r in last_sights(spark.createDataFrame(walk, WALK)).collect()}
    assert got == {"a": 9, None: 3}


def test_empty_tables(spark):
    walk, files, runs = tables(spark, [], [], [])
    assert pending_entries(walk, files, runs).count() == 0
    one = spark.createDataFrame([(1, "r", "a", 1, 1, "x", h(1), "")], WALK)
    assert [r.why for r in pending_entries(one, files, runs).collect()] == ["new"]
    assert committed_files(files, runs).count() == 0


def test_run_over_several_days_holds_rows_once(spark):
    files = [(1, "r", "a", "h", 1, 1, h(k), "") for k in (0, 24, 48, 71)]
    runs = [(1, "r", h(0), h(71), "Ok", "")]
    _, f, r = tables(spark, [], files, runs)
    assert [x.indexed_at for x in committed_files(f, r).collect()] == [h(71)]


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    rows = lambda a, b: spark.createDataFrame([(k, f"v{k}") for k in range(a, b)], "seq long, v string")
    assert log.read() is None and log.watermark() == (0, None)
    assert log.run(rows(0, 0), "seq", lambda d: d) is None
    assert log.run(rows(0, 10), "seq", lambda d: d)["upto"] == 9

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.run(rows(0, 20), "seq", broken)
    assert log.watermark() == (1, 9)
    # A run that wrote its output but died before the commit leaves nothing that readers see.
    rows(10, 20).write.parquet(f"{tmp_path}/log/data/orphan")
    assert log.read().count() == 10
    assert log.run(rows(0, 20), "seq", lambda d: d) == {"low": 9, "upto": 19, "data": log.last()[1]["data"]}
    assert log.run(rows(0, 20), "seq", lambda d: d) is None
    assert sorted(r.seq for r in log.read().collect()) == list(range(20))
    # Of two runs for the same number one wins.
    assert log.commit(2, {"low": 9, "upto": 99, "data": "x"}) is False and log.watermark() == (2, 19)
    with pytest.raises(ValueError):
        log.run(spark.createDataFrame([(None, "x")], "seq long, v string"), "seq", lambda d: d)


def test_pending_through_the_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    runs = [(1, "r", h(0), h(30), "OK", "")]
    files = [(1, "r", "a", "ha", 5, 9, h(1), ""), (2, "r", "b", "hb", 5, 9, h(1), "")]
    first = [(1, "r", "a", 5, 9, "ha", h(40), ""), (2, "r", "./b", 5, 9, "hx", h(40), ""), (3, "r", "c", 5, 9, "hc", h(40), ""), (None, "r", "d", 1, 1, "q", h(50), "")]
    walk, f, r = tables(spark, first * 2, files, runs)
    got = lambda: sorted((x.run, x.entry_id, x.why) for x in pending_of(log).collect())
    assert got() == [] and process_pending(log, walk.limit(0), f, r) is None
    assert process_pending(log, walk, f, r)["upto"] == 3
    assert got() == [(1, 2, "bytes"), (1, 3, "new")]
    assert process_pending(log, walk, f, r) is None
    # Late rows: 4 is older than what was seen of b; 5 brings a back to new bytes; 6 is a new path.
    walk, f, r = tables(spark, [*first, (4, "r", "b", 5, 9, "hz", h(10), ""), (5, "r", "a", 6, 9, "hy", h(41), ""), (6, "r", "e", 6, 9, "", h(2), "")], files, runs)
    assert process_pending(log, walk, f, r)["low"] == 3
    assert got() == [(1, 2, "bytes"), (1, 3, "new"), (2, 5, "bytes"), (2, 6, "new")]
    assert log.compact(("sights", "pending")) and log.watermark() == (3, 6) and len(log.last()[1]["folders"]) == 1
    assert got() == [(1, 2, "bytes"), (1, 3, "new"), (2, 5, "bytes"), (2, 6, "new")]


def test_run_lost_between_output_and_commit(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    walk, f, r = tables(spark, [(1, "r", "a", 5, 9, "ha", h(40), "")], [], [])
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "finish", lambda self, part: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            process_pending(log, walk, f, r)
    assert log.watermark() == (0, None) and pending_of(log).count() == 0
    process_pending(log, walk, f, r)
    assert [x.entry_id for x in pending_of(log).collect()] == [1]


def test_of_two_runs_at_once_one_wins(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([(k,) for k in range(5)], "seq long")
    part, other = log.slice(rows, "seq"), log.slice(rows, "seq")
    for x in (part, other):
        x.rows.write.parquet(x.out)
    assert log.finish(part) and log.finish(other) is None
    assert sorted(r.seq for r in log.read().collect()) == list(range(5))


def test_only_what_is_above_the_watermark_is_scanned(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    spark.range(100).withColumnRenamed("id", "seq").write.parquet(f"{tmp_path}/t")
    log.run(spark.read.parquet(f"{tmp_path}/t").filter("seq < 60"), "seq", lambda d: d)
    rows = log.slice(spark.read.parquet(f"{tmp_path}/t"), "seq").rows
    assert "GreaterThan(seq,59)" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 40
