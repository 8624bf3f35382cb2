"""Writers at the same time, crashes between data and commit, and joins without a shuffle."""

import threading

import pytest

from surveyloom.plans import resuming
from surveyloom.sources import io
from surveyloom.sources.commits import Commits
from surveyloom.streaming.resume import ScoredStream

ROW = ("p", 5, [1.0], [0.5])


def test_a_number_is_claimed_once(spark, tmp_path):
    won = []
    logs = [Commits(spark, f"file://{tmp_path}/log") for _ in range(6)]
    threads = [threading.Thread(target=lambda i=i: won.append(i) if logs[i].put(1, {"by": i}) else None) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and all(x.read() == [{"by": won[0]}] for x in logs)


def waiting(put, barrier):
    """``put`` that waits for the others the first time."""
    calls = []

    def late(number, entry):
        calls.append(number)
        if len(calls) == 1:
            barrier.wait(60)
        return put(number, entry)

    return late


def test_of_two_writers_with_common_ids_one_succeeds(spark, tmp_path):
    make = lambda ids: spark.createDataFrame([(i, *ROW) for i in ids], io.VectorCache.schema)
    caches = [io.VectorCache(spark, f"file://{tmp_path}/c", {"k": 5}) for _ in range(4)]
    sets, results = [["a", "b"], ["b", "c"], ["x"], ["y"]], [None] * 4
    both = threading.Barrier(4)
    for c in caches:  # all look at the log before any commits
        c.log.put = waiting(c.log.put, both)

    def append(i):
        try:
            caches[i].append(make(sets[i]))
            results[i] = "done"
        except ValueError as e:
            results[i] = str(e)

    threads = [threading.Thread(target=append, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(results[:2]) == ["done", "repeated row_id"] and results[2:] == ["done", "done"]
    got = sorted(r.row_id for r in caches[0].read().collect())
    assert got in (["a", "b", "x", "y"], ["b", "c", "x", "y"]) and caches[1].validate()["rows"] == 4


def test_overwriting_settings_ends_older_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", *ROW)], io.VectorCache.schema)
    old = io.VectorCache(spark, f"file://{tmp_path}/c", {"k": 5})
    old.append(rows)
    new = io.VectorCache(spark, f"file://{tmp_path}/c", {"k": 3}, overwrite=True)
    assert new.read().count() == 0
    with pytest.raises(ValueError, match="other settings"):
        old.append(spark.createDataFrame([("b", *ROW)], io.VectorCache.schema))
    new.append(rows)
    assert new.validate()["rows"] == 1


def test_batches_are_committed_once(spark, tmp_path):
    scored = []

    def score(rows):
        scored.append(1)
        return rows.selectExpr("id", "id * 2 as x")

    make = lambda: ScoredStream(spark, f"file://{tmp_path}/sink", "id bigint, x bigint", "id", score)
    a = make()
    assert a.commit(spark.range(5).union(spark.range(2)), 0) and not make().commit(spark.range(5), 0)
    put, a.log.put = a.log.put, lambda number, entry: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        a.commit(spark.range(3, 8), 1)
    assert make().read().count() == 5
    assert make().commit(spark.range(3, 8), 1)
    assert sorted(tuple(r) for r in make().read().collect()) == [(i, 2 * i) for i in range(8)]


def test_a_run_that_breaks_between_data_and_commit_is_resumed(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    source, where = resuming.event_files(spark, sf), (f"file://{tmp_path}/scored", resuming.SCORED, "event_id", resuming._score)
    stream, calls = ScoredStream(spark, *where), []
    put = stream.log.put

    def broken(number, entry):
        calls.append(entry["folder"])
        if len(calls) == 3:
            raise RuntimeError("between data and commit")
        return put(number, entry)

    stream.log.put = broken
    with pytest.raises(Exception, match="between data and commit"):
        stream.run(source, resuming.EVENTS, f"{tmp_path}/mark", 2)
    again = ScoredStream(spark, *where)
    assert len(again.log.read()) == 2 and spark.read.parquet(calls[2]).count() > 0
    again.run(source, resuming.EVENTS, f"{tmp_path}/mark", 2)
    got = sorted(tuple(r) for r in again.read().collect())
    assert len(again.log.read()) == 4 and calls[2] not in [e["folder"] for e in again.log.read()]
    assert got == sorted(tuple(r) for r in resuming._score(spark.read.parquet(f"{sf}/events.parquet")).collect())


def test_new_files_are_scored_once(spark, tmp_path):
    stream = lambda: ScoredStream(spark, f"file://{tmp_path}/sink", "id bigint", "id", lambda rows: rows)
    spark.range(3).write.parquet(f"{tmp_path}/in/a")
    stream().run(f"{tmp_path}/in/*", "id bigint", f"{tmp_path}/mark")
    spark.range(2, 6).write.parquet(f"{tmp_path}/in/b")
    stream().run(f"{tmp_path}/in/*", "id bigint", f"{tmp_path}/mark")
    assert sorted(r.id for r in stream().read().collect()) == list(range(6))


def test_index_joins_without_shuffle(spark):
    out = resuming._indexed(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and out.count() > 10
