"""Streams over several batches: lifetimes, freed state, batches that come twice, runs that fail and start again."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.streaming import cache, runs

DAY = 86_400_000_000


def test_serve():
    """Against one event after another, with ties, a stored result from before, and events behind it."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        times = np.sort(rng.integers(0, 40, n))
        events = np.arange(100, 100 + n)
        stored, since = (None, None) if rng.random() < 0.4 else (7, int(rng.integers(0, 30)))
        want, s, t = [], stored, since
        for e, at in zip(events.tolist(), times.tolist(), strict=True):
            if t is not None and at < t:
                want.append((False, e))
                continue
            if t is None or at > t + 9:
                s, t = e, at
                want.append((False, e))
            else:
                want.append((True, s))
        hit, by, s2, t2 = cache.serve(events, times, 9, stored, since)
        assert list(zip(hit.tolist(), by.tolist(), strict=True)) == want and (s2, t2) == (s, t)


def events(spark, rows):
    made = spark.createDataFrame([(i, f"2024-{d}", t, "p") for i, d, t in rows], "event_id long, ts string, event_type string, props string")
    return made.withColumn("ts", F.col("ts").cast("timestamp"))


def test_cache_over_batches(spark, tmp_path):
    """Hits don't prolong a lifetime; state of earlier batches counts; it is freed once the watermark is past it."""
    source, base = f"{tmp_path}/in", f"{tmp_path}/run"
    steps = [
        [(1, "01-01 00:00:00", "a"), (2, "01-05 00:00:00", "a"), (3, "01-08 00:00:00", "a"), (10, "01-02 00:00:00", "b")],
        [(4, "01-09 00:00:00", "a")],
        [(5, "01-16 00:00:00", "a"), (20, "01-18 00:00:00", "c")],
        [(30, "02-20 00:00:00", "d")],
        [(31, "02-21 00:00:00", "d")],
    ]
    held = []
    for rows in steps:
        events(spark, rows).write.mode("append").parquet(source)
        query = cache.answer(spark, source, base)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r["event_id"]: (r["hit"], r["stored_id"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (True, 1), 10: (False, 10), 4: (False, 4), 5: (True, 4), 20: (False, 20), 30: (False, 30), 31: (True, 30)}
    assert held[-1] < max(held), held
    cache.answer(spark, source, base)  # nothing new
    assert spark.read.parquet(f"{base}/out").count() == 9


def test_batches_written_once(spark, tmp_path):
    write, path = runs.to_batches(f"{tmp_path}/t", "k"), f"{tmp_path}/t"
    a, b = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x")], "k long, v string"), spark.createDataFrame([(2, "y"), (3, "y")], "k long, v string")
    for rows, n in ((a, 0), (a, 0), (b, 1), (b, 1), (a, 0)):
        write(rows, n)
    assert sorted((r["k"], r["v"]) for r in runs.appended(spark, path, "k long, v string").collect()) == [(1, "x"), (2, "x"), (3, "y")]
    update, path = runs.to_batches(f"{tmp_path}/u"), f"{tmp_path}/u"
    for rows, n in ((a.limit(2), 0), (b, 1), (b, 1)):
        update(rows, n)
    assert sorted(tuple(r) for r in runs.latest(spark, path, "k long, v string", ["k"]).collect()) == [(1, "x"), (2, "y"), (3, "y")]
    assert runs.latest(spark, f"{tmp_path}/none", "k long", ["k"]).count() == 0


@pytest.mark.parametrize("after", [True, False])
def test_failed_run_starts_again(spark, tmp_path, after):
    """A batch that fails before or after its rows are written; the next run ends with each row once."""
    source, path, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for i in range(3):
        spark.range(i * 10, i * 10 + 15).coalesce(1).write.mode("append").parquet(source)
    write, failed = runs.to_batches(path, "id"), []

    def once(rows, n):
        if after:
            write(rows, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("lost")
        if not after:
            write(rows, n)

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        return runs.finish(stream.writeStream.foreachBatch(once), state)

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert failed and sorted(r["id"] for r in runs.appended(spark, path, "id long").collect()) == list(range(35))


def test_late_results(spark):
    """The second batch is held against the first one's watermark; the first is written by several tasks."""
    first = events(spark, [(i, f"01-{1 + i % 20:02d} 00:00:00", "a") for i in range(200)]).repartition(5)
    second = events(spark, [(1000, "01-10 00:00:00", "a"), (1001, "01-19 12:00:00", "a"), (1002, "02-01 00:00:00", "a")])
    got = {r["event_id"] for r in cache.in_time(spark, [first, second], "2 days").collect()}
    assert got == set(range(200)) | {1001, 1002}


def test_processor_needs_no_package(tmp_path):
    """The driver's own worker has no packages that were added later."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"], input=cloudpickle.dumps(cache.Cache(5)), cwd=tmp_path, env=env, check=True)
