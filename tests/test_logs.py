"""Lines of files that are split over tasks, and sessions over ranges of a log."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import sessions
from tesserae.sources import files, lines


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_lines_of_split_files(spark, tmp_path, small_splits):
    """Long, empty and blank lines, a last line without a line feed, carriage returns, an empty file; one file is many splits."""
    rng = random.Random(3)
    made = {"a": ["", "x", " ", *["y" * rng.randrange(80) for _ in range(300)], "end\r"], "b": ["é" * 400, "z"], "c": []}
    for name, own in made.items():
        (tmp_path / name).mkdir()
        half = len(own) // 2
        for i, part in enumerate((own[:half], own[half:])):
            (tmp_path / name / f"part-{i}.txt").write_text("\n".join(part) + ("\n" if part and i == 0 else ""), newline="")
    found = lines.numbered(spark, f"{tmp_path}/*/*.txt", files.path_part(1))
    assert found.rdd.getNumPartitions() > 40
    got = {(r["log"], r["line_no"]): r["line"] for r in found.collect()}
    assert got == {(name, i): line for name, own in made.items() for i, line in enumerate(own)}
    each = lines.numbered(spark, f"{tmp_path}/a/*.txt").groupBy("log").agg(F.count("*").alias("n"), F.max("line_no").alias("m")).collect()
    assert len(each) == 2 and all(r["m"] == r["n"] - 1 for r in each)


def test_sessions_of_a_log(spark, tmp_path, small_splits):
    log = [
        "[00:00:01] turn 0: 9 active, gen 5s, bench 7s, PASS 1", "noise", "[00:00:02] turn 1: 9 active, gen 6s, bench 8s, PASS 2", "resumed from step 3",
        "[00:00:03] turn 0: 8 active, gen 1s, bench 2s, PASS 0", "[00:00:04] step 4/9 loss 1 roll 10s train 3s", "[00:00:05] step 5/9 loss 1 roll 11s train 4s", "[00:00:06] turn 0: 8 active, gen 3s, bench 4s, PASS 0",
    ]
    (tmp_path / "log.txt").write_text("\n".join(log))
    got = {r["line_no"]: (r["state"], r["step"], r["roll"], r["train"], r["gen"], r["bench"]) for r in lines.sessions(lines.numbered(spark, f"{tmp_path}/log.txt")).collect()}
    assert got == {0: ("abandoned", None, None, None, 5, 7), 2: ("abandoned", None, None, None, 6, 8), 4: ("finished", 4, 10, 3, 1, 2), 7: ("unfinished", None, None, None, 3, 4)}


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_next_marker(spark, groups):
    """A log without a marker for many ranges, one with markers only, null groups."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["a"] * 9 + ["b", None]), f"m{i}" if rng.random() < (0.004 if i < 2000 else 0.3) else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, m string").repartition(5)
    got = {r["k"]: r["next"] for r in sessions.next_marker(df, groups, [F.col("k")], F.col("m"), "next", 16).collect()}
    ahead, want = {}, {}
    for k, g, m in reversed(rows):
        at = g if groups else 0
        want[k] = ahead.get(at)
        if m is not None:
            ahead[at] = m
    assert got == want
