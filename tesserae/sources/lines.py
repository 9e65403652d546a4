"""Rows out of logs and `key: value` output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators.sessions import next_marker
from tesserae.storage import bounded


def numbered(spark: SparkSession, pattern: str, log: Column | None = None) -> DataFrame:
    """(log, line_no, line) of text files of any size; a log is a file, or all files that share `log` (of the file's metadata), in the order of their names.

    Files are split over tasks as usual.  Lines are counted by split, which gives the number at which each split begins;
    no file is a row, and no line is shuffled.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    raw = spark.read.option("lineSep", "\n").text(pattern)
    raw = raw.select((file if log is None else log).alias("log"), file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = raw.groupBy("log", "file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("log").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    shift = splits.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(bounded(shift), ["file", "start"]).select("log", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def values(text: Column, keys: list[str]) -> dict[str, Column]:
    """The values of these keys in `key: value` lines; the last of a key wins, a missing one is null."""
    return {k: F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?m)^{k}: (.*)$"), 1), F.lit(-1)) for k in keys}


def number(value: Column) -> Column:
    """A number that may end in x or %; null otherwise."""
    return F.regexp_replace(value, "[x%]$", "").try_cast("double")


#: Lines of a training log.
TURN = r"^\[turn (\d+)\] (\w+): (\d+) chars$"
STEP = r"^step (\d+): (\w+)=([-+.eE\d]+)$"


#: Lines of a timed training log.
TIMED_TURN = r"\[(\d\d:\d\d:\d\d)\] turn (\d+): (\d+) active, gen (\d+)s, bench (\d+)s, PASS (\d+)"
TIMED_STEP = r"\[(\d\d:\d\d:\d\d)\] step (\d+)/\d+ .* roll (\d+)s train (\d+)s"
RESUMED = "resumed from"


def log_rows(lines: DataFrame) -> DataFrame:
    """(log, line_no, kind, n, name, value) of the lines that say a turn or a step; others are left out."""
    line = F.col("line")
    kind = F.when(line.rlike(TURN), "turn").when(line.rlike(STEP), "step")
    part = lambda i: F.when(F.col("kind") == "turn", F.regexp_extract("line", TURN, i)).otherwise(F.regexp_extract("line", STEP, i))
    return lines.withColumn("kind", kind).where("kind IS NOT NULL").select("log", "line_no", "kind", part(1).cast("long").alias("n"), part(2).alias("name"), part(3).cast("double").alias("value"))


def sessions(lines: DataFrame) -> DataFrame:
    """(log, line_no, turn, gen, bench, n_pass, state, step, roll, train) of the timed turns.

    A turn belongs to the step whose line follows it (state `finished`); a line that tells of a restart discards the
    turns since the last step (`abandoned`); turns behind the last of both are `unfinished`.
    """
    line = F.col("line")
    number = lambda pattern, i: F.regexp_extract(line, pattern, i).cast("long")
    is_step, is_turn, restart = line.rlike(TIMED_STEP), line.rlike(TIMED_TURN), line.contains(RESUMED)
    step = F.when(restart, F.struct(F.lit(None).cast("long").alias("step"), F.lit(None).cast("long").alias("roll"), F.lit(None).cast("long").alias("train")))
    step = step.when(~is_turn & is_step, F.struct(*[F.when(is_step, number(TIMED_STEP, i)).alias(n) for i, n in ((2, "step"), (3, "roll"), (4, "train"))]))
    kept = lines.where(restart | is_turn | is_step)
    told = next_marker(kept, ["log"], [F.col("line_no")], step).where(~line.contains(RESUMED) & is_turn)
    state = F.when(F.col("marker").isNull(), "unfinished").when(F.col("marker.step").isNull(), "abandoned").otherwise("finished")
    fields = [number(TIMED_TURN, i).alias(n) for i, n in ((2, "turn"), (4, "gen"), (5, "bench"), (6, "n_pass"))]
    return told.select("log", "line_no", *fields, state.alias("state"), "marker.*")
