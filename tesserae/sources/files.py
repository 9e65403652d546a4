"""Tables out of trees of small files: columns from paths, whole texts, last rows, nested documents, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.sources.lines import numbered

PATH = "_metadata.file_path"


def path_part(levels_up: int) -> Column:
    """A folder's name, counted from the file upwards (0: the file itself); of `name=value` the value."""
    part = F.element_at(F.split(PATH, "/"), -1 - levels_up)
    return F.url_decode(F.replace(F.element_at(F.split(part, "="), -1), F.lit("+"), F.lit("%2B")))


def stem() -> Column:
    return F.regexp_replace(path_part(0), r"\.[^.]*$", "")


def folder_of_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(dir, text): one row for each file, which is small, under the name of its folder."""
    return spark.read.text(pattern, wholetext=True).select(path_part(1).alias("dir"), F.col("value").alias("text"))


def lines_with_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """(dir, line_no, line): the lines of each folder's files, one after another by name; blank lines left out but counted."""
    return numbered(spark, pattern, path_part(1)).select(F.col("log").alias("dir"), "line_no", "line").where(F.trim("line") != "")


def last_rows(spark: SparkSession, pattern: str, schema: str, order: str) -> DataFrame:
    """The last record of each tab-separated file with a header, under the name of its folder."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(pattern).withColumn("dir", path_part(1))
    names = [c for c in rows.columns if c != "dir"]
    return rows.groupBy("dir").agg(F.max_by(F.struct(*names), order).alias("last")).select("dir", "last.*")


def json_documents(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """One document of several lines in each file."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def front_matter(text: Column) -> Column:
    """A map of the `key: value` lines between two `---` lines at the head of a text; empty without them."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    return F.when(head == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(head, F.lit("\n"), F.lit(": ")))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
