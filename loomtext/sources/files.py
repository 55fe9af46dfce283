"""Readers and sinks for the file formats of text corpora.

Lines are numbered within the split of a file that a task reads, and the lines of the
splits before are added, so that a file of any size is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENISED = "paragraph_id bigint, sentences array<array<string>>"
_BLANK = r"[\s\p{Z}]+"


def _located(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines with the split they are from, and an order within it."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    return rows.withColumn("at", F.monotonically_increasing_id())


def _running(lines: DataFrame, what: Column, name: str) -> DataFrame:
    """Add the sum of `what` over a file's lines up to each one: within the split, and
    over the splits before, of which there is a row each."""
    within = Window.partitionBy("file", "block").orderBy("at")
    per = lines.groupBy("file", "block").agg(F.sum(what).alias("_n"))
    ahead = per.select("file", "block", (F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")).alias("_before"))
    return lines.withColumn(name, F.sum(what).over(within)).join(ahead, ["file", "block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines numbered from 0 in each file."""
    return _running(_located(spark, path), F.lit(1), "n").select("file", (F.col("n") - 1).alias("line"), "value")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Files of one sentence a line, words between blanks; empty lines are left out."""
    words = F.filter(F.split(F.col("value"), _BLANK), lambda w: w != "")
    return spark.read.text(path).select(words.alias("words")).filter(F.size("words") > 0)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Tokenised paragraphs as JSON lines, gzipped or not (S6 S7). A gzipped file is
    one task: many files make many tasks."""
    return spark.read.schema(TOKENISED).json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A single JSON document over many lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_counts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Key and count between tabs, no header, no quoting."""
    return spark.read.schema("key string, count bigint").option("sep", "\t").option("quote", "").option("encoding", encoding).csv(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """`word<TAB>tag` lines, a blank line between sentences: (file, sent, pos, word,
    tag); what follows the last blank line is a sentence too (S10)."""
    blank = (F.trim("value") == "").cast("long")
    part = _running(_located(spark, path), blank, "sent").filter(F.trim("value") != "")
    cells = F.split("value", "\t")
    place = Window.partitionBy("file", "sent").orderBy("block", "at")
    return part.select("file", "sent", F.row_number().over(place).alias("pos"), F.element_at(cells, 1).alias("word"), F.try_element_at(cells, F.lit(2)).alias("tag"))


def read_error_list(spark: SparkSession, path: str) -> DataFrame:
    """`right: wrong1, wrong2*3` lines: (correct, typo, weight, line), as stored."""
    lines = read_lines(spark, path).filter(F.col("value").contains(":"))
    halves = F.split("value", ":", 2)
    rows = lines.select(F.trim(F.element_at(halves, 1)).alias("correct"), F.explode(F.split(F.element_at(halves, 2), ",")).alias("typo"), F.col("line").cast("long").alias("line"))
    return rows.select("correct", F.trim("typo").alias("typo"), F.lit(1).cast("long").alias("weight"), "line")


def numbered(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of Parquet files with a number in the order of file names and rows
    (S1 S2): the rows of each file are counted, and the counts added up over the files."""
    rows = spark.read.parquet(path).select(F.col(column), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    per = rows.groupBy("file").agg(F.max("i").alias("top"))
    ahead = per.withColumn("before", F.sum(F.col("top") + 1).over(Window.orderBy("file")) - F.col("top") - 1).select("file", "before")
    return rows.join(F.broadcast(ahead), "file").select((F.col("before") + F.col("i")).alias("row_id"), column)


def write_paragraphs(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines, with `gzip` as gzipped files (K2 K4)."""
    df.write.mode("overwrite").option("compression", compression or "none").json(path)


def write_readable(df: DataFrame, path: str) -> None:
    """A sentence a line, a blank line between paragraphs (K3); `sentences` is array<array<string>>."""
    body = F.concat(F.array_join(F.transform("sentences", lambda s: F.array_join(s, " ")), "\n"), F.lit("\n"))
    df.select(body.alias("value")).write.mode("overwrite").text(path)


def write_sentences(df: DataFrame, path: str) -> None:
    """(paragraph_id, sentence) as Parquet with zstd (K5)."""
    rows = df.select("paragraph_id", F.explode("sentences").alias("s")).select("paragraph_id", F.array_join("s", " ").alias("sentence"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder for each split (K8)."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_metrics(df: DataFrame, path: str, *, retrain: bool = False) -> bool:
    """A results table, kept where there is one unless `retrain`.
    Returns whether it was written."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target)
    if there and not retrain:
        return False
    df.coalesce(1).write.mode("overwrite").json(path)
    return True


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where the path does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else None
