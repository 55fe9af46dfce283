"""Corpus statistics, frequency tables and length distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.lineage import cut


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or nothing was counted."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def corpus_stats(sentences: DataFrame, *by: str) -> DataFrame:
    """Sentences, words, characters, averages, type/token ratio and distinct tokens
    of rows with `sentences` (array<array<struct<tok,type>>>), per group (G1, G2).

    One scan and one shuffle: every row gives its tokens and one row without a token
    for its sentences; tokens are counted per group first, so that distinct and total
    counts come from one pre-aggregated table whatever the skew."""
    none = F.struct(F.lit(None).cast("string").alias("tok"), F.size("sentences").alias("s"))
    each = F.explode(F.concat(F.array(none), F.transform(F.flatten("sentences"), lambda t: F.struct(t["tok"].alias("tok"), F.lit(0).alias("s")))))
    words = sentences.select(*by, each.alias("x")).groupBy(*by, "x.tok").agg(F.count("*").alias("n"), F.sum("x.s").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    both = words.groupBy(*by).agg(
        zero(F.sum(F.when(F.col("tok").isNull(), F.col("n")))).alias("paragraphs"), zero(F.sum("s")).alias("total_sentences"), zero(F.sum(F.when(F.col("tok").isNotNull(), F.col("n")))).alias("total_words"),
        zero(F.sum(F.col("n") * F.length("tok"))).alias("total_characters"), F.count("tok").alias("unique_tokens"),
    )
    return both.select(
        *by, "paragraphs", "total_sentences", "total_words", "total_characters", "unique_tokens",
        F.round(ratio(F.col("total_words"), F.col("total_sentences")), 6).alias("average_sentence_length"),
        F.round(ratio(F.col("total_characters"), F.col("total_words")), 6).alias("average_word_length"),
        F.round(ratio(F.col("unique_tokens"), F.col("total_words")), 6).alias("type_token_ratio"),
    )


def share(counts: DataFrame, count: str, name: str = "percent") -> DataFrame:
    """Add each row's percentage of all (G6); one number is broadcast."""
    total = counts.agg(F.sum(count).alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn(name, F.round(100.0 * F.col(count) / F.col("_all"), 6)).drop("_all")


def type_counts(tokens: DataFrame) -> DataFrame:
    """Tokens of each class."""
    return tokens.select(F.explode("tokens.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def word_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences of each WORD token."""
    return tokens.select(F.explode("tokens").alias("t")).filter("t.type = 'WORD'").groupBy(F.col("t.tok").alias("word")).agg(F.count("*").alias("n"))


def length_histogram(sentences: DataFrame, cap: int | None = None) -> DataFrame:
    """Sentences of each length, those over `cap` counted under it."""
    n = F.size("s") if cap is None else F.least(F.size("s"), F.lit(cap))
    return sentences.select(F.explode("sentences").alias("s")).groupBy(n.cast("long").alias("length")).agg(F.count("*").alias("n"))


def top(df: DataFrame, count: str, key: str, n: int) -> DataFrame:
    """The n rows with the greatest count, ties by key (O1, O2)."""
    return df.orderBy(F.desc(count), F.asc(key)).limit(n)


#: Rows of a range that one task numbers, about.
RANGE_ROWS = 1_000_000


def numbered(df: DataFrame, order: str, name: str, blocks: int = 8) -> DataFrame:
    """Add `name`, the place of each row in `order`, from 0. Ranges of some RANGE_ROWS
    rows, `blocks` at least, are numbered each by itself, and the sizes of those before are added. The
    ranges are written once, so that both branches see the same ones."""
    ranges = max(blocks, -(-df.count() // RANGE_ROWS))
    ranged = cut(df.repartitionByRange(ranges, order).withColumn("_block", F.spark_partition_id()))
    per = ranged.groupBy("_block").agg(F.count("*").alias("_n"))
    ahead = per.select("_block", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_n")).alias("_before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return ranged.withColumn("_rn", rank).join(F.broadcast(ahead), "_block").withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_block", "_rn", "_before")


def running_budget(df: DataFrame, order: str, size: Column, budget: int, batch: int, blocks: int = 8) -> DataFrame:
    """Rows up to the batch in which the running total of `size` passes `budget`;
    the budget is tested once for each batch of `batch` rows in `order` (K1, W8).

    The running total needs no single task over all rows: rows are numbered within
    ranges of `order`, and totals of batches are added up within stretches of batches
    first, then over the stretches."""
    batched = numbered(df.withColumn("_size", size), order, "_at", blocks).withColumn("_batch", F.floor(F.col("_at") / batch))
    totals = batched.groupBy("_batch").agg(F.sum("_size").alias("_s")).withColumn("_stretch", F.floor(F.col("_batch") / RANGE_ROWS))
    totals = cut(totals)
    wide = totals.groupBy("_stretch").agg(F.sum("_s").alias("_t"))
    ahead = wide.select("_stretch", (F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_stretch")) - F.col("_t")).alias("_ahead"))  # a row for a million batches
    own = F.sum("_s").over(Window.partitionBy("_stretch").orderBy("_batch")) - F.col("_s")
    # a batch is in as long as the budget was not passed before it: all up to one batch
    last = totals.withColumn("_own", own).join(F.broadcast(ahead), "_stretch").filter(F.col("_own") + F.col("_ahead") < budget).agg(F.max("_batch").alias("m")).first()["m"]
    return batched.filter(F.col("_batch") <= F.lit(-1 if last is None else last)).drop("_size", "_at", "_batch")
