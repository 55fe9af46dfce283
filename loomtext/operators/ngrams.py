"""Vocabulary, n-gram tables and the counts that language models need.

Sentences are rows (`split`, `words`). Every position of a padded sentence gives one
n-gram of each order, so the tables of the lower orders are aggregates of that of
order 4, and one scan of the text feeds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.lineage import cut

BOS, EOS, UNK = "<s>", "</s>", "<UNK>"
W = ["w0", "w1", "w2", "w3"]


def vocabulary(train: DataFrame, min_count: int = 2) -> DataFrame:
    """Words of at least `min_count` occurrences, and the two marks."""
    kept = train.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("word")
    marks = train.sparkSession.createDataFrame([(UNK,), (EOS,)], "word string")
    return kept.union(marks).distinct()


#: A vocabulary is broadcast up to this many words, counted.
BROADCAST_WORDS = 1_000_000


def mapped(sentences: DataFrame, vocab: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """`words` of every sentence with unknown ones replaced (F4 J1). A vocabulary of up
    to `broadcast_words` words, counted, is sent to the tasks and looked up where the
    sentences are, without a shuffle. Beyond, only the places of unknown words are
    looked for, by their distinct words, and come back to the sentences that have any."""
    schema = sentences.select("split", "words").schema
    if vocab.limit(broadcast_words + 1).count() <= broadcast_words:
        known = sentences.sparkSession.sparkContext.broadcast(pa.array([r["word"] for r in vocab.collect()], pa.string()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(1)
                flat = words.flatten()
                there = pc.is_in(flat, value_set=known.value)
                size = pc.list_value_length(words)
                ends = np.cumsum(np.asarray(pc.fill_null(size, 0)))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pc.if_else(there, flat.cast(pa.string()), UNK))
                yield pa.record_batch({"split": batch.column(0), "words": lists})

        return sentences.select("split", "words").mapInArrow(run, schema)
    held = cut(sentences.select("split", "words").withColumn("_id", F.monotonically_increasing_id()))
    places = held.select("_id", F.posexplode("words").alias("pos", "word"))
    unknown = places.select("word").distinct().join(vocab, "word", "left_anti")
    # unknown words are rare ones: no key is hot
    at = places.join(unknown, "word", "left_semi").groupBy("_id").agg(F.collect_set("pos").alias("ps"))
    masked = F.transform("words", lambda w, i: F.when(F.array_contains("ps", i), F.lit(UNK)).otherwise(w))
    return held.join(at, "_id", "left").select("split", F.when(F.col("ps").isNull(), F.col("words")).otherwise(masked).alias("words"))


def grams(sentences: DataFrame) -> DataFrame:
    """One row per distinct 4-gram and split: w0..w3 and `c`."""
    padded = F.concat(F.array_repeat(F.lit(BOS), 3), "words", F.array(F.lit(EOS)))
    rows = sentences.select("split", F.explode(F.array(padded)).alias("p"))
    at = F.transform(F.sequence(F.lit(4), F.size("p")), lambda i: F.struct(*[F.element_at("p", i - 3 + k).alias(w) for k, w in enumerate(W)]))
    return rows.select("split", F.inline(at)).groupBy("split", *W).agg(F.count("*").alias("c"))


def order(four: DataFrame, n: int) -> DataFrame:
    """The table of order n, from that of order 4: its words and `c`."""
    return four.groupBy(*W[4 - n :]).agg(F.sum("c").alias("c"))


def context(table: DataFrame, n: int) -> DataFrame:
    """Context counts of order n and the distinct words that follow: `cc`, `kinds`."""
    return table.groupBy(*W[4 - n : 3]).agg(F.sum("c").alias("cc"), F.count("*").alias("kinds"))


def freq_of_freq(table: DataFrame) -> DataFrame:
    """How many n-grams occur r times: `r`, `nr`."""
    return table.groupBy(F.col("c").alias("r")).agg(F.count("*").alias("nr"))


def continuation(two: DataFrame) -> DataFrame:
    """Distinct words before each word: `w3`, `before`."""
    return two.groupBy("w3").agg(F.count("*").alias("before"))
