"""WordPiece: pair scores, training and greedy tokenisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.lineage import cut

MARK = "##"


def pieces_of(word: Column) -> Column:
    """Characters, all but the first marked as continuations."""
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(MARK), c)))


def joined(a: Column, b: Column) -> Column:
    """Two pieces as one."""
    return F.concat(a, F.regexp_replace(b, rf"\A{MARK}", ""))


def pair_scores(words: DataFrame) -> DataFrame:
    """From (`pieces`, `n`, `first`): a, b, pair_freq, freq_a, freq_b, score and the
    first place where the pair stands (T13). Piece counts are few and joined by hash."""
    at = words.select("n", "first", F.posexplode("pieces").alias("pos", "a"), "pieces").withColumn("b", F.try_element_at("pieces", F.col("pos") + 2))
    pair = at.filter("b is not null").groupBy("a", "b").agg(F.sum("n").alias("pair_freq"), F.min(F.struct("first", "pos")).alias("place"))
    single = at.groupBy("a").agg(F.sum("n").alias("f"))
    fa, fb = single.withColumnRenamed("f", "freq_a"), single.select(F.col("a").alias("b"), F.col("f").alias("freq_b"))
    return pair.join(fa, "a").join(fb, "b").select("a", "b", "pair_freq", "freq_a", "freq_b", (F.col("pair_freq") / (F.col("freq_a") * F.col("freq_b"))).alias("score"), "place")


def train(words: DataFrame, merges: int) -> tuple[list[tuple[str, str, str, float, int]], DataFrame]:
    """Merge the best pair `merges` times: the steps (a, b, merged, score, ties) and
    the final words (T14). `words` has `word`, `n` and `first`, its first place in
    the corpus; ties go to the pair that stands first. One row a step comes to the
    driver."""
    state = cut(words.select("word", "n", "first", pieces_of(F.col("word")).alias("pieces")))
    steps = []
    for _ in range(merges):
        scores = pair_scores(state)
        best = scores.orderBy(F.desc("score"), "place").limit(1).collect()
        if not best:
            break
        a, b, score = best[0]["a"], best[0]["b"], best[0]["score"]
        new = a + b.removeprefix(MARK)
        ties = scores.filter(F.col("score") == score).count() - 1
        steps.append((a, b, new, score, ties))
        last = lambda acc: F.try_element_at(acc, F.lit(-1))
        merged = F.aggregate("pieces", F.array().cast("array<string>"), lambda acc, x: F.when((last(acc) == a) & (x == b), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new)))).otherwise(F.concat(acc, F.array(x))))  # noqa: B023
        state = cut(state.select("word", "n", "first", F.when(F.array_contains("pieces", a) & F.array_contains("pieces", b), merged).otherwise(F.col("pieces")).alias("pieces")), replaces=state)
    return steps, state


def longest_match(word: str, vocab: frozenset[str]) -> list[str]:
    """Longest pieces from the left; [UNK] for the whole word if stuck."""
    out, at = [], 0
    while at < len(word):
        head = MARK if at else ""
        end = next((e for e in range(len(word), at, -1) if head + word[at:e] in vocab), None)
        if end is None:
            return ["[UNK]"]
        out.append(head + word[at:end])
        at = end
    return out


def tokenise(words: DataFrame, word: str, vocab: list[str], most: int = 1_000_000) -> DataFrame:
    """Add `pieces`; the vocabulary is broadcast and must not exceed `most` pieces."""
    if len(vocab) > most:
        raise ValueError(f"a subword vocabulary of {len(vocab)} pieces is over the limit of {most}")
    held = words.sparkSession.sparkContext.broadcast(frozenset(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({word: b.column(0), "pieces": pa.array([longest_match(w, held.value) if w else [] for w in b.column(0).to_pylist()], pa.list_(pa.string()))})

    return words.select(word).mapInArrow(run, f"{word} string, pieces array<string>")

