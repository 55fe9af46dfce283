"""Problem 1: occurrence and record counts of every term and n-gram.

Each task lays the tokens of its records out as one integer sequence and builds
its suffix array (prefix doubling, suffixes end with their record) down to a
fixed depth. Runs of suffixes with a common prefix of n tokens are the intervals
of the n-grams: an interval's length is the occurrence count, and the record
count is that length less the suffixes whose nearest predecessor from the same
record lies in the same interval. A record is never split over two tasks'
blocks, so the counts of the blocks add up exactly; only distinct n-grams per
block are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.arrow import tokens_of
from loomtext.functions.lineage import cut

#: Tokens of a block; memory of a task is about 100 bytes for each.
BLOCK_TOKENS = 3_000_000
DEPTH = 4


def suffix_array(codes: np.ndarray, record: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` (rounded up to a power of
    two) codes; a suffix ends with its record, ties stay in reading order."""
    size = len(codes)
    rank = codes.astype(np.int64) + 1
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(size, np.int64)
        if size > step:
            same = record[step:] == record[:-step]
            after[:-step][same] = rank[step:][same]
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        step *= 2
    return order


def intervals(codes: np.ndarray, record: np.ndarray, max_n: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n: n, a position where each distinct n-gram stands, its
    occurrence count and its record count."""
    size = len(codes)
    if not size:
        return
    order = suffix_array(codes, record, max(depth, max_n))
    owner = record[order]
    by_owner = np.argsort(owner, kind="stable")
    before = np.full(size, -1, np.int64)
    same = owner[by_owner[1:]] == owner[by_owner[:-1]]
    before[by_owner[1:][same]] = by_owner[:-1][same]
    last = np.searchsorted(record, record, side="right")  # records are laid out in ascending order
    breaks = np.zeros(size, bool)
    breaks[0] = True
    for n in range(1, max_n + 1):
        at = order + n - 1
        long_enough = at < last[order]
        value = np.where(long_enough, codes[np.minimum(at, size - 1)], -1)
        breaks[1:] |= value[1:] != value[:-1]
        starts = np.flatnonzero(breaks)
        begin = np.repeat(starts, np.diff(np.r_[starts, size]))
        tf = np.diff(np.r_[starts, size])
        df = np.add.reduceat((before < begin).astype(np.int64), starts)
        whole = long_enough[starts]
        yield n, order[starts[whole]], tf[whole], df[whole]


def members(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A position of each distinct code of each owner: in a code's interval of the
    suffix array the suffixes without a predecessor of the same owner."""
    order = np.lexsort((owner, codes))
    c, o = codes[order], owner[order]
    return order[np.r_[True, (c[1:] != c[:-1]) | (o[1:] != o[:-1])]] if len(order) else order


def _distinct(by: list[str], buckets: int, block_tokens: int):
    def emit(parts: list[tuple[pa.Array, np.ndarray]], keys: dict, types: list) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array([w for w, _ in parts]).combine_chunks()
        owner = np.concatenate([o for _, o in parts])
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        at = members(codes, owner)
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[codes[at]]
        order = np.lexsort((codes[at], bucket, owner[at]))
        at, bucket = at[order], bucket[order]
        own = owner[at]
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])])
        total = np.bincount(owner, minlength=len(keys))
        first = np.r_[True, own[starts][1:] != own[starts][:-1]]  # a group's tokens are reported once a block
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)], pa.int32()), coded.dictionary.take(pa.array(codes[at])))
        names = list(keys)
        columns = [pa.array([names[g][i] for g in own[starts].tolist()], t) for i, t in enumerate(types)]
        yield pa.record_batch({"by": pa.StructArray.from_arrays(columns, by), "bucket": pa.array(bucket[starts], pa.int32()), "tokens": lists, "words": pa.array(np.where(first, total[own[starts]], 0), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, keys, types = [], 0, {}, []
        for batch in batches:
            words, row = tokens_of(batch.column(len(by)))
            types = [batch.column(i).type for i in range(len(by))]
            group = np.fromiter((keys.setdefault(k, len(keys)) for k in zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True)), np.int64, batch.num_rows)
            if len(words):
                parts.append((words.cast(pa.string()), group[row]))
                held += len(words)
            if held >= block_tokens:
                yield from emit(parts, keys, types)
                parts, held, keys = [], 0, {}
        if held:
            yield from emit(parts, keys, types)

    return run


def distinct_terms(df: DataFrame, by: list[str], sentences: str = "sentences", *, buckets: int = 16, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per group of rows with equal columns `by`: `unique_terms`, how many distinct
    tokens it has, and `words`, how many tokens.

    Each task reports a group's distinct tokens once, in lists by hash, so that a group
    of any size is spread over `buckets` parts. Null and equal values of `by` group as
    in SQL; groups without a token, and an empty table, give no row; other columns are
    not read.
    """
    types = ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in by)
    parts = df.select(*by, sentences).mapInArrow(_distinct(by, buckets, block_tokens), f"by struct<{types}>, bucket int, tokens array<string>, words bigint")
    met = parts.repartition("by", "bucket").select("by", "bucket", "words", F.posexplode("tokens").alias("pos", "token"))
    met = met.groupBy("by", "bucket", "token").agg(F.sum(F.when(F.col("pos") == 0, F.col("words")).otherwise(0)).alias("words"))
    return met.groupBy("by").agg(F.count("*").alias("unique_terms"), F.sum("words").alias("words")).select("by.*", "unique_terms", "words")


def _counter(max_n: int, depth: int, block_tokens: int):
    def emit(parts: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array([w for w, _ in parts]).combine_chunks()
        record = np.concatenate([r for _, r in parts])
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        for n, at, tf, df in intervals(codes, record, max_n, depth):
            picks = (at[:, None] + np.arange(n)).ravel()
            grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(picks) + 1, n), pa.int32()), coded.dictionary.take(pa.array(codes[picks])))
            yield pa.record_batch({"gram": grams, "tf": pa.array(tf, pa.int64()), "df": pa.array(df, pa.int64())})
        seen = len(np.unique(record))
        yield pa.record_batch({"gram": pa.array([[]], pa.list_(pa.string())), "tf": pa.array([len(codes)], pa.int64()), "df": pa.array([seen], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, base = [], 0, 0
        for batch in batches:
            words, row = tokens_of(batch.column(0))
            parts.append((words.cast(pa.string()), row + base))
            held, base = held + len(words), base + batch.num_rows
            if held >= block_tokens:
                yield from emit(parts)
                parts, held = [], 0
        if held:
            yield from emit(parts)

    return run


def ngram_frequency(df: DataFrame, sentences: str = "sentences", *, max_n: int = 1, depth: int = DEPTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Counts of all n-grams of up to `max_n` tokens within a record.

    One row per distinct n-gram: `gram` (its tokens, as stored), `tf`
    (occurrences), `df` (records). The row with the empty gram has the totals:
    all tokens and all records with at least one. Null records, null or empty
    inner lists and null tokens count nowhere; repeated rows are records of their
    own; an empty table gives no row; other columns are not read.
    """
    part = df.select(sentences).mapInArrow(_counter(max_n, depth, block_tokens), "gram array<string>, tf bigint, df bigint")
    return part.groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def mark_terms(counts: DataFrame, *, least_records: int = 3, most_share: float = 0.2) -> DataFrame:
    """Add `mark` to the counts of ngram_frequency(): `rare` below `least_records`
    records, `common` above `most_share` of all records, else null. A gram that is
    both (in a tiny table) is rare. The row of totals is left out."""
    counts = cut(counts)
    total = counts.filter(F.size("gram") == 0).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    mark = F.when(F.col("df") < least_records, "rare").when(F.col("df") > F.lit(most_share) * F.lit(total), "common")
    return counts.filter(F.size("gram") > 0).withColumn("mark", mark)
