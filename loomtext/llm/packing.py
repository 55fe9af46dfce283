"""Problem 6: filling containers of fixed capacity with texts measured in tokens.

What matters of an item is its size, so an instance is a histogram of sizes, which
has at most `capacity` rows however many texts there are. On the histogram a
Martello-Toth reduction fixes every small set that provably dominates what else
could go with its largest item, many containers at a time; best fit, in descending
order, packs the remainder. The result is a list of container patterns with
multiplicities; texts get their places by rank within their size.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.lineage import cut

#: The public pattern by which texts are split before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Segments of containers that are broadcast, at most (some 40 bytes each).
BROADCAST = 1_000_000
#: Rows that are ranked by one task, about.
RANKED = 200_000


@lru_cache(maxsize=4)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    if not os.path.exists(ranks):
        ranks = SparkFiles.get(os.path.basename(ranks))
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _sizes(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"id": batch.column(0), "tokens": pa.array(n, pa.int64())})

    return run


def token_sizes(df: DataFrame, key: str, text: str, *, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """`key` and the `tokens` of each row's whole text; 0 for a null or empty text.
    The rank file is at `ranks` on the driver and sent to nodes that lack it."""
    df.sparkSession.sparkContext.addFile(ranks)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_sizes(ranks, pattern), f"id {kind}, tokens bigint").withColumnRenamed("id", key)


def reduce_and_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Containers for items of positive sizes up to `capacity`: (sizes, how many
    such containers), and how many of them the reduction fixed.

    Items j are looked at from the largest down, with j* the largest of all items
    left that fits beside j. {j} is fixed if nothing fits; {j, j*} if it fills the
    container or no two others fit; if no three others fit, {j, j*, b}, with b the
    largest beside both, is fixed where b is no smaller than any item that could be
    the lesser of two. Each replaces, item by item, whatever an optimal packing puts
    beside j. What decides does not change until one of these sizes runs out, so as
    many containers are fixed at once, and there are no more patterns than a few per
    size, however many items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(group: tuple[int, ...], n: int) -> None:
        fixed.append((group, n))
        for s in group:
            left[s] -= n
            if not left[s]:
                sizes.pop(bisect_right(sizes, s) - 1)

    def fits(room: int, spared: tuple[int, ...]) -> int:
        """The largest size of at most `room` of which one is left besides `spared`."""
        at = bisect_right(sizes, room) - 1
        while at >= 0 and left[sizes[at]] <= spared.count(sizes[at]):
            at -= 1
        return sizes[at] if at >= 0 else 0

    j = capacity + 1
    while sizes and (at := bisect_right(sizes, j - 1)):
        j = sizes[at - 1]
        while left[j]:
            room = capacity - j
            a = fits(room, (j,))
            if not a:
                fix((j,), 1 if room >= j else left[j])
                continue
            least = sizes[0]
            two = least * 2 if left[least] > 1 else least + (sizes[1] if len(sizes) > 1 else least)
            if a == room or two > room:
                fix((j, a), left[j] // 2 if a == j else min(left[j], left[a]))
                continue
            b = fits(room - a, (j, a))
            if b and 3 * least > room and b >= fits(room // 2, ()):
                fix((j, a, b), min(left[s] // (j, a, b).count(s) for s in (j, a, b)))
                continue
            break
    rest = {s: left[s] for s in sizes}
    reduced = sum(n for _, n in fixed)

    # best fit, descending: open containers by what room is left, many alike at a time
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(room: int, sizes_: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([sizes_, n])

    done: list[tuple[tuple[int, ...], int]] = []
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            at = bisect_right(rooms, s - 1)
            if at == len(rooms):
                q = capacity // s
                full, over = divmod(n, q)
                for count, k in ((full, q), (1 if over else 0, over)):
                    if count:
                        put(capacity - k * s, (s,) * k, count)
                n = 0
                continue
            room = rooms[at]
            group, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            q = room // s
            use = min(m, n // q)
            if use:
                put(room - q * s, group + (s,) * q, use)
                if m > use:
                    put(room, group, m - use)
                n -= use * q
            else:
                put(room - n * s, group + (s,) * n, 1)
                if m > 1:
                    put(room, group, m - 1)
                n = 0
    for room in rooms:
        done += [(g, n) for g, n in open_[room]]
    return fixed + done, reduced


def pack(sizes: DataFrame, key: str, tokens: str, capacities: dict[str, int]) -> DataFrame:
    """Places of all rows in the containers of each kind: `key`, `container` (its
    name), `capacity`, `piece`, `piece_tokens`, `bin` (number of the container).

    Only a text over the capacity is cut: into full pieces, each alone in its
    container, and a remainder. A row without tokens needs no room and comes out
    with piece 0 and a null bin. Rows with a null key or size are left out, a kind
    without a positive capacity gives no rows; repeated keys are items of their own
    and their pieces may share a number. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    held = cut(sizes.filter(F.col(key).isNotNull() & F.col(tokens).isNotNull()).select(F.col(key).alias("id"), F.col(tokens).cast("bigint").alias("t")))
    buckets = max(64, held.count() // RANKED)
    kinds = [(str(k), int(c)) for k, c in sorted(capacities.items()) if k is not None and c and c > 0]
    each = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).alias("capacity")) for n, c in kinds])
    out = held.filter("t <= 0").select("id", F.inline(each), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("piece_tokens"), F.lit(None).cast("bigint").alias("bin")) if kinds else None
    for name, c in kinds:
        whole, over = F.floor(F.col("t") / c).cast("int"), F.col("t") % c
        parts = F.concat(F.transform(F.sequence(F.lit(1), whole), lambda i: F.struct((i - 1).alias("piece"), F.lit(c).cast("bigint").alias("size"))), F.when(over > 0, F.array(F.struct(whole.alias("piece"), over.alias("size")))).otherwise(F.array().cast("array<struct<piece:int,size:bigint>>")))
        parts = F.when(F.col("t") < c, F.array(F.struct(F.lit(0).alias("piece"), F.col("t").alias("size")))).otherwise(parts)
        items = held.filter("t > 0").select("id", F.inline(parts)).withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
        counts = cut(items.groupBy("size", "bucket").agg(F.count("*").alias("n")))
        histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most c rows
        patterns, _ = reduce_and_fit(histogram, c)
        segments, used, base = [], dict.fromkeys(histogram, 0), 0
        for group, n in patterns:
            for s in dict.fromkeys(group):
                k = group.count(s)
                segments.append((s, used[s], used[s] + n * k, base, k))
                used[s] += n * k
            base += n
        # there are a few patterns per size, with at most `capacity` sizes; counted all the same
        places = spark.createDataFrame(segments, "size bigint, lo bigint, hi bigint, base bigint, per int") if segments else spark.createDataFrame([], "size bigint, lo bigint, hi bigint, base bigint, per int")
        before = counts.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
        ranked = items.withColumn("rn", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "piece"))).join(before, ["size", "bucket"]).withColumn("at", F.col("before") + F.col("rn") - 1)
        placed = ranked.join(F.broadcast(places) if len(segments) <= BROADCAST else places, (ranked["size"] == places["size"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        placed = placed.select("id", F.lit(name).alias("container"), F.lit(c).alias("capacity"), "piece", ranked["size"].alias("piece_tokens"), (F.col("base") + F.floor((F.col("at") - F.col("lo")) / F.col("per"))).alias("bin"))
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        out = held.limit(0).select("id", F.lit("").alias("container"), F.lit(0).alias("capacity"), F.lit(0).alias("piece"), F.col("t").alias("piece_tokens"), F.col("t").alias("bin"))
    return out.withColumnRenamed("id", key)
