"""Problem 2: splits that keep related records together.

Records with a common word form a graph: its vertices are the words of either
side, its edges the records. A Boruvka contraction builds a spanning forest: in
each round every component picks its least outgoing edge (edges are totally
ordered by record id), the picked edges join the persisted forest with the component
that each contracts into, found by pointer jumping, and edges within a component go.
The number of components at least halves, so there are at most log2(vertices) rounds.
Every vertex finds its root in the persisted forest, from the last round back to the
first. Roots are stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.lineage import cut, drop_cut

#: Groups of more than one part in this many of all records, and of more than LEAST
#: records, are placed one by one; there can't be more of them than this.
GIANTS, LEAST = 200, 8
#: Groups of a band that are ranked by one task, about.
RANKED = 200_000


@F.pandas_udf(T.StringType())
def word_key(words: pd.Series) -> pd.Series:
    """A word as its list file is read: lower case, `_` a blank, no surrounding
    blanks, no trailing `*n`, canonically composed. Null or nothing left: null."""

    def one(w):
        if w is None:
            return None
        w = w.strip()
        head, star, n = w.rpartition("*")
        if star and n.isdigit():
            w = head
        return unicodedata.normalize("NFC", unicodedata.normalize("NFC", w).lower().replace("_", " ")).strip() or None

    return words.map(one, na_action="ignore")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boruvka over `edges` (u, v, w; w distinct). Returns the component label of
    every vertex (`vertex`, `root`) and the forest (`w` of its edges)."""
    vertices = edges.select(F.col("u").alias("vertex")).union(edges.select("v")).distinct()
    live, forest, contracted = cut(edges.filter("u <> v").select("u", "v", "w")), [], []
    while True:
        ends = live.select(F.col("u").alias("c"), F.col("v").alias("to"), "w").union(live.select(F.col("v").alias("c"), F.col("u").alias("to"), "w"))
        picked = cut(ends.groupBy("c").agg(F.min(F.struct("w", "to")).alias("m")).select("c", F.col("m.to").alias("to"), F.col("m.w").alias("w")))
        if picked.isEmpty():
            for x in (live, picked):
                drop_cut(x)
            break
        forest.append(cut(picked.select("w").distinct()))
        # two components that picked each other form the only kind of cycle: the smaller one becomes the root
        back = picked.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = picked.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        up = cut(up, replaces=picked)
        while True:
            over = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = cut(up.join(over, "p", "left").select("c", F.coalesce("pp", "p").alias("pp"), "p"))
            moved = not jumped.filter("pp <> p").isEmpty()
            up = cut(jumped.select("c", F.col("pp").alias("p")), replaces=up)
            drop_cut(jumped)
            if not moved:
                break
        contracted.append(up)
        a, b = up.select(F.col("c").alias("u"), F.col("p").alias("pu")), up.select(F.col("c").alias("v"), F.col("p").alias("pv"))
        nxt = live.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"), "w").filter("u <> v")
        live = cut(nxt.groupBy("u", "v").agg(F.min("w").alias("w")), replaces=live)
    # a component contracts once, into one that may do so in a later round
    rooted = None
    for up in reversed(contracted):
        own = up.filter("c <> p")
        if rooted is None:
            rooted = cut(own.select(F.col("c").alias("vertex"), F.col("p").alias("root")))
        else:
            later = rooted.select(F.col("vertex").alias("p"), "root")
            rooted = cut(own.join(later, "p", "left").select(F.col("c").alias("vertex"), F.coalesce("root", "p").alias("root")).union(rooted), replaces=rooted)
        drop_cut(up)
    labels = cut(vertices.join(rooted, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root")), replaces=rooted) if rooted is not None else cut(vertices.withColumn("root", F.col("vertex")))
    forest_df = forest[0] if forest else edges.select("w").limit(0)
    for more in forest[1:]:
        forest_df = forest_df.union(more)
    return labels, forest_df.distinct()


def related_groups(df: DataFrame, key: str, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """Group the records of `df` that share a value of one of the columns `words`
    (values of different columns never meet). Returns one row per distinct `key`
    (`key`, `group_id` = least key of its group, `group_size`) and the forest.

    Rows repeated under a key are one record and bring all their words. Null words
    relate nothing; a record without words is a group of its own; rows with a null
    key are left out; an empty table gives no rows; other columns are not read.
    """
    wide = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array(*[F.when(F.col(w).isNotNull(), F.concat(F.lit(f"{i}"), F.col(w))) for i, w in enumerate(words)]).alias("ws"))
    held = cut(wide.select("id", F.explode_outer(F.array_compact("ws")).alias("word")).distinct())
    # per record an edge from its least word to each other one; the least record stands for parallel edges
    least = held.groupBy("id").agg(F.min("word").alias("u"), F.count("word").alias("n"))
    edges = held.join(least.filter("n > 1"), "id").filter("word <> u").groupBy("u", F.col("word").alias("v")).agg(F.min("id").alias("id"))
    edges = edges.withColumn("w", F.struct("id", "u", "v")).select("u", "v", "w")
    labels, forest = spanning_forest(edges)
    home = least.select("id", "u").join(labels, F.col("u") == F.col("vertex"), "left").select("id", F.coalesce("root", "u", F.concat(F.lit("-"), F.col("id").cast("string"))).alias("root"))
    home = cut(home, replaces=labels)
    groups = home.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    out = cut(home.join(groups, "root").select(F.col("id").alias(key), "group_id", "group_size"))
    drop_cut(held)
    return out, forest


def _dealt(groups: DataFrame, need: dict[str, float], salt: int, buckets: int) -> DataFrame:
    """Deal groups in proportion to `need`, band by band: the k-th group of a band in
    the order of a hash gets the split at the k-th multiple of the golden ratio, which
    deals every stretch of a band evenly. The rank within a band is a bucket's offset
    plus the rank in the bucket, so no task sees a whole band."""
    left = sum(max(0.0, v) for v in need.values()) or 1.0
    edges, upto = [], 0.0
    for k, v in need.items():
        upto += max(0.0, v) / left
        edges.append((k, upto))
    draw = F.xxhash64("group_id", F.lit(salt))
    rows = groups.select("group_id", "group_size", F.floor(F.log2("group_size")).cast("int").alias("band"), draw.alias("draw"))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    per = rows.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    offsets = per.select("band", "bucket", (F.sum("n").over(Window.partitionBy("band").orderBy("bucket")) - F.col("n")).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("band", "bucket").orderBy("draw", "group_id"))
    u = ((rank - 0.5) * F.lit(0.6180339887498949)) % 1
    choice: Column = F.lit(edges[-1][0]) if edges else F.lit(None).cast("string")
    for k, upto in reversed(edges[:-1]):
        choice = F.when(u < upto, k).otherwise(choice)
    return rows.join(offsets, ["band", "bucket"]).select("group_id", "group_size", choice.alias("split"))


def deal(groups: DataFrame, shares: dict[str, float], *, salt: int = 0) -> DataFrame:
    """Give each group (`group_id`, `group_size`) a `split` in the wanted shares.

    Groups of over LEAST records and over one part in GIANTS of all (so there are at
    most GIANTS) go one by one to the split that lacks most. All others are dealt
    systematically within bands of size (between powers of two); those of one record
    last, in the shares that are still wanted. No groups: no rows. Shares need not add
    up to 1.
    """
    total, count = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count("*")).first()
    buckets = max(64, count // RANKED)
    wanted = {k: max(0.0, float(v or 0)) for k, v in sorted(shares.items())}
    scale = sum(wanted.values()) or 1.0
    need = {k: v / scale * total for k, v in wanted.items()}
    giant = (F.col("group_size") > total / GIANTS) & (F.col("group_size") > LEAST)
    placed = []
    for r in sorted(groups.filter(giant).collect(), key=lambda r: (-r["group_size"], r["group_id"])):
        to = max(need, key=lambda k: (need[k], k))
        need[to] -= r["group_size"]
        placed.append((r["group_id"], r["group_size"], to))
    out = cut(_dealt(groups.filter(~giant & (F.col("group_size") > 1)), need, salt, buckets))
    for r in out.groupBy("split").agg(F.sum("group_size").alias("n")).collect():
        if r["split"] is not None:
            need[r["split"]] -= r["n"]
    out = out.union(_dealt(groups.filter("group_size <= 1"), need, salt, buckets))
    if not placed:
        return out
    return out.union(groups.sparkSession.createDataFrame(placed, "group_id bigint, group_size bigint, split string"))
