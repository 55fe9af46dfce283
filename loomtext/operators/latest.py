"""The valid row of each key among repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table of superseded keys is broadcast up to this many rows (24 bytes each).
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def latest(df: DataFrame, key: str, at: str, *, prefer: Column | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Keep per `key` the row with the greatest `at`.

    Repeated keys are looked for in the two narrow columns first. If they are
    few enough (counted, at most `broadcast_rows`), they are broadcast and the
    wide rows are never shuffled; otherwise, and where two rows tie on `at`,
    one window over `key` decides. A null `at` counts as the earliest. Rows
    that tie on `at` too are reduced to one: the greatest by `prefer`, then an
    arbitrary but single one. Rows with a null key are kept as they are.
    """
    early = F.lit("0001-01-01").cast("timestamp")
    stamp = F.coalesce(F.col(at).cast("timestamp"), early)
    keyed = df.select(F.col(key).alias("_k"), stamp.alias("_t")).filter("_k is not null")
    repeated = (
        keyed.groupBy("_k", "_t").agg(F.count("*").alias("_n"))
        .groupBy("_k").agg(F.max(F.struct("_t", "_n")).alias("_m"), F.count("*").alias("_v"))
        .select("_k", F.col("_m._t").alias("_t"), F.col("_m._n").alias("_n"), "_v")
        .filter("_v > 1 or _n > 1")
    )
    found = repeated.agg(F.count("*").alias("n"), F.max("_n").alias("ties")).first()
    if not found["n"]:
        return df
    if found["n"] <= broadcast_rows and found["ties"] == 1:
        lk, lt = fresh(df, "_lk"), fresh(df, "_lt")
        keep = repeated.select(F.col("_k").alias(lk), F.col("_t").alias(lt))
        return df.join(F.broadcast(keep), df[key] == F.col(lk), "left").filter(F.col(lk).isNull() | (stamp == F.col(lt))).drop(lk, lt)
    order = [stamp.desc(), *([prefer.desc()] if prefer is not None else [])]
    rn = fresh(df, "_rn")
    ranked = df.filter(F.col(key).isNotNull()).withColumn(rn, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col(rn) == 1).drop(rn).unionByName(df.filter(F.col(key).isNull()))
