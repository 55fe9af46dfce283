"""TF-IDF similarity, Bernoulli Naive Bayes and exact Kneser-Ney bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weights(docs: DataFrame, key: str, words: str) -> DataFrame:
    """tf, df, log10(N/df) and weight of every term of a document (G23). `words` is an array."""
    n = docs.agg(F.count("*").alias("docs"))
    tf = docs.select(F.col(key).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("idf", F.log10(F.col("docs") / F.col("df"))).withColumn("w", F.col("tf") * F.col("idf")).drop("docs")


def cosine_pairs(w: DataFrame) -> DataFrame:
    """a < b, dot, cosine and Euclidean distance of all documents that share a term
    of weight (C1 J13); any other pair has cosine 0 and sqrt(na + nb) between them.
    Pairs meet on their terms, never all by all."""
    norm = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    live = w.filter("w > 0").select("id", "term", "w")
    a, b = live.toDF("a", "term", "wa"), live.toDF("b", "term", "wb")
    dot = a.join(b, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    both = dot.join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b")
    return both.select("a", "b", "dot", (F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"), F.sqrt(F.greatest(F.col("na") + F.col("nb") - 2 * F.col("dot"), F.lit(0.0))).alias("distance"))


def unrelated_pairs(w: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that cosine_pairs() leaves out, in its columns (J13): all by all, for
    tables of fixed size."""
    norm = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    rest = norm.toDF("a", "na").crossJoin(norm.toDF("b", "nb")).filter("a < b").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    return rest.select("a", "b", F.lit(0.0).alias("dot"), F.lit(0.0).alias("cosine"), F.sqrt(F.col("na") + F.col("nb")).alias("distance"))


def bernoulli(rows: DataFrame, label: str, features: list[str], alpha: float) -> DataFrame:
    """Per class: rows, prior and p(feature) = (ones + a) / (rows + 2a)."""
    per = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("long")).alias(f"ones_{f}") for f in features])
    total = rows.agg(F.count("*").alias("_all"))
    out = per.crossJoin(F.broadcast(total)).withColumn("prior", F.col("n") / F.col("_all")).drop("_all")
    for f in features:
        out = out.withColumn(f"p_{f}", (F.col(f"ones_{f}") + F.lit(alpha)) / (F.col("n") + F.lit(2 * alpha)))
    return out


def bernoulli_joint(features: dict[str, Column]) -> Column:
    """prior times p or 1 - p of every feature; a product, so that zeros stay zeros."""
    out = F.col("prior")
    for f, x in features.items():
        out = out * F.when(x, F.col(f"p_{f}")).otherwise(1 - F.col(f"p_{f}"))
    return out


def kneser_ney_bigrams(pairs: DataFrame, numerator: int = 1, denominator: int = 2) -> DataFrame:
    """Exact probability of every seen bigram (v, w, c) under one discount, as
    numerator and denominator over C(v) times the bigram types (L11)."""
    v = pairs.groupBy("v").agg(F.sum("c").alias("cv"), F.count("*").alias("kinds"))
    w = pairs.groupBy("w").agg(F.count("*").alias("before"))
    total = pairs.agg(F.count("*").alias("types"))
    both = pairs.join(v, "v").join(w, "w").crossJoin(F.broadcast(total))
    first = F.greatest(F.col("c") * denominator - numerator, F.lit(0)) * F.col("types")
    return both.select("v", "w", (first + numerator * F.col("kinds") * F.col("before")).cast("long").alias("num"), (F.col("cv") * denominator * F.col("types")).cast("long").alias("den")).withColumn("p", F.round(F.col("num") / F.col("den"), 9))
