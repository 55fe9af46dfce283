"""Queries on trees and ensembles, over lineitem: the price by quantity, discount and tax."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import trees
from loomtext.sources.tables import table

X = ["l_quantity", "l_discount", "l_tax"]
FLAGS = ("A", "N", "R")


def _rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *X, "l_extendedprice", "l_returnflag")


def _best(kind):
    def q(spark, sf):
        y = F.col("l_extendedprice")
        if kind == "mse":
            stats = {"n": F.lit(1), "s": y, "q": y * y}
        elif kind == "xgb":
            stats = {"n": F.lit(1), "g": F.lit(0.0) - y, "h": F.lit(1.0)}
        else:
            stats = {"n": F.lit(1)} | {f"c{i}": F.when(F.col("l_returnflag") == c, 1).otherwise(0) for i, c in enumerate(FLAGS)}
        b = trees.best_splits(_rows(spark, sf), X, F.lit(1), kind, stats)
        return b.select("feature", "threshold", F.round("gain", 2 if kind in ("mse", "xgb") else 9).alias("gain"), "n")

    return q


def _leaves(rows, pred):
    return rows.withColumn("pred", F.round(pred, 4)).groupBy("pred").agg(F.count("*").alias("rows"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


def tree_predict(spark, sf):
    """Depth three; each leaf with its rows."""
    rows = _rows(spark, sf)
    return _leaves(rows, trees.grow(rows, X, F.col("l_extendedprice")).predict())


def tree_midpoints(spark, sf):
    """Thresholds between values."""
    rows = _rows(spark, sf)
    return _leaves(rows, trees.grow(rows, X, F.col("l_extendedprice"), midpoints=True).predict())


def tree_classify(spark, sf):
    """D1 for classes."""
    rows = _rows(spark, sf)
    t = trees.grow(rows, X, F.col("l_returnflag"), kind="gini", max_depth=2)
    return rows.groupBy(t.node().alias("node"), t.predict().cast("int").alias("class"), "l_returnflag").agg(F.count("*").alias("rows"))


def forest_predict(spark, sf):
    """D4 G35."""
    rows = _rows(spark, sf)
    return _leaves(rows, trees.forest(rows, X, F.col("l_extendedprice"), F.concat_ws(":", "l_orderkey", "l_linenumber"), trees=5))


def gbt_predict(spark, sf):
    """D5."""
    rows = _rows(spark, sf)
    return _leaves(rows, trees.boosted(rows, X, F.col("l_extendedprice"), rounds=5))


def xgb_predict(spark, sf):
    """D6 D7."""
    rows = _rows(spark, sf)
    return _leaves(rows, trees.boosted_second_order(rows, X, F.col("l_extendedprice"), rounds=5))


def regression_models(spark, sf):
    """G34 for each model, with a split by order for training and test."""
    rows = _rows(spark, sf)
    train, test = rows.filter("l_orderkey % 5 <> 0"), rows.filter("l_orderkey % 5 = 0")
    y, out = F.col("l_extendedprice"), None
    for name, p in (("tree", trees.grow(train, X, y).predict()), ("boosted", trees.boosted(train, X, y, rounds=2, max_depth=2)), ("second order", trees.boosted_second_order(train, X, y, rounds=2, max_depth=2))):
        x = test.agg(F.lit(name).alias("model"), *trees.regression_metrics(y, p))
        out = x if out is None else out.union(x)
    return out.select("model", "rows", *[F.round(c, 4).alias(c) for c in ("mse", "rmse", "mae", "r2")])


def regression_metrics(spark, sf):
    """G34 of a linear guess."""
    m = _rows(spark, sf).agg(*trees.regression_metrics(F.col("l_extendedprice"), F.col("l_quantity") * 1500.0))
    return m.select("rows", *[F.round(c, 4).alias(c) for c in ("mse", "rmse", "mae", "r2")])


def percentiles(spark, sf):
    """Interpolated percentiles of the distinct values."""
    v = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v")).distinct()
    return v.agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.99)])).alias("ps")).select(F.posexplode("ps").alias("i", "v")).select("i", F.round("v", 4).alias("v"))


def synthetic_regression(spark, sf):
    """200 points of a sine with a fixed disturbance, and the fit of the noiseless curve."""
    x = F.col("id") / 200.0 * 10.0 - 5.0
    rows = spark.range(200).select(x.alias("x"), (F.sin(x) + F.pmod(F.col("id") * 37, F.lit(21)) / 100.0 - 0.1).alias("y"))
    m = rows.agg(*trees.regression_metrics(F.col("y"), F.sin("x")))
    return m.select("rows", *[F.round(c, 9).alias(c) for c in ("mse", "rmse", "mae", "r2")])


_MELT = "WITH m AS (SELECT l_extendedprice AS y, l_returnflag AS c, unnest([0, 1, 2]) AS fi, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)"


def _split_sql(agg: dict[str, str], gain: str, digits: int) -> str:
    cols = ", ".join(f"{e}::DOUBLE AS {k}" for k, e in agg.items())
    left = ", ".join(f"sum({k}) OVER (PARTITION BY feature ORDER BY v) AS l_{k}, sum({k}) OVER (PARTITION BY feature) AS t_{k}" for k in agg)
    right = ", ".join(f"t_{k} - l_{k} AS r_{k}" for k in agg)
    return f"{_MELT}, a AS (SELECT fi, feature, v, {cols} FROM m GROUP BY ALL), p AS (SELECT fi, feature, v AS threshold, {left} FROM a), q AS (SELECT *, {right} FROM p WHERE t_n > l_n), g AS (SELECT *, {gain} AS gain FROM q) SELECT feature, threshold, round(gain, {digits}) AS gain, t_n::BIGINT AS n FROM g ORDER BY round(g.gain, 9) DESC, fi, threshold LIMIT 1"


_VAR = lambda p: f"({p}_q / {p}_n - ({p}_s / {p}_n) ** 2)"
_GINI = lambda p: "(1 - " + " - ".join(f"({p}_{k} / {p}_n) ** 2" for k in ("c0", "c1", "c2")) + ")"
_ENT = lambda p: "(" + " + ".join(f"CASE WHEN {p}_{k} > 0 THEN -({p}_{k} / {p}_n) * log2({p}_{k} / {p}_n + 1e-9::DOUBLE) ELSE 0 END" for k in ("c0", "c1", "c2")) + ")"
_GAIN = lambda f: f"{f('t')} - l_n / t_n * {f('l')} - r_n / t_n * {f('r')}"
_CLASSES = {"n": "count(*)"} | {f"c{i}": f"count(*) FILTER (WHERE c = '{c}')" for i, c in enumerate(FLAGS)}
_XT = lambda p: f"{p}_g * {p}_g / ({p}_n + 1)"
SQL = {
    "best_split_mse": _split_sql({"n": "count(*)", "s": "sum(y)", "q": "sum(y * y)"}, _GAIN(_VAR), 2),
    "best_split_gini": _split_sql(_CLASSES, _GAIN(_GINI), 9),
    "best_split_entropy": _split_sql(_CLASSES, _GAIN(_ENT), 9),
    "best_split_xgb": _split_sql({"n": "count(*)", "g": "-sum(y)"}, f"0.5 * ({_XT('l')} + {_XT('r')} - {_XT('t')})", 2),
    "regression_metrics": "WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500.0::DOUBLE AS e FROM lineitem) SELECT count(*) AS rows, round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(y), 4) AS r2 FROM e",
    "synthetic_regression": "WITH r AS (SELECT id / 200.0::DOUBLE * 10.0 - 5.0 AS x, sin(id / 200.0::DOUBLE * 10.0 - 5.0) + ((id * 37) % 21) / 100.0::DOUBLE - 0.1::DOUBLE AS y FROM range(200) t(id)), e AS (SELECT y, y - sin(x) AS e FROM r) SELECT count(*) AS rows, round(avg(e * e), 9) AS mse, round(sqrt(avg(e * e)), 9) AS rmse, round(avg(abs(e)), 9) AS mae, round(1 - avg(e * e) / var_pop(y), 9) AS r2 FROM e",
    "percentiles": "SELECT i::INT AS i, round(v, 4) AS v FROM (SELECT unnest(range(5)) AS i, unnest(quantile_cont(v, [0.01, 0.25, 0.5, 0.75, 0.99])) AS v FROM (SELECT DISTINCT l_extendedprice AS v FROM lineitem))",
}
QUERIES = {f"best_split_{k}": _best(k) for k in ("mse", "gini", "entropy", "xgb")}
QUERIES |= {f.__name__: f for f in (tree_predict, tree_midpoints, tree_classify, forest_predict, gbt_predict, xgb_predict, regression_models, regression_metrics, percentiles, synthetic_regression)}
