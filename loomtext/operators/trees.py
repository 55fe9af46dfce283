"""Regression and classification trees, forests and boosting, grown level by level.

A tree is a dictionary of nodes; the node of a row is a nested expression over its
features, so no assignment is stored. Each level is one aggregation of all open
nodes: values to their bins between thresholds (at most 101 a node and feature),
prefix sums over the bins, and the best split of each node, of which one row comes
to the driver. Thresholds are the values seen, or 100 percentiles of the distinct
values where there are more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.lineage import cut, drop_cut
from loomtext.operators.latest import fresh

MAX_THRESHOLDS = 100
STEPS = [0.01 + 0.98 * i / 99 for i in range(100)]
MIN_GAIN = 1e-7


@dataclass
class Tree:
    features: list[str]
    #: node -> (feature, threshold) or None for a leaf; children of k are 2k and 2k + 1
    splits: dict[int, tuple[str, float] | None] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def _walk(self, k: int, leaf) -> Column:
        s = self.splits.get(k)
        if s is None:
            return leaf(k)
        return F.when(F.col(s[0]) <= s[1], self._walk(2 * k, leaf)).otherwise(self._walk(2 * k + 1, leaf))

    def node(self) -> Column:
        return self._walk(1, lambda k: F.lit(k))

    def predict(self) -> Column:
        """The leaf's value by traversal, `<=` to the left (D3)."""
        return self._walk(1, lambda k: F.lit(self.values[k]))


def _impurity(kind: str, n: Column, sums: list[Column]) -> Column:
    """Variance from sum and sum of squares, or gini or entropy from class counts."""
    if kind == "mse":
        return F.greatest(sums[1] / n - (sums[0] / n) * (sums[0] / n), F.lit(0.0))
    p = [s / n for s in sums]
    if kind == "gini":
        out = F.lit(1.0)
        for x in p:
            out = out - x * x
        return out
    out = F.lit(0.0)
    for x in p:
        out = out - F.when(x > 0, x * F.log2(x + 1e-9)).otherwise(0.0)
    return out


def best_splits(rows: DataFrame, features: list[str], node: Column, kind: str, stats: dict[str, Column], *, min_leaf: int = 1, lam: float = 1.0, gamma: float = 0.0, midpoints: bool = False, chosen: Column | None = None) -> DataFrame:
    """The best split of each node: node, feature, threshold, gain, n and totals (O15
    G36 W9). `stats` are the row's contributions to `n` and the sums; `kind` is mse,
    gini, entropy or xgb. Ties go to the first feature, then the lower threshold."""
    names = list(stats)
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)]))
    tall = rows.select(node.alias("node"), *[c.alias(s) for s, c in stats.items()], x.alias("x")).filter("x.value is not null")
    if chosen is not None:
        tall = tall.filter(chosen)
    vals = tall.groupBy("node", "x.fi", "x.value").agg(*[F.sum(s).alias(s) for s in names]).filter("n > 0")
    size = vals.groupBy("node", "fi").agg(F.count("*").alias("k"), F.percentile("value", F.array(*map(F.lit, STEPS))).alias("ps"), *[F.sum(s).alias(f"t_{s}") for s in names])
    few = vals.join(F.broadcast(size.filter(F.col("k") <= MAX_THRESHOLDS).select("node", "fi")), ["node", "fi"], "left_semi").groupBy("node", "fi").agg(F.sort_array(F.collect_list("value")).alias("vs"))
    cuts = size.join(few, ["node", "fi"], "left").select("node", "fi", *[f"t_{s}" for s in names], F.coalesce("vs", "ps").alias("cuts"))
    if midpoints:
        cuts = cuts.withColumn("cuts", F.zip_with(F.slice("cuts", 1, F.greatest(F.size("cuts") - 1, F.lit(0))), F.slice("cuts", 2, F.greatest(F.size("cuts") - 1, F.lit(0))), lambda a, b: (a + b) / 2))
    binned = vals.join(F.broadcast(cuts), ["node", "fi"]).withColumn("bin", F.size(F.filter("cuts", lambda t: t < F.col("value"))))
    per = binned.groupBy("node", "fi", "bin").agg(*[F.sum(s).alias(s) for s in names], *[F.first(f"t_{s}").alias(f"t_{s}") for s in names], F.first("cuts").alias("cuts"))
    upto = Window.partitionBy("node", "fi").orderBy("bin")
    run = per.select("node", "fi", F.try_element_at("cuts", F.col("bin") + 1).alias("threshold"), *[F.sum(s).over(upto).alias(f"l_{s}") for s in names], *[F.col(f"t_{s}") for s in names]).filter("threshold is not null")
    for s in names:
        run = run.withColumn(f"r_{s}", F.col(f"t_{s}") - F.col(f"l_{s}"))
    run = run.filter((F.col("l_n") >= min_leaf) & (F.col("r_n") >= min_leaf) & (F.col("r_n") > 0))
    part = lambda p: [F.col(f"{p}_{s}") for s in names if s != "n"]
    if kind == "xgb":
        term = lambda p: F.col(f"{p}_g") * F.col(f"{p}_g") / (F.col(f"{p}_h") + lam)
        gain = 0.5 * (term("l") + term("r") - term("t")) - gamma
    else:
        imp = lambda p: _impurity(kind, F.col(f"{p}_n"), part(p))
        gain = imp("t") - F.col("l_n") / F.col("t_n") * imp("l") - F.col("r_n") / F.col("t_n") * imp("r")
    scored = run.withColumn("gain", gain)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.round("gain", 9)), "fi", "threshold"))
    name = F.element_at(F.array(*map(F.lit, features)), F.col("fi") + 1)
    return scored.withColumn("_r", rank).filter("_r = 1").select("node", name.alias("feature"), "threshold", "gain", F.col("t_n").alias("n"))


def grow(rows: DataFrame, features: list[str], y: Column, *, kind: str = "mse", max_depth: int = 3, min_split: int = 2, min_leaf: int = 1, weight: Column | None = None, lam: float = 1.0, gamma: float = 0.0, midpoints: bool = False, per_node: int | None = None, seed: int = 0) -> Tree:
    """One tree (D1 D2 D6). `y` is the target, the class for gini and entropy, or the
    gradient for xgb (with hessian 1). `weight` counts a row more than once or not at
    all; `per_node` features are drawn for each node by hash. A leaf is made at the
    depth, below `min_split` rows, without spread, and without gain."""
    w = F.lit(1) if weight is None else weight
    classes: list = []
    if kind in ("gini", "entropy"):
        classes = sorted(r["c"] for r in rows.select(y.alias("c")).distinct().limit(1001).collect() if r["c"] is not None)
        if len(classes) > 1000:
            raise ValueError("more than 1000 classes")
        stats = {"n": w} | {f"c{i}": F.when(y == c, w).otherwise(0) for i, c in enumerate(classes)}
    elif kind == "xgb":
        stats = {"n": w, "g": w * y, "h": w * F.lit(1.0)}
    else:
        stats = {"n": w, "s": w * y, "q": w * y * y}
    tree, open_ = Tree(features), [1]
    least = 0.0 if kind == "xgb" else MIN_GAIN
    for depth in range(max_depth + 1):
        node = tree.node()
        live = rows.withColumn("_node", node).filter(F.col("_node").isin(open_))
        sums = live.groupBy("_node").agg(*[F.sum(c).alias(s) for s, c in stats.items()]).collect()
        grown = []
        for r in sums:
            k, n = r["_node"], r["n"]
            if kind == "xgb":
                tree.values[k] = -r["g"] / (r["h"] + lam)
            elif classes:
                tree.values[k] = max(range(len(classes)), key=lambda i: (r[f"c{i}"], -i))
            else:
                tree.values[k] = r["s"] / n if n else 0.0
            flat = sum(1 for i in range(len(classes)) if r[f"c{i}"]) <= 1 if classes else kind == "mse" and n and max(0.0, r["q"] / n - (r["s"] / n) ** 2) <= 1e-12 * max(1.0, abs(r["q"] / n))
            if depth < max_depth and n >= min_split and not flat:
                grown.append(k)
        if not grown:
            break
        chosen = None
        if per_node is not None and per_node < len(features):
            draw = lambda i: F.xxhash64(F.col("node"), F.lit(i), F.lit(seed))
            mine = F.element_at(F.array(*map(draw, range(len(features)))), F.col("x.fi") + 1)
            chosen = F.size(F.filter(F.array(*map(draw, range(len(features)))), lambda z: z < mine)) < per_node
        best = best_splits(live.filter(F.col("_node").isin(grown)), features, F.col("_node"), kind, stats, min_leaf=min_leaf, lam=lam, gamma=gamma, midpoints=midpoints, chosen=chosen).collect()
        open_ = []
        for b in best:
            if b["gain"] > least:
                tree.splits[b["node"]] = (b["feature"], b["threshold"])
                open_ += [2 * b["node"], 2 * b["node"] + 1]
        if not open_:
            break
    return tree


#: Chances of a row to be drawn at most 0, 1, 2 ... times into a sample of as many rows.
DRAWN = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(8)]


def bootstrap(key: Column, seed: int) -> Column:
    """How often a row is drawn with replacement, by the hash of its key: Poisson of
    mean 1, to which the draws of many rows tend."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return sum(((u >= p).cast("int") for p in DRAWN), F.lit(0))


def forest(rows: DataFrame, features: list[str], y: Column, key: Column, *, trees: int = 5, max_depth: int = 3) -> Column:
    """The mean of trees on rows drawn with replacement, each node drawing the root of
    the features (D4 G35)."""
    out = F.lit(0.0)
    for t in range(trees):
        out = out + grow(rows, features, y, max_depth=max_depth, weight=bootstrap(key, t), per_node=max(1, int(math.sqrt(len(features)))), seed=t).predict()
    return out / trees


def _rounds(rows: DataFrame, features: list[str], y: Column, rounds: int, rate: float, step, every: int) -> Column:
    """Trees one after the other, each from what `step` makes of the target and the sum
    so far. That sum is stored with the rows every so many rounds, so that the
    expression a round evaluates does not grow with their number."""
    start = float(rows.agg(F.avg(y)).first()[0] or 0.0)
    target, sofar = fresh(rows, "_y"), fresh(rows, "_sum")
    held = rows.select(*features, y.alias(target), F.lit(start).alias(sofar))
    out, pending, stored = F.lit(start), F.lit(0.0), None
    for i in range(rounds):
        tree = F.lit(rate) * step(held, F.col(target), F.col(sofar) + pending).predict()
        out, pending = out + tree, pending + tree
        if (i + 1) % every == 0 and i + 1 < rounds:
            held = stored = cut(held.withColumn(sofar, F.col(sofar) + pending), replaces=stored)
            pending = F.lit(0.0)
    if stored is not None:
        drop_cut(stored)
    return out


def boosted(rows: DataFrame, features: list[str], y: Column, *, rounds: int = 3, rate: float = 0.1, max_depth: int = 3, every: int = 8) -> Column:
    """Trees on what is left of the target, from its mean."""
    return _rounds(rows, features, y, rounds, rate, lambda held, target, pred: grow(held, features, target - pred, max_depth=max_depth), every)


def boosted_second_order(rows: DataFrame, features: list[str], y: Column, *, rounds: int = 3, rate: float = 0.1, max_depth: int = 3, lam: float = 1.0, gamma: float = 0.0, every: int = 8) -> Column:
    """Trees on gradients and hessians of the squared loss."""
    return _rounds(rows, features, y, rounds, rate, lambda held, target, pred: grow(held, features, pred - target, kind="xgb", max_depth=max_depth, lam=lam, gamma=gamma), every)


def regression_metrics(y: Column, pred: Column) -> list[Column]:
    """MSE, RMSE, MAE and R2, which is 0 where the target has no spread."""
    e = y - pred
    mse = F.avg(e * e)
    return [F.count("*").alias("rows"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.coalesce(1 - F.try_divide(mse, F.var_pop(y)), F.lit(0.0)).alias("r2")]
