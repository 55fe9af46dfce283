"""Smoothed n-gram models, scored relationally.

Scored 4-grams are reduced to distinct ones with a multiplicity first; joined with
the counts of all orders they hold everything that any model needs, and a model is
one closed expression per order. Perplexity is given as mean negative log-likelihood
too, which stays in range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.lineage import cut
from loomtext.operators import ngrams
from loomtext.operators.ngrams import W

K_VALUES = [0.000001, 0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 5.0]
LAMBDAS = {1: 0.999, 2: 0.65, 3: 0.50, 4: 0.40}
LAMBDA_GRID = {2: [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95], 3: [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9], 4: [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]}


def d(x: float) -> Column:
    return F.lit(float(x))


class Counts:
    """Count tables of the training sentences, and the scored rows of the others."""

    def __init__(self, sentences: DataFrame, min_count: int = 2) -> None:
        self.vocab = cut(ngrams.vocabulary(sentences.filter("split = 'train'"), min_count))
        self.v = self.vocab.count()
        four = cut(ngrams.grams(ngrams.mapped(sentences, self.vocab)))
        train = four.filter("split = 'train'").drop("split")
        self.tables = {4: train}
        for n in (3, 2, 1):
            self.tables[n] = cut(ngrams.order(self.tables[n + 1], n))
        self.contexts = {n: ngrams.context(self.tables[n], n) for n in (4, 3, 2)}
        self.n = self.tables[1].agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        self.evals = four.filter("split <> 'train'").withColumnRenamed("c", "m")
        self._scored = None

    def scored(self) -> DataFrame:
        """Distinct scored 4-grams: split, w0..w3, m, c1..c4, cc2..cc4, kinds2..kinds4
        (J3 J4). The table is made once; every model reads it."""
        if self._scored is None or self._scored[0] is not self.evals:
            self._scored = (self.evals, cut(self._joined()))
        return self._scored[1]

    def _joined(self) -> DataFrame:
        out = self.evals
        for n in (4, 3, 2, 1):
            out = out.join(self.tables[n].withColumnRenamed("c", f"c{n}"), W[4 - n :], "left")
            if n > 1:
                out = out.join(self.contexts[n].withColumnsRenamed({"cc": f"cc{n}", "kinds": f"kinds{n}"}), W[4 - n : 3], "left")
        return out.na.fill(0, [f"c{n}" for n in (1, 2, 3, 4)] + [f"{k}{n}" for n in (2, 3, 4) for k in ("cc", "kinds")])

    def cc(self, n: int) -> Column:
        return F.lit(self.n) if n == 1 else F.col(f"cc{n}")

    def continuation(self) -> tuple[DataFrame, int]:
        return ngrams.continuation(self.tables[2]), self.tables[2].count()

    def discounts(self, k: int = 5) -> dict[int, dict]:
        """Good-Turing discounts of each order from its frequencies of frequencies
        (L6): at most k + 1 rows an order come to the driver."""
        out = {}
        for n, t in self.tables.items():
            per = {r["r"]: r["nr"] for r in ngrams.freq_of_freq(t).filter(F.col("r") <= k + 1).collect()}
            row = t.agg(F.sum("c").alias("n"), F.count("*").alias("types")).first()
            out[n] = good_turing(per, row["n"] or 0, k) | {"types": row["types"]}
        return out


def good_turing(nr: dict[int, int], total: int, k: int = 5) -> dict:
    """Katz discounts d_r = (r*/r - A) / (1 - A) of counts r = 1..k, with Good-Turing's
    r* = (r + 1) N_{r+1} / N_r and A = (k + 1) N_{k+1} / N_1, and the mass N_1 / N of
    unseen n-grams. A discount that leaves (0, 1.5], as sparse frequencies give, is
    replaced by Kneser and Ney's estimate; one without a frequency is 1."""
    r = np.arange(1, k + 1)
    freq = np.array([nr.get(int(i), 0) for i in range(1, k + 2)], float)
    own, above, once = freq[:-1], freq[1:], freq[0]
    with np.errstate(all="ignore"):
        tail = (k + 1) * freq[-1] / once
        kept = 1 - tail if 0 < 1 - tail <= 2 else 1.0
        katz = ((r + 1) * above / own / r - tail) / kept
        absolute = np.clip(1 - once / (once + 2 * nr.get(2, 1)), 0.01, 1.0)
    fitting = (katz > 0) & (katz <= 1.5)
    ratio = np.where((own > 0) & (once > 0), np.where(fitting, katz, absolute), 1.0)
    return {"ratio": dict(zip(r.tolist(), ratio.tolist(), strict=True)), "p0": float(once) / total if total else 1e-10, "total": total}


def discounted(c: Column, gt: dict) -> Column:
    """c times its discount."""
    out = c.cast("double")
    for r, x in gt["ratio"].items():
        out = F.when(c == r, d(x) * r).otherwise(out)
    return out


def add_k(c: Counts, n: int, k: Column) -> Column:
    """L1 L2."""
    return F.log((F.col(f"c{n}") + k) / (c.cc(n) + k * c.v))


def interpolated(c: Counts, n: int, lambdas: dict[int, float]) -> Column:
    """L4, as probability."""
    p = d(lambdas[1]) * F.col("c1") / c.n + d(1.0 - lambdas[1]) / c.v
    for k in range(2, n + 1):
        p = d(lambdas[k]) * F.coalesce(F.try_divide(F.col(f"c{k}"), F.col(f"cc{k}")), F.lit(0.0)) + d(1.0 - lambdas[k]) * p
    return p


def stupid_backoff(c: Counts, n: int, alpha: float = 0.4) -> Column:
    """L9, as score."""
    s = F.greatest(d(1e-30), F.col("c1") / F.lit(c.n))
    for k in range(2, n + 1):
        s = F.when((F.col(f"c{k}") > 0) & (F.col(f"cc{k}") > 0), F.try_divide(F.col(f"c{k}"), F.col(f"cc{k}"))).otherwise(d(alpha) * s)
    return s


def good_turing_log(c: Counts, n: int, gt: dict) -> Column:
    """L7, in log space."""
    import math

    unseen = math.log(max(1e-20, gt["p0"])) - (math.log(max(1, c.v - gt["types"])) if n == 1 else n * math.log(c.v))
    seen = F.log(F.greatest(d(1e-30), discounted(F.col(f"c{n}"), gt) / gt["total"]))
    return F.when(F.col(f"c{n}") == 0, d(unseen)).otherwise(seen)


def katz_tables(c: Counts, gts: dict[int, dict]) -> tuple[float, dict[int, DataFrame]]:
    """The unigram normaliser and alpha of every seen context of orders 2 to 4.
    The suffix of a seen n-gram is seen, so alpha needs no recursion."""
    star = c.tables[1].agg(F.sum(discounted(F.col("c"), gts[1]))).first()[0]
    alphas = {}
    for n in (2, 3, 4):
        own = c.tables[n].join(c.contexts[n].select(*W[4 - n : 3], "cc"), W[4 - n : 3])
        lower = c.tables[n - 1].select(*W[5 - n :], F.col("c").alias("lc"))
        own = own.join(lower, W[5 - n :])
        if n == 2:
            p = discounted(F.col("lc"), gts[1]) / star
        else:
            own = own.join(c.contexts[n - 1].select(*W[5 - n : 3], F.col("cc").alias("lcc")), W[5 - n : 3])
            p = discounted(F.col("lc"), gts[n - 1]) / F.col("lcc")
        sums = own.groupBy(*W[4 - n : 3]).agg(F.sum(discounted(F.col("c"), gts[n]) / F.col("cc")).alias("a"), F.sum(p).alias("b"))
        beta, rest = F.greatest(F.lit(0.0), 1 - F.col("a")), 1 - F.col("b")
        alphas[n] = sums.select(*W[4 - n : 3], F.when((rest > 1e-9) & (beta > 0), beta / rest).otherwise(1.0).alias(f"alpha{n}"))
    return star, alphas


def katz(c: Counts, n: int, gts: dict[int, dict], star: float) -> Column:
    """L8, over scored rows joined with alpha2..alpha4."""
    p = F.when(F.col("c1") > 0, discounted(F.col("c1"), gts[1]) / star).otherwise(d(0.5) / star)
    for k in range(2, n + 1):
        p = F.when((F.col(f"c{k}") > 0) & (F.col(f"cc{k}") > 0), F.try_divide(discounted(F.col(f"c{k}"), gts[k]), F.col(f"cc{k}"))).otherwise(F.greatest(d(1e-30), F.coalesce(F.col(f"alpha{k}"), F.lit(1.0)) * p))
    return p


def kneser_ney(c: Counts, n: int, discount: float, bigrams: int) -> Column:
    """L10, over scored rows joined with `before`."""
    p = F.when(F.col("before").isNotNull(), F.col("before") / F.lit(bigrams)).otherwise(d(1.0) / c.v)
    for k in range(2, n + 1):
        p = F.when(F.col(f"cc{k}") > 0, F.greatest(F.col(f"c{k}") - d(discount), F.lit(0.0)) / F.col(f"cc{k}") + d(discount) / F.col(f"cc{k}") * F.col(f"kinds{k}") * p).otherwise(p)
    return p


def perplexity(scored: DataFrame, logs: dict[int, Column], *by: str) -> DataFrame:
    """Mean negative log-likelihood and tokens of each order and group."""
    tall = scored.select("m", *by, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), x.alias("lp")) for n, x in logs.items()])).alias("x")).select("m", *by, "x.*")
    return tall.groupBy("n", *by).agg(F.round(-F.sum(F.col("m") * F.col("lp")) / F.sum("m"), 6).alias("nll"), F.sum("m").alias("tokens"))


def floored(p: Column) -> Column:
    return F.log(F.greatest(d(1e-35), p))
