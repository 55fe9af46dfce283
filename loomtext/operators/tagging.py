"""Sequence labelling: Naive Bayes and hidden Markov taggers, and their metrics.

Tagged sentences are rows (`sent`, `pos`, `word`, `tag`). Everything that is counted
is relational; only the recurrences along a sentence run as grouped batch functions,
over parameter tables that have as many rows as tags and known words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"
FEATURES = ["len", "word", "prev", "next", "ptag"]


def featured(tokens: DataFrame) -> DataFrame:
    """Add the five features, the previous tag being the given one."""
    w = Window.partitionBy("sent").orderBy("pos")
    return tokens.select("*", F.when(F.length("word") > 4, "MORE").otherwise("LESS").alias("len"), F.lag("word", 1, BOS).over(w).alias("prev"), F.lead("word", 1, EOS).over(w).alias("next"), F.lag("tag", 1, BOS).over(w).alias("ptag"))


def melted(feats: DataFrame, *keep: str) -> DataFrame:
    return feats.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("f")).select(*keep, "f.*")


def nb_fit(tokens: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Log likelihoods (feature, value, tag, ll, unseen) of every seen value and tag,
    and log priors (tag, n, prior) (C3 G18)."""
    feats = featured(tokens)
    tags = feats.groupBy("tag").agg(F.count("*").alias("n"))
    total = feats.agg(F.count("*").alias("_all"))
    prior = tags.crossJoin(F.broadcast(total)).select("tag", "n", F.log(F.col("n") / F.col("_all")).alias("prior"))
    c = melted(feats, "tag").groupBy("feature", "value", "tag").agg(F.count("*").alias("c"))
    kinds = c.select("feature", "value").distinct()
    size = kinds.groupBy("feature").agg(F.count("*").alias("values"))
    grid = kinds.join(F.broadcast(size), "feature").crossJoin(F.broadcast(tags))  # a row for each tag
    denom = F.col("n") + F.lit(alpha) * (F.col("values") + 1)
    lik = grid.join(c, ["feature", "value", "tag"], "left").select("feature", "value", "tag", F.log((F.coalesce("c", F.lit(0)) + F.lit(alpha)) / denom).alias("ll"))
    unseen = size.crossJoin(F.broadcast(tags)).select("feature", "tag", F.log(F.lit(alpha) / denom).alias("unseen"))
    return lik.join(F.broadcast(unseen), ["feature", "tag"]), prior


def nb_tag_gold(tokens: DataFrame, lik: DataFrame, prior: DataFrame) -> DataFrame:
    """`pred` of every token, the previous tag being the gold one."""
    feats = melted(featured(tokens), "sent", "pos", "word", "tag")
    tags = prior.select(F.col("tag").alias("t"), "prior")
    unseen = lik.select("feature", F.col("tag").alias("t"), "unseen").distinct()
    rows = feats.join(F.broadcast(unseen), "feature").join(lik.select("feature", "value", F.col("tag").alias("t"), "ll"), ["feature", "value", "t"], "left")
    score = rows.groupBy("sent", "pos", "word", "tag", "t").agg(F.sum(F.coalesce("ll", "unseen")).alias("s")).join(F.broadcast(tags), "t").withColumn("s", F.round(F.col("s") + F.col("prior"), 9))
    best = F.row_number().over(Window.partitionBy("sent", "pos").orderBy(F.desc("s"), "t"))
    return score.withColumn("r", best).filter("r = 1").select("sent", "pos", "word", "tag", F.col("t").alias("pred"))


def hmm_transitions(tokens: DataFrame, k: float) -> DataFrame:
    """Counts of tag pairs on the chain with its ends, zero cells too, with forward
    and backward probabilities (C6 G17): `a`, `b`, `c`, `forward`, `backward`."""
    w = Window.partitionBy("sent").orderBy("pos")
    chain = tokens.select("sent", "pos", F.lag("tag", 1, BOS).over(w).alias("a"), F.col("tag").alias("b"), (F.lead("tag").over(w).isNull()).alias("last"))
    pairs = chain.select("a", "b").union(chain.filter("last").select(F.col("b").alias("a"), F.lit(EOS).alias("b")))
    c = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    tags = tokens.select("tag").distinct()
    sq = tags.select(F.col("tag").alias("a")).union(tags.sparkSession.createDataFrame([(BOS,)], "a string")).crossJoin(tags.select(F.col("tag").alias("b")).union(tags.sparkSession.createDataFrame([(EOS,)], "b string")))  # tags by tags
    full = sq.join(c, ["a", "b"], "left").na.fill(0, ["c"])
    one = F.col("c") + F.lit(k)
    return full.select("a", "b", "c", (one / F.sum(one).over(Window.partitionBy("a"))).alias("forward"), (one / F.sum(one).over(Window.partitionBy("b"))).alias("backward"))


def hmm_emissions(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, tag, p) of seen pairs and (tag, p) of unknown words, by hapax counts."""
    wt = tokens.groupBy("word", "tag").agg(F.count("*").alias("c"))
    words = wt.groupBy("word").agg(F.sum("c").alias("wn"))
    hapax = wt.join(words.filter("wn = 1"), "word").groupBy("tag").agg(F.count("*").alias("h"))
    tags = wt.groupBy("tag").agg(F.sum("c").alias("n")).join(hapax, "tag", "left").select("tag", "n", (F.coalesce("h", F.lit(0)) + 0.5).alias("h"))
    emit = wt.join(F.broadcast(tags), "tag").select("word", "tag", (F.col("c") / (F.col("n") + F.col("h"))).alias("p"))
    return emit, tags.select("tag", (F.col("h") / (F.col("n") + F.col("h"))).alias("p"))


def hmm_joint(tokens: DataFrame, trans: DataFrame, emit: DataFrame, unk: DataFrame) -> DataFrame:
    """Log probability of every tagged sentence in both directions (C10 J7). A known
    word under a tag never seen with it makes a sentence impossible: -Infinity."""
    w = Window.partitionBy("sent").orderBy("pos")
    rows = tokens.select("sent", "word", "tag", F.lag("tag", 1, BOS).over(w).alias("a"), F.lead("tag", 1, EOS).over(w).alias("z"))
    known = emit.select("word").distinct().withColumn("known", F.lit(True))
    e = rows.join(known, "word", "left").join(emit.withColumnRenamed("p", "ep"), ["word", "tag"], "left").join(F.broadcast(unk.withColumnRenamed("p", "up")), "tag")
    e = e.withColumn("le", F.when(F.col("known").isNull(), F.log("up")).otherwise(F.coalesce(F.log("ep"), F.lit(float("-inf")))))
    t = trans.select("a", F.col("b").alias("tag"), F.log("forward").alias("f"), F.log("backward").alias("g"))
    e = e.join(F.broadcast(t), ["a", "tag"])
    end = trans.filter(F.col("b") == EOS).select(F.col("a").alias("tag"), F.log("forward").alias("fe"), F.log("backward").alias("ge"))
    e = e.join(F.broadcast(end), "tag").withColumn("last", F.col("z") == EOS)
    sums = lambda x, y: F.sum(F.col("le") + F.col(x) + F.when(F.col("last"), F.col(y)).otherwise(0.0))
    return e.groupBy("sent").agg(sums("f", "fe").alias("forward"), sums("g", "ge").alias("backward"), F.count("*").alias("tokens"))


class Hmm:
    """The parameters of hmm_transitions() and hmm_emissions() as arrays for decoding."""

    def __init__(self, trans: pd.DataFrame, emit: pd.DataFrame, unk: pd.DataFrame) -> None:
        self.tags = sorted(unk.tag)
        at = {t: i for i, t in enumerate(self.tags)}
        n = len(self.tags)
        with np.errstate(divide="ignore"):
            self.fwd, self.bwd = np.full((n + 1, n + 1), -np.inf), np.full((n + 1, n + 1), -np.inf)
            for a, b, f, g in zip(trans.a, trans.b, trans.forward, trans.backward, strict=True):
                self.fwd[at.get(a, n), at.get(b, n)], self.bwd[at.get(a, n), at.get(b, n)] = math.log(f), math.log(g)
            self.unk = np.log(unk.set_index("tag").p.reindex(self.tags).to_numpy())
            self.emit: dict[str, np.ndarray] = {}
            for w, t, p in zip(emit.word, emit.tag, emit.p, strict=True):
                self.emit.setdefault(w, np.full(n, -np.inf))[at[t]] = math.log(p)
        self.n = n

    def scores(self, words: list[str] | np.ndarray) -> np.ndarray:
        """The emission vectors of the words; vectors stay as they are."""
        return words if isinstance(words, np.ndarray) else np.stack([self.emit.get(w, self.unk) for w in words])

    def _trellis(self, e: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
        best, back = first + e[0], []
        for x in e[1:]:
            all_ = best[:, None] + step
            back.append(all_.argmax(0))
            best = all_.max(0) + x
        at = [int((best + last).argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return at[::-1]

    def forward(self, words: list[str] | np.ndarray) -> list[int]:
        """Viterbi from left to right."""
        n = self.n
        return self._trellis(self.scores(words), self.fwd[:n, :n], self.fwd[n, :n], self.fwd[:n, n])

    def backward(self, words: list[str] | np.ndarray) -> list[int]:
        """Viterbi from right to left over P(previous | next)."""
        n = self.n
        return self._trellis(self.scores(words)[::-1], self.bwd[:n, :n].T, self.bwd[:n, n], self.bwd[n, :n])[::-1]

    def _sides(self, e: np.ndarray, fold: Callable) -> tuple[np.ndarray, np.ndarray]:
        n, step = self.n, self.fwd[: self.n, : self.n]
        a, b = [self.fwd[n, :n] + e[0]], [self.fwd[:n, n]]
        for x in e[1:]:
            a.append(fold(a[-1][:, None] + step, 0) + x)
        for x in e[:0:-1]:
            b.append(fold(step + (x + b[-1])[None, :], 1))
        return np.array(a), np.array(b[::-1])

    def posterior(self, words: list[str] | np.ndarray) -> list[int]:
        """The tag of greatest posterior at every position."""

        def fold(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis))

        a, b = self._sides(self.scores(words), fold)
        return (a + b).argmax(1).tolist()

    def max_marginal(self, words: list[str] | np.ndarray) -> list[int]:
        """The tag on the single best path at every position (C11)."""
        a, b = self._sides(self.scores(words), lambda x, axis: x.max(axis))
        return (a + b).argmax(1).tolist()


def hmm_sentences(tokens: DataFrame, emit: DataFrame, unk: DataFrame) -> DataFrame:
    """(sent, s: array of pos, word, tag, e): every sentence with the emission vectors
    of its words, over the tags in sorted order; joined as one vector a word."""
    per = {r["tag"]: r["p"] for r in unk.collect()}  # a row a tag
    tags = sorted(per)
    vectors = emit.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.log("p")))).alias("m"))
    vectors = vectors.select("word", F.transform(F.array(*map(F.lit, tags)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(float("-inf")))).alias("e"))
    rows = tokens.select("sent", "pos", "word", "tag").join(vectors, "word", "left").withColumn("e", F.coalesce("e", F.array(*[F.log(F.lit(float(per[t]))) for t in tags])))
    return rows.groupBy("sent").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "tag", "e"))).alias("s"))


def hmm_runs(sentences: DataFrame, trans: DataFrame, unk: DataFrame, *how: str) -> DataFrame:
    """`sent`, `pos`, `word`, `tag` and a column of predicted tags for each way to decode
    hmm_sentences(); only tables of tags, and of pairs of tags, come to the driver."""
    model = Hmm(trans.toPandas(), pd.DataFrame({"word": [], "tag": [], "p": []}), unk.toPandas())
    held = sentences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            at = np.asarray(pc.list_value_length(batch.column(1)))
            tok = batch.column(1).flatten()
            e = np.asarray(tok.field("e").flatten()).reshape(-1, m.n)
            ends = np.cumsum(at)
            found = {h: pa.array([m.tags[i] for a, b in zip(ends - at, ends, strict=True) for i in getattr(m, h)(e[a:b])], pa.string()) for h in how}
            yield pa.record_batch({"sent": batch.column(0).take(pa.array(np.repeat(np.arange(len(at)), at))), "pos": tok.field("pos"), "word": tok.field("word"), "tag": tok.field("tag")} | found)

    fields = {f.name: f.dataType.simpleString() for f in sentences.schema["s"].dataType.elementType.fields}
    return sentences.mapInArrow(run, f"sent {sentences.schema['sent'].dataType.simpleString()}, pos {fields['pos']}, word string, tag string" + "".join(f", {h} string" for h in how))


def hmm_decode(tokens: DataFrame, trans: DataFrame, emit: DataFrame, unk: DataFrame, how: str) -> DataFrame:
    """`pred` of every token by one of forward, backward, posterior, max_marginal; tags
    in sorted order decide ties. Sentences are gathered as arrays with the emission
    vectors of their words and decoded in batches."""
    return hmm_runs(hmm_sentences(tokens, emit, unk), trans, unk, how).withColumnRenamed(how, "pred")


def nb_decode(tokens: DataFrame, lik: DataFrame, prior: DataFrame) -> DataFrame:
    """`pred` of every token, the previous tag being the predicted one."""
    p = prior.toPandas().sort_values("tag")
    tags = p.tag.tolist()
    at = {t: i for i, t in enumerate(tags)}
    table: dict = {}
    none: dict = {}
    for f, v, t, ll, u in lik.select("feature", "value", "tag", "ll", "unseen").toPandas().itertuples(index=False):
        table.setdefault((f, v), np.zeros(len(tags)))[at[t]] = ll
        none.setdefault(f, np.zeros(len(tags)))[at[t]] = u
    held = tokens.sparkSession.sparkContext.broadcast((tags, p.prior.to_numpy(), table, none))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tags, prior_, table, none = held.value
        pdf = pdf.sort_values("pos")
        words, out, prev = pdf.word.tolist(), [], BOS
        for i, w in enumerate(words):
            values = ("MORE" if len(w) > 4 else "LESS", w, words[i - 1] if i else BOS, words[i + 1] if i + 1 < len(words) else EOS, prev)
            score = prior_ + sum(table.get((f, v), none[f]) for f, v in zip(FEATURES, values, strict=True))
            prev = tags[int(np.round(score, 9).argmax())]
            out.append(prev)
        return pdf.assign(pred=out)

    kind, pos = tokens.schema["sent"].dataType.simpleString(), tokens.schema["pos"].dataType.simpleString()
    return tokens.select("sent", "pos", "word", "tag").groupBy("sent").applyInPandas(run, f"sent {kind}, pos {pos}, word string, tag string, pred string")


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(pred: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and support of every tag."""
    c = pred.groupBy("tag", "pred").agg(F.count("*").alias("n"))
    both = c.select(F.explode(F.array(F.struct(F.col("tag").alias("t"), F.when(F.col("tag") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("tag") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("pred").alias("t"), F.lit(0).cast("long").alias("tp"), F.when(F.col("tag") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    s = both.groupBy(F.col("t").alias("tag")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = ratio0(F.col("tp"), F.col("tp") + F.col("fp")), ratio0(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("tag", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio0(2 * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def overall(pred: DataFrame) -> DataFrame:
    """Accuracy, macro F1 over tags that occur, and F1 weighted by support."""
    s = per_class(pred)
    live = F.when(F.col("support") > 0, F.col("f1"))
    return s.agg(F.sum("support").alias("tokens"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(live), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


def confusion(pred: DataFrame) -> DataFrame:
    """Pairs of gold and predicted tag, with the share of the gold tag."""
    c = pred.groupBy("tag", "pred").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tag")), 6))
