"""Noisy-channel spelling correction.

Candidates one edit away come from the split points of the typo, as rows: insertion,
deletion, substitution and transposition, each with its label, joined with the
vocabulary. Candidates two edits away are searched by a batch function that follows
the prefixes of the vocabulary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Container, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.lineage import cut

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
START = ">"
UNSEEN = 0.5
#: Vocabularies of up to this many words are broadcast to the two-edit search.
MOST_WORDS = 1_000_000


def list_word(text: Column) -> Column:
    """A word of an error list: trimmed, lower case, `_` a blank, without its `*n`."""
    return F.replace(F.lower(F.regexp_replace(F.trim(text), r"\*[0-9]+\z", "")), F.lit("_"), F.lit(" "))


def pairs_of(rows: DataFrame) -> DataFrame:
    """(correct, typo, weight, line) of list rows with these columns: weights of
    repeated pairs summed, the first line kept, pairs without an error left out
    (S13 G26). A `*n` at the typo weighs n times."""
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.trim("typo"), r"\*([0-9]+)\z", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(1))
    clean = rows.select(list_word(F.col("correct")).alias("correct"), list_word(F.col("typo")).alias("typo"), (F.coalesce("weight", F.lit(1)) * n).alias("weight"), F.coalesce("line", F.lit(-1)).alias("line"))
    return clean.filter("correct <> '' and typo <> '' and correct <> typo").groupBy("correct", "typo").agg(F.sum("weight").alias("weight"), F.min("line").alias("line"))


def one_edit(typos: DataFrame) -> DataFrame:
    """(typo, cand, label) of every string one edit away, repeated ones included (P2 P3). What is kept of the
    typo before the edit must be letters; the rest is copied as it is."""
    x = F.col("typo")
    at = typos.select("typo", F.explode(F.sequence(F.lit(0), F.length(x))).alias("i")).select("typo", F.substring(x, F.lit(1), F.col("i")).alias("hd"), F.substring(x, F.col("i") + 1, F.length(x)).alias("tl"))
    at = at.filter(F.col("hd").rlike(r"\A[a-z]*\z"))
    p = F.when(F.col("hd") == "", START).otherwise(F.right("hd", F.lit(1)))
    t0, t1 = F.substring("tl", 1, 1), F.substring("tl", 2, 1)
    rest = lambda k: F.substring(F.col("tl"), F.lit(k), F.length("tl"))
    letters = F.array(*map(F.lit, ALPHABET))
    edit = lambda cand, label: F.struct(cand.alias("cand"), label.alias("label"))
    bar = F.lit("|")
    inserts = F.transform(letters, lambda c: edit(F.concat("hd", c, "tl"), F.concat(p, bar, p, c)))
    swaps = F.transform(F.filter(letters, lambda c: c != t0), lambda c: edit(F.concat("hd", c, rest(2)), F.concat(t0, bar, c)))
    none = F.array().cast("array<struct<cand:string,label:string>>")
    there = F.col("tl") != ""
    deletes = F.when(there, F.array(edit(F.concat("hd", rest(2)), F.concat(p, t0, bar, p)))).otherwise(none)
    turns = F.when((F.length("tl") >= 2) & (t0 != t1), F.array(edit(F.concat("hd", t1, t0, rest(3)), F.concat(t0, t1, bar, t1, t0)))).otherwise(none)
    return at.select("typo", F.inline(F.concat(inserts, F.when(there, swaps).otherwise(none), deletes, turns)))


def _known(typos: DataFrame, vocab: DataFrame) -> DataFrame:
    """one_edit() of the words of `vocab` (`cand`, ...), each once. Some hundred
    strings come of a typo and few are words, so a vocabulary of up to MOST_WORDS
    words, counted, is broadcast and only words are shuffled."""
    held = cut(vocab)
    few = held.limit(MOST_WORDS + 1).count() <= MOST_WORDS
    spread = typos.repartition(typos.sparkSession.sparkContext.defaultParallelism * 4)
    return one_edit(spread).join(F.broadcast(held) if few else held, "cand").distinct()


def candidates(typos: DataFrame, vocab: DataFrame) -> DataFrame:
    """(typo, cand, n, edits): the words one edit away with each label, and the typo
    itself, without edits, where it is a word. `vocab` has `word` and `n`."""
    known = vocab.select(F.col("word").alias("cand"), "n")
    near = _known(typos, known).select("typo", "cand", "n", F.array("label").alias("edits"))
    same = typos.select("typo", F.col("typo").alias("cand")).join(known, "cand").select("typo", "cand", "n", F.array().cast("array<string>").alias("edits"))
    return near.union(same)


def followers(words: Iterable[str]) -> dict[str, str]:
    """The vocabulary as a trie: each prefix with the letters that may come next."""
    nxt: dict[str, set[str]] = {"": set()}
    for w in words:
        for i, c in enumerate(w):
            nxt.setdefault(w[:i], set()).add(c)
        nxt.setdefault(w, set())
    return {p: "".join(sorted(cs)) for p, cs in nxt.items()}


def search(typo: str, words: Container[str], trie: dict[str, str], most: int) -> dict[str, set[tuple[str, ...]]]:
    """All words within `most` edits and every sequence of edits that gives them.

    The trie is walked one letter at a time. At a node stands what reached it: the
    rest of the typo with the edits so far. A row is completed by leaving out letters
    of the rest, then it is handed to the next nodes: as it is along the rest's own
    letter, and at the price of an edit along the others."""
    found: dict[str, set[tuple[str, ...]]] = defaultdict(set)
    level: dict[str, set[tuple[str, tuple[str, ...]]]] = {"": {(typo, ())}}
    while level:
        below: dict[str, set[tuple[str, tuple[str, ...]]]] = defaultdict(set)
        for node, row in level.items():
            last = node[-1] if node else START
            short = row
            while short:
                short = {(rest[1:], (*done, f"{last}{rest[0]}|{last}")) for rest, done in short if rest and len(done) < most} - row
                row = row | short
            branches = [c for c in trie.get(node, "") if c in ALPHABET]
            for rest, done in row:
                if node + rest in words:
                    found[node + rest].add(done)
                if len(done) == most:
                    continue
                for c in branches:
                    below[node + c].add((rest, (*done, f"{last}|{last}{c}")))
                    if rest:
                        below[node + c].add((rest[1:], done if c == rest[0] else (*done, f"{rest[0]}|{c}")))
                if len(rest) > 1 and rest[0] != rest[1] and node + rest[1] in trie:
                    below[node + rest[1]].add((rest[0] + rest[2:], (*done, f"{rest[:2]}|{rest[1]}{rest[0]}")))
        level = below
    return dict(found)


def candidates_within(typos: DataFrame, vocab: DataFrame, most: int = 2) -> DataFrame:
    """candidates() for up to `most` edits, with all edit sequences."""
    held = vocab.select("word", "n").limit(MOST_WORDS + 1).toPandas()
    if len(held) > MOST_WORDS:
        raise ValueError(f"a vocabulary of over {MOST_WORDS} words is not broadcast")
    count = dict(zip(held["word"], held["n"], strict=True))
    sent = typos.sparkSession.sparkContext.broadcast((count, followers(count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, trie = sent.value
        for b in batches:
            rows = [(t, c, count[c], list(e)) for t in b.column(0).to_pylist() for c, es in search(t, count, trie, most).items() for e in es]
            if rows:
                t, c, n, e = map(list, zip(*rows, strict=True))
                yield pa.record_batch({"typo": pa.array(t), "cand": pa.array(c), "n": pa.array(n, pa.int64()), "edits": pa.array(e, pa.list_(pa.string()))})

    parts = typos.sparkSession.sparkContext.defaultParallelism * 4  # a typo costs milliseconds
    return typos.select("typo").repartition(parts).mapInArrow(run, "typo string, cand string, n bigint, edits array<string>")


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance with transpositions, no substring edited twice."""

    def one(x: str, y: str) -> int | None:
        if x is None or y is None:
            return None
        two, last = [], list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i]
            for j, e in enumerate(y, 1):
                d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == e:
                    d = min(d, two[j - 2] + 1)
                row.append(d)
            two, last = last, row
        return last[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """(edit, c): weights of the least label of every pair one edit apart."""
    words = pairs.select(F.col("correct").alias("cand")).distinct()
    labels = _known(pairs.select("typo").distinct(), words).withColumnRenamed("cand", "correct")
    least = pairs.join(labels, ["typo", "correct"]).groupBy("typo", "correct", "weight", *by).agg(F.min("label").alias("edit"))
    return least.groupBy("edit", *by).agg(F.sum("weight").alias("c"))


def context_counts(vocab: DataFrame) -> DataFrame:
    """(ctx, cc): weighted counts of single and double characters, with a mark at the
    start of words (G25)."""
    s = F.concat(F.lit(START), F.col("word"))
    at = vocab.select("n", s.alias("s"), F.explode(F.sequence(F.lit(1), F.length(s))).alias("i"))
    grams = at.select("n", F.explode(F.array(F.substring("s", F.col("i"), F.lit(1)), F.when(F.col("i") < F.length("s"), F.substring("s", F.col("i"), F.lit(2))))).alias("ctx")).filter("ctx is not null")
    return grams.groupBy("ctx").agg(F.sum("n").alias("cc"))


def aligned_counts(pairs: DataFrame, cands: DataFrame, *by: str) -> DataFrame:
    """(edit, c): weights of the edits of every pair's minimal alignment, the shortest
    sequence and of these the first in order, among those of `cands` (P9)."""
    ways = pairs.join(cands.select("typo", F.col("cand").alias("correct"), "edits"), ["typo", "correct"])
    least = ways.groupBy("typo", "correct", "weight", *by).agg(F.min(F.struct(F.size("edits"), "edits")).alias("m"))
    return least.select("weight", *by, F.explode("m.edits").alias("edit")).groupBy("edit", *by).agg(F.sum("weight").alias("c"))


def channel(cands: DataFrame, edits: DataFrame, contexts: DataFrame | None = None, *by: str, most: int = 2) -> DataFrame:
    """(typo, cand, n, identity, lp): the log probability of the likeliest sequence of
    up to `most` edits that gives the candidate, without the probability that there is
    an error; a candidate that is the typo itself is no error (P4 P5). With `contexts`,
    edits are conditional on their correct side. Of columns `by`, `edits` has a table
    each. Labels are few: pairs of letters, and each has one probability."""
    total = edits.groupBy(*by).agg(F.sum("c").alias("total"))
    labels = cands.select(F.explode("edits").alias("edit")).distinct()
    if by:
        groups = total.select(*by)
        labels = labels.crossJoin(F.broadcast(groups))  # a few groups
        logs = labels.join(edits, ["edit", *by], "left").join(F.broadcast(total), list(by))
    else:
        logs = labels.join(edits, "edit", "left").crossJoin(F.broadcast(total))
    c = F.coalesce(F.col("c").cast("double"), F.lit(UNSEEN))
    if contexts is None:
        logs = logs.withColumn("le", F.log(c / F.col("total")))
    else:
        logs = logs.withColumn("ctx", F.split_part("edit", F.lit("|"), F.lit(2))).join(contexts, "ctx", "left").withColumn("le", F.log(c / F.greatest(F.coalesce("cc", F.lit(0)), F.lit(1))))
    rows = cands.crossJoin(F.broadcast(groups)) if by else cands
    places = range(1, most + 1)
    rows = rows.select("typo", "cand", "n", *by, *(F.try_element_at("edits", F.lit(i)).alias(f"e{i}") for i in places))
    for i in places:
        rows = rows.join(logs.select(F.col("edit").alias(f"e{i}"), F.col("le").alias(f"l{i}"), *by), [f"e{i}", *by], "left")
    sequence = sum((F.coalesce(f"l{i}", F.lit(0.0)) for i in places), F.lit(0.0))
    out = rows.groupBy("typo", "cand", "n", *by).agg(F.max(sequence).alias("lp"), F.max(F.col("e1").isNull()).alias("identity"))
    return out.select("typo", "cand", "n", *by, F.when(F.col("identity"), 0.0).otherwise(F.col("lp")).alias("lp"), "identity")
