"""Word segmentation of text without blanks, over a broadcast vocabulary.

The recurrences run along one text, so they are batch functions, which walk a trie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vocabulary over this many words isn't broadcast.
MOST_WORDS = 2_000_000


class Trie:
    """A vocabulary as nested dictionaries; a word's count stands at '' (T8 T9). Sent
    to a worker as its words and laid out there once."""

    def __init__(self, vocab: dict[str, int]) -> None:
        self.vocab, self.total = vocab, sum(vocab.values())
        self.root: dict = {}
        self.longest = max(map(len, vocab), default=0)
        for w, c in vocab.items():
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = c

    def __reduce__(self):
        return Trie, (self.vocab,)

    def words_from(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(end, count) of the words that begin at a place of the text, short ones first."""
        node = self.root
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            if "" in node:
                yield end + 1, node[""]

    def greedy(self, text: str) -> list[str]:
        """Longest match from the left, a single character where nothing matches."""
        out, at = [], 0
        while at < len(text):
            end = at + 1
            for end, _ in self.words_from(text, at):
                pass
            out.append(text[at:end])
            at = end
        return out

    def best_path(self, text: str) -> list[str]:
        """The segmentation of greatest unigram probability; unknown words of n
        characters count 10 / (total * 10^n), and of equals the longest last word wins
        (T7). Each place hands its best score on to where the words from it end."""
        n, reach = len(text), max(self.longest, 1)
        known = [math.log(10 / self.total) if self.total else 0.0]
        best = [(0.0, 0)] + [(-math.inf, 0)] * n
        for at in range(n):
            sofar = best[at][0]
            words = dict(self.words_from(text, at))
            for end in range(at + 1, min(n, at + reach) + 1):
                c = words.get(end)
                p = sofar + (math.log(c / self.total) if c else known[0] - (end - at) * math.log(10))
                if p > best[end][0]:
                    best[end] = p, at
        out = []
        while n:
            out.append(text[best[n][1] : n])
            n = best[n][1]
        return out[::-1]


def greedy(text: str, vocab: dict[str, int], longest: int) -> list[str]:
    """Trie.greedy() by slices of at most `longest` characters."""
    out = []
    while text:
        sizes = range(min(longest, len(text)), 0, -1)
        out.append(text[: next((k for k in sizes if text[:k] in vocab), 1)])
        text = text[len(out[-1]) :]
    return out


def segmented(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """`key`, `greedy` and `dp` of each text, words joined by a blank. `vocab` has
    `word` and `n`; it is counted, and refused beyond MOST_WORDS."""
    held = vocab.select("word", "n").limit(MOST_WORDS + 1).toPandas()
    if len(held) > MOST_WORDS:
        raise ValueError(f"a vocabulary of over {MOST_WORDS} words is not broadcast")
    sent = df.sparkSession.sparkContext.broadcast(Trie(dict(zip(held["word"], map(int, held["n"]), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.record_batch({key: b.column(0), "greedy": pa.array([None if t is None else " ".join(trie.greedy(t)) for t in texts], pa.string()), "dp": pa.array([None if t is None else " ".join(trie.best_path(t)) for t in texts], pa.string())})

    kind = df.schema[key].dataType.simpleString()
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df.select(key, text).repartition(parts).mapInArrow(run, f"{key} {kind}, greedy string, dp string")


def agreement(truth: Column, found: Column) -> dict[str, Column]:
    """Exact match, mean edit distance and the same per character."""
    dist = F.levenshtein(found, truth)
    return {
        "exact": F.round(F.avg((truth == found).cast("double")), 6),
        "distance": F.round(F.avg(dist), 6),
        "normalised": F.round(F.avg(dist / F.greatest(F.length(truth), F.lit(1))), 6),
    }
