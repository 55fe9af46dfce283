"""Problem 7: evaluation texts that leak into training text.

The test items form an inverted index whose terms are pairs of neighbouring words,
weighted by BM25 and scaled so that an item's whole text scores 1. Every training
passage is a query, answered as in block-max WAND: a passage's terms are ordered by
the most they can add, and those before the pivot cannot reach the threshold by
themselves, so only the blocks of items in the lists behind it are looked at; of
these, the blocks whose own bounds reach the threshold are scored, and the postings
of all others are never read. What is retrieved is verified: the words of the item,
its question and its answer, that recur in order, in stretches, are aligned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.lookalike import table_form

#: Items, and characters of items, of one index; more are searched for in several passes.
ITEMS, ITEM_CHARS = 50_000, 200_000_000
#: Items whose weights share a bound.
BLOCK = 4
K1, B = 1.2, 0.75
#: Least score, of 1, for an item to be verified: an item of which half recurs
#: with a few words changed still holds a quarter of its word pairs.
SCORE = 0.2
#: Least part of an item's words that must recur. Half is asked for; a tenth of
#: that may have been changed or left out.
COVERAGE = 0.45
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_SINGLE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])[\p{L}\p{M}\p{N}])+")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+")
#: Letters from which an unknown run may be several words whose blanks were lost.
GLUED = 30
MARKUP = r"</?[A-Za-z][^<>]{0,300}>|&(?:[a-z]{2,8}|#[0-9]{1,6});"


def words_of(chunk: str) -> list[str]:
    """Words between two blanks: canonical characters, lower case, no punctuation;
    a link is one word, and so is a character of a script without blanks."""
    chunk = table_form(chunk).lower()
    if chunk.isascii() and chunk.isalnum():
        return [chunk]
    if _LINK.fullmatch(chunk):
        return ["".join(_WORD.findall(chunk))]
    return [w for run in _WORD.findall(chunk) for w in (_SINGLE.findall(run) if not run.isascii() else [run])]


class Parts:
    """Known words as a trie, to find them in a run of letters without blanks."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known, self.root = known, {}
        for w in known:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def __call__(self, run: str) -> list[int]:
        """Ids of the known words that cover most of the run, few words before many,
        with 0 for what lies between; just 0 if no three of them, of twelve letters
        or more together, follow one another."""
        n = len(run)
        best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # letters covered, -words, end of the first piece
        for at in range(n - 1, -1, -1):
            best[at] = (best[at + 1][0], best[at + 1][1], 0)
            node = self.root
            for end in range(at, n):
                node = node.get(run[end])
                if node is None:
                    break
                if "" in node:
                    rest = best[end + 1]
                    best[at] = max(best[at], (rest[0] + end + 1 - at, rest[1] - 1, end + 1))
        out, at, since, longest = [], 0, (0, 0), False
        while at < n:
            end = best[at][2]
            if end:
                out.append(self.known[run[at:end]])
                since = since[0] + 1, since[1] + end - at
                longest |= since[0] >= 3 and since[1] >= 12
            elif not out or out[-1]:
                out.append(0)
                since = (0, 0)
            at = end or at + 1
        return out if longest else [0]


def word_ids(texts: pa.Array, known: dict[str, int], parts: Parts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as ids (0 for those not in `known`), and the text of each.
    A long run of letters that is no known word is looked through for known ones."""
    parts = parts or Parts(known)
    chunks = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), MARKUP, " "))
    flat = pc.list_flatten(chunks)
    parent = np.asarray(pc.list_parent_indices(chunks)).astype(np.int64)
    if not len(flat):
        return np.zeros(0, np.int64), parent
    coded = flat.dictionary_encode()
    split = [[i for w in words_of(c) for i in (parts(w) if len(w) >= GLUED and w not in known else (known.get(w, 0),))] for c in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, split), np.int64, len(split))
    start = np.r_[0, np.cumsum(size)]
    ids = np.fromiter((x for s in split for x in s), np.int64, int(start[-1]))
    codes = np.asarray(coded.indices).astype(np.int64)
    n = size[codes]
    first = np.repeat(np.cumsum(n) - n, n)
    return ids[np.repeat(start[codes], n) + np.arange(int(n.sum())) - first], np.repeat(parent, n)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Index:
    """Postings of word pairs over test items, and bounds of their weights. Of an item
    of one word the word itself is the term."""

    def __init__(self, items: list[tuple]) -> None:
        """`items`: (id, text) or (id, question, answer)."""
        self.known: dict[str, int] = {}
        self.ids, self.words, self.question = [], [], []
        for item, *texts in sorted(items, key=lambda x: (x[0], *(t or "" for t in x[1:]))):
            ws = [[self.known.setdefault(w, len(self.known) + 1) for c in re.sub(MARKUP, " ", t or "").split() for w in words_of(c)] for t in texts]
            if any(ws):
                self.ids.append(item)
                self.words.append(np.array(sum(ws, []), np.int64))
                self.question.append(len(ws[0]) if len(ws) > 1 else len(ws[0]) // 2)
        self.base, n = len(self.known) + 1, len(self.words)
        terms = [w[:-1] * self.base + w[1:] if len(w) > 1 else w for w in self.words]
        length = np.fromiter(map(len, terms), np.int64, n)
        term, item = np.concatenate([*terms, np.zeros(0, np.int64)]), np.repeat(np.arange(n), length)
        key, tf = np.unique(np.stack([term, item]), axis=1, return_counts=True)
        term, self.item = key
        self.terms, self.start, self.size = np.unique(term, return_index=True, return_counts=True)
        slot = np.repeat(np.arange(len(self.terms)), self.size)
        idf = np.log(1 + (n - self.size + 0.5) / (self.size + 0.5))[slot]
        raw = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.item] / max(1.0, length.mean() if n else 1.0)))
        self.weight = raw / np.bincount(self.item, raw, n)[self.item] if n else raw
        self.most = np.maximum.reduceat(self.weight, self.start) if n else raw
        # a list is cut into blocks of BLOCK items
        self.n_blocks = n // BLOCK + 1
        self.b_key, self.b_first, self.b_size = np.unique(slot * self.n_blocks + self.item // BLOCK, return_index=True, return_counts=True)
        self.b_most = np.maximum.reduceat(self.weight, self.b_first) if n else raw
        self.b_start = np.searchsorted(self.b_key, np.arange(len(self.terms)) * self.n_blocks)
        self.b_count = np.searchsorted(self.b_key, (np.arange(len(self.terms)) + 1) * self.n_blocks) - self.b_start
        self.grams = [self.three(w) for w in self.words]
        self.single = np.unique(np.concatenate([*(w for w in self.words if len(w) == 1), np.zeros(0, np.int64)]))
        self.read = 0

    def three(self, w: np.ndarray) -> np.ndarray:
        return (w[:-2] * self.base + w[1:-1]) * self.base + w[2:]

    def _block(self, slot: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the block of each list is, and whether there is one."""
        key = slot * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.b_key, key), len(self.b_key) - 1)
        return at, self.b_key[at] == key

    def retrieve(self, ids: np.ndarray, passage: np.ndarray, count: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all scores of at least `least`; `read` counts the postings read."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(ids):
            return none, none
        both = (ids[:-1] > 0) & (ids[1:] > 0) & (passage[:-1] == passage[1:])
        term, at = (ids[:-1] * self.base + ids[1:])[both], passage[:-1][both]
        if len(self.single):
            lone = np.isin(ids, self.single)
            term, at = np.r_[term, ids[lone]], np.r_[at, passage[lone]]
        slot = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[slot] == term
        seen = np.unique(at[hit] * len(self.terms) + slot[hit])  # a query's term counts once
        at, slot = seen // len(self.terms), seen % len(self.terms)
        keep = np.bincount(at, self.most[slot], count)[at] >= least
        at, slot = at[keep], slot[keep]
        if not len(at):
            return none, none
        # the pivot: terms in ascending order of bound, up to where their sum reaches the threshold
        order = np.lexsort((self.most[slot], at))
        at, slot = at[order], slot[order]
        upto = np.cumsum(self.most[slot])
        first = np.searchsorted(at, np.arange(count))
        behind = upto - np.r_[0.0, upto][first][at] >= least
        # blocks in the lists behind the pivot, with their bounds; the others are asked for these blocks only
        e_at, e_slot = at[behind], slot[behind]
        r = ranges(self.b_start[e_slot], self.b_count[e_slot])
        cell, where = np.unique(np.repeat(e_at, self.b_count[e_slot]) * self.n_blocks + self.b_key[r] % self.n_blocks, return_inverse=True)
        bound = np.bincount(where, self.b_most[r], len(cell))
        w_at, w_slot = at[~behind], slot[~behind]
        weak = np.bincount(w_at, self.most[w_slot], count)
        keep = bound + weak[cell // self.n_blocks] >= least
        cell, bound = cell[keep], bound[keep]
        begin, size = np.searchsorted(w_at, cell // self.n_blocks), np.bincount(w_at, minlength=count)[cell // self.n_blocks]
        lists = w_slot[ranges(begin, size)]
        b, there = self._block(lists, np.repeat(cell % self.n_blocks, size))
        bound = bound + np.bincount(np.repeat(np.arange(len(cell)), size)[there], self.b_most[b[there]], len(cell))
        cell = cell[bound >= least]
        # the postings of the blocks that are left
        begin, size = first[cell // self.n_blocks], np.bincount(at, minlength=count)[cell // self.n_blocks]
        lists = slot[ranges(begin, size)]
        b, there = self._block(lists, np.repeat(cell % self.n_blocks, size))
        who, b = np.repeat(cell // self.n_blocks, size)[there], b[there]
        r = ranges(self.b_first[b], self.b_size[b])
        self.read += len(r)
        pair, where = np.unique(np.repeat(who, self.b_size[b]) * len(self.words) + self.item[r], return_inverse=True)
        pair = pair[np.bincount(where, self.weight[r], len(pair)) >= least]
        return pair // len(self.words), pair % len(self.words)


def _common(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def covered(item: np.ndarray, text: np.ndarray, item_grams: np.ndarray, text_grams: np.ndarray, *, gap: int = 8) -> list[bool]:
    """Which words of `item` recur in `text`, by the best chain of stretches of
    three words or more that keeps their order; of short gaps between two
    stretches, single words that recur in order count too."""
    n = len(item)
    got = [False] * n
    if n < 3:
        width = np.lib.stride_tricks.sliding_window_view(text, n) if len(text) >= n else np.zeros((0, n))
        return [True] * n if len(width) and (width == item).all(1).any() else got
    where: dict[int, list[int]] = {}
    for i, g in enumerate(item_grams.tolist()):
        where.setdefault(g, []).append(i)
    at = np.flatnonzero(np.isin(text_grams, item_grams))
    runs: list[list[int]] = []
    open_: dict[tuple[int, int], list[int]] = {}
    for j, g in zip(at.tolist(), text_grams[at].tolist(), strict=True):
        for i in where[g]:
            run = open_.pop((i, j), None)
            if run is None:
                run = [i, j, 3]
                runs.append(run)
            else:
                run[2] += 1
            open_[i + 1, j + 1] = run
    best, back = np.zeros(len(runs), np.int64), []
    # runs that can still be the best to go on from: of those at one place of the item a
    # later one only where it ends a better chain
    live, lead, held = np.zeros((5, len(runs)), np.int64), {}, 0
    for k, (i, j, m) in enumerate(runs):
        pi, pj, pm, score = live[:4, :held]
        lap = np.maximum(0, np.maximum(pi + pm - i, pj + pm - j))  # a stretch may begin within the one before
        gain = np.where((pi < i) & (pj < j) & (lap < m), score - lap, 0)
        at_best = int(gain.argmax()) if held else -1
        most = int(gain[at_best]) if held else 0
        best[k] = m + most
        back.append(int(live[4, at_best]) if most > 0 else -1)
        if best[k] > lead.get((i, m), 0):
            lead[i, m] = int(best[k])
            live[:, held] = i, j, m, best[k], k
            held += 1
    k = int(np.argmax(best)) if len(best) else -1
    after = None
    while k >= 0:
        i, j, m = runs[k]
        got[i : i + m] = [True] * m
        if after is not None:
            gi, gj = item[i + m : after[0]].tolist(), text[j + m : after[1]].tolist()
            if 0 < len(gi) and 0 < len(gj) <= len(gi) + gap:
                for x in range(_common(gi, gj)):
                    got[i + m + x] = True
        after, k = (i, j), back[k]
    return got


def _leaks(index, least_score: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        parts = Parts(ix.known)
        for batch in batches:
            ids, passage = word_ids(batch.column(1), ix.known, parts)
            at, item = ix.retrieve(ids, passage, batch.num_rows, least_score)
            if not len(at):
                continue
            begin = np.searchsorted(passage, np.arange(batch.num_rows + 1))
            out, last, grams = [], -1, None
            for p, i in zip(at.tolist(), item.tolist(), strict=True):
                text = ids[begin[p] : begin[p + 1]]
                if p != last:
                    last, grams = p, ix.three(text) if len(text) > 2 else np.zeros(0, np.int64)
                    if len(text) > 2:
                        grams = np.where((text[:-2] > 0) & (text[1:-1] > 0) & (text[2:] > 0), grams, -1)
                got = covered(ix.words[i], text, ix.grams[i], grams)
                q = ix.question[i]
                if sum(got) >= least * len(got):
                    out.append((p, ix.ids[i], sum(got) / len(got), sum(got[:q]) / max(1, q), sum(got[q:]) / max(1, len(got) - q)))
            if out:
                p, i, c, h, t = map(list, zip(*out, strict=True))
                yield pa.record_batch({"id": batch.column(0).take(pa.array(p, pa.int64())), "item": pa.array(i, pa.int64()), "coverage": pa.array(c, pa.float64()), "question": pa.array(h, pa.float64()), "answer": pa.array(t, pa.float64())})

    return run


def leaked_items(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, item_answer: str | None = None, *, least_score: float = SCORE, least: float = COVERAGE) -> DataFrame:
    """Every row of `df` that holds at least `least` of an item's words in order:
    `key`, `item` (BIGINT), `coverage`, and the coverage of the item's `question` and
    `answer`: of `item_text` and `item_answer`, or of the item's halves where there is
    no column of answers.

    Up to ITEMS items of ITEM_CHARS characters, counted, are indexed on the driver at
    once and searched for in one pass over all rows, without a shuffle; more take
    several passes. Null and blank texts and items leak nothing; items under one text
    are each a row; null item keys are passed over, repeated rows of `df` are each
    searched; other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    columns = [F.col(item_text).alias("q")] + ([F.col(item_answer).alias("a")] if item_answer else [])
    source = items.select(F.col(item_key).cast("bigint").alias("i"), *columns).filter("i is not null and q is not null").distinct()
    size = source.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("q")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // ITEM_CHARS))
    out = None
    for b in range(blocks):
        part = source.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else source
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()]))
        found = df.select(key, text).mapInArrow(_leaks(index, least_score, least), f"id {kind}, item bigint, coverage double, question double, answer double")
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", key)
