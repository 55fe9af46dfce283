"""Problem 8: the reading level of each document.

For every language and level a unigram model is trained on graded texts. Its terms are
all words of the language's samples, and sentence ends, told apart by how long the
sentence was. A word's probability is its relative frequency at the level, smoothed
towards that of its class at the level times its share of the class in the language;
a frequent word is a class of its own, others are classed by length, and what a class
holds of words not seen is estimated from those of one text only. The samples of a
level fall into a plain and a long-winded kind (few rare words in long sentences, or
the reverse), so a level may be a mixture of two models, divided at the widest gap in
sentence length. A document gets the level with the highest posterior likelihood.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.leakage import MARKUP
from loomtext.llm.lookalike import table_form

#: Labelled texts used for training, at most; beyond, those least by hash.
MAX_SAMPLES = 20_000
MIN_WORDS = 60
#: A word is a class of its own if at least this share of the language's samples have it.
FREQUENT = 0.5
#: Weight, in words, of the class's estimate against the word's own count at a level.
SMOOTHING = 10_000.0
ALPHA = 0.5
LENGTH_STEP, LENGTH_TOP = 2, 10
SENTENCE_STEP, SENTENCE_TOP = 3, 12
#: Two kinds of samples differ by at least this in the logarithm of sentence length.
GAP = 0.2
_NOT_WORD = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_END = re.compile(r".*[.!?…।॥|۔。]+[”“\"»)’\]]*\Z", re.DOTALL)
_SCRIPT = {"Latin": regex.compile(r"\p{Latin}"), "Gujarati": regex.compile(r"\p{Gujarati}"), "Devanagari": regex.compile(r"\p{Devanagari}"), "other": regex.compile(r"\p{L}")}
_STOP = "\u2029"


def running_text(text: str) -> str:
    """The text without markup and without menu lines: lines of at most five words
    that end no sentence, unless they hold half of the words or more, as in verse and
    lists. Blank lines end a sentence."""
    text = re.sub(MARKUP, " ", text)
    if "\n" not in text and "\r" not in text:
        return text
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    kept = [x for x in lines if not x.strip() or len(x.split(None, 6)) > 5 or _END.match(x.rstrip())]
    if 2 * sum(len(x.split()) for x in kept) <= len(text.split()):
        kept = lines
    return "\n".join(x if x.strip() else f" {_STOP} " for x in kept)


class Chunks:
    """All running texts as chunks between blanks, described once per distinct chunk."""

    def __init__(self, texts: list[str]) -> None:
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        # a paragraph separator is white space too, so it is put back as a chunk
        coded = pc.list_flatten(split).dictionary_encode()
        self.row = np.asarray(pc.list_parent_indices(split)).astype(np.int64)
        self.codes = np.asarray(coded.indices).astype(np.int64)
        chunks = coded.dictionary.to_pylist()
        self.words = [_NOT_WORD.sub("", table_form(c)).lower() for c in chunks]
        self.ends = np.fromiter((bool(_END.match(c)) for c in chunks), bool, len(chunks))
        self.there = np.fromiter(map(bool, self.words), bool, len(chunks))
        names = list(_SCRIPT)
        self.script = np.fromiter((next((i for i, k in enumerate(names) if _SCRIPT[k].search(w)), -1) for w in self.words), np.int64, len(chunks))
        size = np.fromiter(map(len, self.words), np.int64, len(chunks))
        self.length = np.minimum(LENGTH_TOP, size // LENGTH_STEP)
        self.count = len(texts)

    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, length class) of every sentence with words."""
        there = self.there[self.codes]
        last = np.r_[self.row[1:] != self.row[:-1], True] if len(self.row) else np.zeros(0, bool)
        stops = np.flatnonzero(self.ends[self.codes] | last)
        upto = np.r_[0, np.cumsum(there)]
        n = upto[stops + 1] - upto[np.r_[0, stops[:-1] + 1]] if len(stops) else np.zeros(0, np.int64)
        return self.row[stops][n > 0], np.minimum(SENTENCE_TOP, n[n > 0] // SENTENCE_STEP)


def _prepare(texts: list[str | None]) -> list[str]:
    return [running_text(t).replace(_STOP, " ¦. ") if t else "" for t in texts]


class Language:
    """The words of a language with their classes, and the models of its levels."""

    def __init__(self, rows: list[tuple[str, int]], smoothing: float) -> None:
        ch = Chunks(_prepare([t for t, _ in rows]))
        there = ch.there[ch.codes]
        row, code = ch.row[there], ch.codes[there]
        script = ch.script[code]
        self.script = int(np.bincount(script[script >= 0], minlength=4).argmax()) if (script >= 0).any() else 3
        known = sorted({ch.words[c] for c in np.unique(code)})
        # terms: unknown words by length, then the known ones
        first = LENGTH_TOP + 1
        self.term = {w: first + i for i, w in enumerate(known)}
        terms = self.terms(ch)[code]
        size = first + len(known)
        texts = np.bincount(np.unique(row * size + terms) % size, minlength=size)
        self.frequent = texts >= max(1.0, FREQUENT * len(rows))
        kind = np.r_[np.arange(first), [min(LENGTH_TOP, len(w) // LENGTH_STEP) for w in known]].astype(np.int64)
        kind[self.frequent] = first + np.arange(int(self.frequent.sum()))
        kinds = first + int(self.frequent.sum())
        total = np.bincount(terms, minlength=size).astype(float)
        total[:first] = np.bincount(kind[texts == 1], minlength=kinds)[:first] + 1.0
        share = total / np.bincount(kind, total, kinds)[kind]

        s_row, s_class = ch.sentences()
        mean = np.bincount(row, minlength=len(rows)) / np.maximum(1, np.bincount(s_row, minlength=len(rows)))
        parts = [(level, part) for level in sorted({k for _, k in rows}) for part in self._parted([i for i, (_, k) in enumerate(rows) if k == level], mean)]
        self.levels = np.array([level for level, _ in parts])
        self.prior = np.log(np.array([len(part) for _, part in parts]) / len(rows))
        words, ends = [], []
        for _, part in parts:
            count = np.bincount(terms[np.isin(row, part)], minlength=size).astype(float)
            of_kind = np.bincount(kind, count, kinds) + ALPHA
            words.append(np.log((count + smoothing * of_kind[kind] / of_kind.sum() * share) / (count.sum() + smoothing)))
            stops = np.bincount(s_class[np.isin(s_row, part)], minlength=SENTENCE_TOP + 1) + ALPHA
            ends.append(np.log(stops / stops.sum()))
        self.words, self.ends = np.array(words), np.array(ends)

    @staticmethod
    def _parted(own: list[int], mean: np.ndarray) -> list[list[int]]:
        own = sorted(own, key=lambda i: (mean[i], i))
        gaps = [(math.log(max(mean[own[i + 1]], 1e-9) / max(mean[own[i]], 1e-9)), i + 1) for i in range(1, len(own) - 2)]
        wide, at = max(gaps, default=(0.0, 0))
        return [own[:at], own[at:]] if wide >= GAP else [own]

    def terms(self, ch: Chunks) -> np.ndarray:
        return np.fromiter((self.term.get(w, n) for w, n in zip(ch.words, ch.length.tolist(), strict=True)), np.int64, len(ch.words))

    def posteriors(self, row: np.ndarray, terms: np.ndarray, s_row: np.ndarray, s_class: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The levels, and the log posterior of each for every text, up to a constant;
        those of a level's models are summed."""
        score = np.stack([p + np.bincount(row, w[terms], count) + np.bincount(s_row, e[s_class], count) for p, w, e in zip(self.prior, self.words, self.ends, strict=True)])
        tops = np.unique(self.levels)
        return tops, np.stack([np.logaddexp.reduce(score[self.levels == x], axis=0) for x in tops])


class Models:
    """The models of all languages and levels."""

    def __init__(self, samples: list[tuple[str, str, int]], smoothing: float = SMOOTHING) -> None:
        by_lang = defaultdict(list)
        for text, lang, level in samples:
            by_lang[lang].append((text, level))
        self.by = {lang: Language(rows, smoothing) for lang, rows in sorted(by_lang.items())}
        self.langs = list(self.by)

    def assign(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None], np.ndarray]:
        """(level, language, log odds to the next level) of each text; level 0 where
        the language has no samples."""
        ch = Chunks(_prepare(texts))
        level, name, odds = np.zeros(ch.count, np.int64), np.full(ch.count, -1), np.zeros(ch.count)
        if not len(ch.codes) or not self.langs:
            return level, [None] * ch.count, odds
        script = ch.script[ch.codes]
        by_script = np.stack([np.bincount(ch.row[script == i], minlength=ch.count) for i in range(len(_SCRIPT))])
        total, main = by_script.sum(0), by_script.argmax(0)
        terms = [self.by[k].terms(ch) for k in self.langs]
        votes = np.stack([np.bincount(ch.row, self.by[k].frequent[t][ch.codes], ch.count) for k, t in zip(self.langs, terms, strict=True)])
        for i, k in enumerate(self.langs):
            votes[i][(main != self.by[k].script) | (total == 0)] = -1
        best, vote = votes.argmax(0), votes.max(0)
        # a language's frequent words make up a tenth of its texts at the very least
        name = np.where((vote >= 0) & (vote >= 0.1 * total), best, -1)
        s_row, s_class = ch.sentences()
        for i, k in enumerate(self.langs):
            own = name == i
            if not own.any():
                continue
            use, s_use = own[ch.row] & ch.there[ch.codes], own[s_row]
            tops, per = self.by[k].posteriors(ch.row[use], terms[i][ch.codes[use]], s_row[s_use], s_class[s_use], ch.count)
            level[own] = tops[per.argmax(0)][own]
            ranked = np.sort(per, axis=0)
            odds[own] = (ranked[-1] - ranked[-2])[own] if len(tops) > 1 else 0.0
        return level, [self.langs[i] if i >= 0 else None for i in name.tolist()], odds


def _assign(models, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string()).to_pylist()
            long = np.fromiter((t is not None and len(t.split(None, min_words)) >= min_words for t in texts), bool, len(texts))
            at = np.flatnonzero(long)
            if not len(at):
                continue
            level, lang, odds = models.value.assign([texts[i] for i in at])
            ok = level > 0
            yield pa.record_batch({"id": batch.column(0).take(pa.array(at[ok])), "lang": pa.array([x for x, y in zip(lang, ok, strict=True) if y], pa.string()), "level": pa.array(level[ok], pa.int32()), "odds": pa.array(odds[ok])})

    return run


def train(samples: DataFrame, text: str, lang: str, level: str, *, max_samples: int = MAX_SAMPLES) -> Models:
    """Models from labelled rows (text, language, level from 1); rows with a null
    are passed over. At most `max_samples` rows are used, least by hash."""
    rows = samples.select(F.col(text).alias("t"), F.col(lang).alias("g"), F.col(level).cast("int").alias("l")).filter("t is not null and g is not null and l > 0")
    rows = rows.orderBy(F.xxhash64("t", "g", "l"), "t", "g", "l").limit(max_samples)
    return Models([(r["t"], r["g"], r["l"]) for r in rows.collect()])


def reading_levels(df: DataFrame, key: str, text: str, models: Models, *, min_words: int = MIN_WORDS) -> DataFrame:
    """`key`, `lang` (of the models), `level` and `odds` (log odds to the next best
    level) of each row whose text has at least `min_words` words between blanks and
    is in a language of the models, told by script and frequent words.

    Null, empty and short texts, and other languages, give no row. Ties go to the
    lower level. Repeated rows are each assigned; other columns are not read. There
    is no shuffle; the models are of bounded size and broadcast.
    """
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(models)
    return df.select(key, text).mapInArrow(_assign(held, min_words), f"id {kind}, lang string, level int, odds double").withColumnRenamed("id", key)
