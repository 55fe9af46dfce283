"""Problem 4: same or nearly same records across splits.

Records are compared by normalised tokens (canonical characters, lower case). The
evaluation records are divided into shards by size. Each shard lays out an Aho-Corasick
automaton whose patterns are its records' keys: tokens, spelled in letters, so chosen
that any two records that share four fifths of the longer one's tokens, in whatever
order, share a key (the rarest fifth, and one, of either record; the second one of a
token in a record is an element of its own). Every training text is scanned, whole, by
the automaton of every shard. A match that is a key of the training text too is widened
to the interval of equal tokens around it, and the intervals are merged into a coverage
of the evaluation record. Neither the keys nor a bound on the tokens that differ, from
parities of token hashes, can lose a pair; an exact comparison decides.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.arrow import tokens_of
from loomtext.functions.lineage import cut, drop_cut
from loomtext.llm.lookalike import mix, sequence_keys, table_form, token_hash
from loomtext.llm.sentences import _ends as sentence_batches

#: Tokens of the evaluation records of one shard, and of the training texts a task
#: holds while the shards go by, about: some hundred megabytes each.
SHARD_TOKENS, HELD_TOKENS = 4_000_000, 2_000_000
#: Letters in which an element is spelled, and bits of each. Equal spellings of
#: different elements only bring pairs to the comparison.
LETTERS, BITS = 6, 6
#: Pairs of a match and a record that are looked at at once.
EXPANDED = 2_000_000
#: Longs of token parities kept of each record.
SIGNATURE = 4
#: Tokens that occur more often than this are ranked by how often; see _prefixes.
FREQUENT = 50


def _normalised(batch: pa.RecordBatch, column: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    words, row = tokens_of(batch.column(column))
    coded = words.cast(pa.string()).dictionary_encode()
    vocabulary = [table_form(w).lower() for w in coded.dictionary.to_pylist()]
    codes = np.asarray(coded.indices).astype(np.int64)
    drawn = np.fromiter(map(bool, vocabulary), bool, len(vocabulary))[codes] if len(codes) else np.zeros(0, bool)
    return vocabulary, codes[drawn], row[drawn]


def _hashed(min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocabulary, codes, row = _normalised(batch, 2)
            if not len(codes):
                continue
            keep = np.bincount(row, minlength=batch.num_rows)[row] >= min_tokens
            codes, row = codes[keep], row[keep]
            if not len(codes):
                continue
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            h = token_hash(vocabulary)[codes]
            s1, s2 = sequence_keys(h, starts)
            pick = pa.array(row[starts])
            yield pa.record_batch({"id": batch.column(0).take(pick), "held": batch.column(1).take(pick), "s1": pa.array(s1), "s2": pa.array(s2), "toks": pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(h.view(np.int64)))})

    return run


def _flat(toks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of list<int64> rows without empty ones, and where each row begins."""
    if isinstance(toks, pa.ChunkedArray):
        toks = toks.combine_chunks()
    size = np.asarray(pc.list_value_length(toks)).astype(np.int64)
    return np.asarray(toks.flatten()), np.cumsum(size) - size


class Elements:
    """What is compared of records: elements (a token with its how-manieth it is in the
    record), which of them are keys, and parities."""

    def __init__(self, h: np.ndarray, starts: np.ndarray, share: float, known: np.ndarray, often: np.ndarray) -> None:
        """`known`: frequent tokens, sorted, and how `often` they occur; others count as
        rare. Any order of elements that all records agree on is right; rare ones first
        makes few pairs meet."""
        self.n = np.diff(np.r_[starts, len(h)])
        self.starts = starts
        row = np.repeat(np.arange(len(starts)), self.n)
        order = np.lexsort((h, row))
        by, of = h[order], row[order]
        first = np.flatnonzero(np.r_[True, (by[1:] != by[:-1]) | (of[1:] != of[:-1])]) if len(by) else np.zeros(0, np.int64)
        nth = np.empty(len(h), np.int64)
        nth[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        with np.errstate(over="ignore"):
            self.element = mix(h.view(np.uint64) + mix(nth.astype(np.uint64) + np.uint64(1)))
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        freq = np.where(known[at] == h, often[at], 0) if len(known) else np.zeros(len(h), np.int64)
        order = np.lexsort((self.element, freq, row))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h)) - np.repeat(starts, self.n)
        self.key = rank < np.repeat(self.n - np.ceil(share * self.n - 1e-9).astype(np.int64) + 1, self.n)
        bits = np.zeros(len(starts) * 64 * SIGNATURE, np.uint8)
        np.bitwise_xor.at(bits, row * 64 * SIGNATURE + (self.element % np.uint64(64 * SIGNATURE)).astype(np.int64), 1)
        self.signature = np.packbits(bits.reshape(len(starts), -1), axis=1).view(np.uint64)

    def spelled(self) -> np.ndarray:
        """The letters of every element, as code points; first letters are of their own,
        so that no pattern matches across two elements."""
        shift = np.arange(LETTERS, dtype=np.uint64) * np.uint64(BITS)
        letters = ((self.element[:, None] >> shift) & np.uint64((1 << BITS) - 1)).astype(np.uint32)
        letters[:, 0] += 1 << BITS
        return letters + np.uint32(0x100)


class Shard:
    """Evaluation records with the automaton of their keys."""

    def __init__(self, ids: np.ndarray, toks: np.ndarray, starts: np.ndarray, share: float, known: np.ndarray, often: np.ndarray) -> None:
        self.ids, self.toks, self.starts = ids, toks, starts
        el = Elements(toks, starts, share, known, often)
        self.n, self.signature = el.n, el.signature
        at = np.flatnonzero(el.key)
        letters = np.ascontiguousarray(el.spelled()[at])
        words, pattern = np.unique(letters.view(np.dtype((np.void, letters.dtype.itemsize * LETTERS))).ravel(), return_inverse=True)
        order = np.argsort(pattern, kind="stable")
        self.record = (np.searchsorted(starts, at, "right") - 1)[order]
        self.place = (at - starts[np.searchsorted(starts, at, "right") - 1])[order]
        self.size = np.bincount(pattern, minlength=len(words))
        self.first = np.cumsum(self.size) - self.size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.automaton.add_word(w.tobytes().decode("utf-32-le"), i)
        self.automaton.make_automaton()

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(element of the text, pattern) of every match."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        return found[::2] // LETTERS, found[1::2]


def _sharded(share: float, known: np.ndarray, often: np.ndarray):
    """(shard, id, tokens), ordered by shard, to (shard, its Shard)."""

    def built(shard: int, ids: list, toks: list) -> pa.RecordBatch:
        flat, starts = _flat(pa.chunked_array(toks))
        made = Shard(np.concatenate(ids), flat, starts, share, known, often)
        return pa.record_batch({"shard": pa.array([shard], pa.int32()), "made": pa.array([pickle.dumps(made, pickle.HIGHEST_PROTOCOL)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, toks = None, [], []
        for batch in batches:
            shard = np.asarray(batch.column(0))
            for part in np.split(np.arange(len(shard)), np.flatnonzero(shard[1:] != shard[:-1]) + 1):
                if not len(part):
                    continue
                if shard[part[0]] != last and ids:
                    yield built(int(last), ids, toks)
                    ids, toks = [], []
                last = shard[part[0]]
                ids.append(np.asarray(batch.column(1))[part])
                toks.append(batch.column(2).slice(int(part[0]), len(part)))
        if ids:
            yield built(int(last), ids, toks)

    return run


def _stored(path: str) -> Iterator[Shard]:
    """The shards of a table in the shared folder, one at a time."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    for f in sorted(fs.get_file_info(pyarrow.fs.FileSelector(at)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["made"]):
                    for made in batch.column(0):
                        yield pickle.loads(made.as_buffer())


def _readable(path: str) -> bool:
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (OSError, ValueError, ImportError, NotImplementedError):
        return path.startswith("/")
    return True


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sentences) to (id, token hashes, ends of the true sentences)."""
    for batch in batches:
        words, at = tokens_of(batch.column(1))
        coded = words.cast(pa.string()).dictionary_encode()
        vocabulary = [table_form(w).lower() for w in coded.dictionary.to_pylist()]
        codes = np.asarray(coded.indices).astype(np.int64)
        if not len(codes):
            continue
        drawn = np.fromiter(map(bool, vocabulary), bool, len(vocabulary))[codes]
        first, upto = np.searchsorted(at, np.arange(batch.num_rows)), np.r_[0, np.cumsum(drawn)]
        ends: dict[int, set] = defaultdict(set)
        for found in sentence_batches(iter([pa.record_batch({"id": pa.array(np.arange(batch.num_rows)), "sentences": batch.column(1)})])):
            for r, e in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
                ends[r].add(int(upto[first[r] + e] - upto[first[r]]))
        h, row = token_hash(vocabulary).view(np.int64)[codes[drawn]], at[drawn]
        if not len(row):
            continue
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        yield pa.record_batch({"id": batch.column(0).take(pa.array(row[starts])), "toks": pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(h)), "ends": pa.array([sorted(ends[r]) for r in row[starts].tolist()], pa.list_(pa.int64()))})


def in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = where.get(y, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _pieces(toks: list, ends: list[int]) -> list[list]:
    cuts = sorted({0, len(toks), *ends})
    return [toks[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _grown(row: np.ndarray, piece: list, same: dict) -> np.ndarray:
    """From the most tokens matched before each place of a text, those once `piece`
    follows; `same` holds where in the text each token stands."""
    for x in piece:
        hit = same.get(x)
        if hit is not None:
            row = np.maximum.accumulate(np.r_[row[0], np.maximum(row[1:], row[:-1] + hit)])
    return row


def _where(toks: list) -> dict:
    codes: dict = {}
    text = np.array([codes.setdefault(x, len(codes)) for x in toks], np.int64)
    return {x: (text == c).astype(np.int64) for x, c in codes.items()}


def _arranged(pieces: list[list], b: list, need: float) -> bool:
    """Whether `need` tokens match in order for some order of the pieces. Sets of
    pieces placed so far grow by one piece at a time; a place is given up once what
    is matched and the most the rest can match fall short. Few sets are followed
    first, and more until none is left out, so the answer is exact."""
    kinds = Counter(map(tuple, pieces))
    if sum(k * in_order(list(p), b) for p, k in kinds.items()) < need:
        return False
    same, back = _where(b), _where(b[::-1])
    names = list(kinds)
    m, zero = len(b), np.zeros(len(b) + 1, np.int64)
    tail = [_grown(zero, p[::-1], back)[::-1] for p in names]
    room, gone = m - np.arange(m + 1), np.int64(-(1 << 40))
    whole = tuple(kinds[p] for p in names)
    width = 4
    while True:
        states, cut_off = {(0,) * len(names): zero}, False
        while states:
            grown: dict = {}
            for used, row in states.items():
                for i, p in enumerate(names):
                    if used[i] < whole[i]:
                        to = (*used[:i], used[i] + 1, *used[i + 1 :])
                        new = _grown(row, p, same)
                        grown[to] = np.maximum(grown[to], new) if to in grown else new
            ranked = []
            for used, row in grown.items():
                if row.max() >= need:
                    return True
                most = row + np.minimum(sum((w - u) * t for w, u, t in zip(whole, used, tail, strict=True)), room)
                if most.max() >= need:
                    ranked.append((int(most.max()), int(row.max()), used, np.where(most >= need, row, gone)))
            ranked.sort(key=lambda x: x[:3], reverse=True)
            cut_off |= len(ranked) > width
            states = {used: row for _, _, used, row in ranked[:width]}
        if not cut_off:
            return False
        width *= 8


def _landed(pieces: list[list], a: list) -> set[int]:
    """Where in `a` the closest matches of the pieces begin and end."""
    same, back, zero = _where(a), _where(a[::-1]), np.zeros(len(a) + 1, np.int64)
    out = set()
    for p in pieces:
        row = _grown(zero, p, same)
        if row[-1]:
            end = int(np.searchsorted(row, row[-1]))
            tail = _grown(zero, p[::-1], back) if end == len(a) else _grown(np.zeros(end + 1, np.int64), p[::-1], {x: h[len(a) - end :] for x, h in back.items()})
            out |= {end, end - int(np.searchsorted(tail, tail[-1]))}
    return out


def alike(a: list, a_ends: list[int], b: list, b_ends: list[int], share: float) -> bool:
    """Whether `share` of the longer one's tokens recur in the other in order, or do
    so once whole sentences may change places: those of either one, or of one cut
    where the other's sentences begin and end too, as a copy may have lost a mark."""
    need = share * max(len(a), len(b)) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    if in_order(a, b) >= need:
        return True
    if (Counter(a) & Counter(b)).total() < need:
        return False
    for x, x_ends, y, y_ends in ((a, a_ends, b, b_ends), (b, b_ends, a, a_ends)):
        pieces, others = _pieces(x, x_ends), _pieces(y, y_ends)
        if len(pieces) > 1 and _arranged(pieces, y, need):
            return True
        if len(pieces) > 1 and len(others) > 1:
            finer = _pieces(x, sorted({*x_ends, *_landed(others, x)}))
            if len(finer) > len(pieces) and _arranged(finer, y, need):
                return True
    return False


def _widened(e: list, t: list, seeds: list[tuple[int, int]]) -> int:
    """Tokens of `e` within the intervals around the matches at which both go on alike."""
    covered, upto, seen = 0, 0, set()
    spans = []
    for i, j in seeds:
        if (i, j) in seen or e[i] != t[j]:
            continue
        a, b = 0, 1
        while i - a > 0 and j - a > 0 and e[i - a - 1] == t[j - a - 1]:
            a += 1
        while i + b < len(e) and j + b < len(t) and e[i + b] == t[j + b]:
            b += 1
        seen.update((i + k, j + k) for k in range(-a, b))
        spans.append((i - a, i + b))
    for a, b in sorted(spans):
        covered += max(0, b - max(a, upto))
        upto = max(upto, b)
    return covered


def _candidates(shard: Shard, texts: Elements, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(evaluation record, text, places of a match in both) of pairs within the bounds."""
    spelled = texts.spelled()
    width = max(1, EXPANDED // 8)
    for a in range(0, len(spelled), width):
        at, pattern = shard.matches(spelled[a : a + width].tobytes().decode("utf-32-le"))
        at += a
        own = texts.key[at]  # a match elsewhere implies one at a key, if the pair counts
        at, pattern = at[own], pattern[own]
        upto = np.cumsum(shard.size[pattern])
        for part in np.split(np.arange(len(at)), np.searchsorted(upto, np.arange(EXPANDED, upto[-1], EXPANDED)) if len(at) else []):
            size = shard.size[pattern[part]]
            r = np.repeat(shard.first[pattern[part]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            e, place = shard.record[r], shard.place[r]
            where = np.repeat(at[part], size)
            t = np.searchsorted(texts.starts, where, "right") - 1
            en, tn = shard.n[e], texts.n[t]
            need = np.ceil(np.maximum(en, tn) * share - 1e-9).astype(np.int64)
            ok = np.minimum(en, tn) >= need
            e, t, place, where, room = e[ok], t[ok], place[ok], where[ok], (en + tn - 2 * need)[ok]
            # each element in one of two records only flips a bit: no fewer differ than bits do
            ok = np.bitwise_count(shard.signature[e] ^ texts.signature[t]).sum(1) <= room
            yield e[ok], t[ok], place[ok], where[ok] - texts.starts[t[ok]]


def _scan(shards, share: float, known: np.ndarray, often: np.ndarray):
    """(id, tokens) of training texts to (e, t, coverage, sure): pairs that are alike in
    order are sure, of others that have enough tokens in common the sentences decide."""

    def compare(held: list[pa.RecordBatch], made: Iterable[Shard]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.asarray(b.column(0)) for b in held])
        toks, starts = _flat(pa.chunked_array([b.column(1) for b in held]))
        texts = Elements(toks, starts, share, known, often)
        for shard in made:
            seeds: dict[tuple[int, int], list] = defaultdict(list)
            for e, t, i, j in _candidates(shard, texts, share):
                for pair, place in zip(zip(e.tolist(), t.tolist(), strict=True), zip(i.tolist(), j.tolist(), strict=True), strict=True):
                    seeds[pair].append(place)
            out, last, right, common = [], -1, [], Counter()
            for (e, t), places in sorted(seeds.items(), key=lambda x: (x[0][1], x[0][0])):
                left = shard.toks[shard.starts[e] : shard.starts[e] + shard.n[e]].tolist()
                if t != last:
                    last, right = t, toks[starts[t] : starts[t] + texts.n[t]].tolist()
                    common = Counter(right)
                need = share * max(len(left), len(right)) - 1e-9
                if (Counter(left) & common).total() >= need:
                    out.append((shard.ids[e], ids[t], _widened(left, right, places) / len(left), in_order(left, right) >= need))
            if out:
                e, t, c, s = map(list, zip(*out, strict=True))
                yield pa.record_batch({"e": pa.array(e, pa.int64()), "t": pa.array(t, pa.int64()), "coverage": pa.array(c, pa.float64()), "sure": pa.array(s, pa.bool_())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(1).flatten())
            if size >= HELD_TOKENS:
                yield from compare(held, shards())
                held, size = [], 0
        if held:
            yield from compare(held, shards())

    return run


def _settle(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["e"], r["t"], r["coverage"]) for r in batch.to_pylist() if alike(r["e_toks"], r["e_ends"], r["t_toks"], r["t_ends"], share)]
            if rows:
                e, t, c = map(list, zip(*rows, strict=True))
                yield pa.record_batch({"e": pa.array(e, pa.int64()), "t": pa.array(t, pa.int64()), "coverage": pa.array(c, pa.float64())})

    return run


def classes_of_copies(rows: DataFrame) -> DataFrame:
    """(id, s1, s2, held, rep): the least record on the same side with the same tokens."""
    same = ["s1", "s2", "held"]
    return rows.select("id", *same).join(rows.groupBy(*same).agg(F.min("id").alias("rep")), same)


def overlapping_classes(df: DataFrame, key: str, held: Column, sentences: str = "sentences", *, share: float = 0.8, min_tokens: int = 8, broadcast_rows: int = 1_000_000, frequent_tokens: int = 50_000, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Pairs of an evaluation record (`held` true) and a training record (`held` false)
    of which `share` of the longer one's tokens recur in the other in order, whole
    sentences apart, as pairs (`e`, `t`, `coverage`: of the evaluation record by
    matched intervals, 1 for exact copies) of representatives, and the membership
    (`id`, `held`, `rep`) of all records: copies are compared once, by their least key.

    `key` is a BIGINT, unique and not null. Rows with null `held`, null or empty
    `sentences`, or fewer than `min_tokens` tokens count nowhere; null inner lists
    and tokens are passed over; an empty side gives no rows. The `frequent_tokens` most
    frequent tokens only set the order in which tokens become keys; the result depends
    neither on it nor on `shard_tokens`. Shards are built by tasks and read, one at a
    time, from the shared folder by the tasks that scan; where only Spark can read the
    folder, they are broadcast one after the other. Ids are broadcast up to
    `broadcast_rows`, counted; beyond, they are joined.
    """
    base = df.select(F.col(key).cast("bigint").alias("id"), held.alias("held"), F.col(sentences).alias("sentences")).filter("id is not null and held is not null")
    rows = cut(base.mapInArrow(_hashed(min_tokens), "id bigint, held boolean, s1 bigint, s2 bigint, toks array<bigint>"))
    classes = cut(classes_of_copies(rows))
    reps = classes.filter("id = rep")
    both = reps.groupBy("s1", "s2").agg(F.min(F.when(F.col("held"), F.col("rep"))).alias("e"), F.min(F.when(~F.col("held"), F.col("rep"))).alias("t")).filter("e is not null and t is not null").select("e", "t", F.lit(1.0).alias("coverage"))
    copies = cut(classes.filter("id <> rep").select("id"))

    def some(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(broadcast_rows + 1).count() <= broadcast_rows else ids

    one = cut(rows.join(some(copies), "id", "left_anti").select("id", "held", "toks"))
    drop_cut(rows)
    drop_cut(copies)
    often = one.select(F.explode("toks").alias("w")).groupBy("w").count().filter(F.col("count") > FREQUENT).orderBy(F.desc("count"), "w").limit(frequent_tokens).collect()
    table = np.array(sorted((r[0], r[1]) for r in often), np.int64).reshape(-1, 2)
    known = table[:, 0].copy(), table[:, 1].copy()

    tokens = one.filter("held").agg(F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()[0]
    count = max(1, -(-tokens // shard_tokens))
    passages = one.filter("held").select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("shard"), "id", "toks")
    shards = cut(passages.repartition(count, "shard").sortWithinPartitions("shard", "id").mapInArrow(_sharded(share, *known), "shard int, made binary"))
    texts, schema = one.filter("not held").select("id", "toks"), "e bigint, t bigint, coverage double, sure boolean"
    path = shards._cut_path
    if _readable(path):
        met = cut(texts.mapInArrow(_scan(lambda: _stored(path), share, *known), schema))
    else:
        met, context = None, df.sparkSession.sparkContext
        for k in range(count):
            made = shards.filter(F.col("shard") == k).first()
            sent = context.broadcast(bytes(made["made"]) if made else None)
            found = cut(texts.mapInArrow(_scan(lambda: [pickle.loads(sent.value)] if sent.value else [], share, *known), schema))
            sent.unpersist(blocking=True)
            met = found if met is None else met.union(found)
    met = met.join(both.select("e", "t"), ["e", "t"], "left_anti")
    drop_cut(shards)

    # where the order differs, the sentences decide
    open_ = cut(met.filter("not sure").select("e", "t", "coverage"))
    wanted = cut(open_.select(F.col("e").alias("id")).union(open_.select("t")).distinct())
    whole = cut(base.join(some(wanted), "id", "left_semi").select("id", "sentences").mapInArrow(_texts, "id bigint, toks array<bigint>, ends array<bigint>"))
    full = open_.join(whole.select(F.col("id").alias("t"), F.col("toks").alias("t_toks"), F.col("ends").alias("t_ends")), "t").join(whole.select(F.col("id").alias("e"), F.col("toks").alias("e_toks"), F.col("ends").alias("e_ends")), "e")
    settled = full.repartition("e", "t").mapInArrow(_settle(share), "e bigint, t bigint, coverage double")
    near = cut(met.filter("sure").select("e", "t", "coverage").union(settled).union(both))
    for x in (one, open_, wanted, whole):
        drop_cut(x)
    return near, classes.select("id", "held", "rep")


def overlapping(df: DataFrame, key: str, held: Column, sentences: str = "sentences", **settings) -> DataFrame:
    """overlapping_classes() with the pairs of all records listed: `held_id`,
    `train_id`, `coverage`. As many rows as there are pairs."""
    near, classes = overlapping_classes(df, key, held, sentences, **settings)
    left = classes.filter("held").select(F.col("rep").alias("e"), F.col("id").alias("held_id"))
    right = classes.filter("not held").select(F.col("rep").alias("t"), F.col("id").alias("train_id"))
    return near.join(left, "e").join(right, "t").select("held_id", "train_id", "coverage")
