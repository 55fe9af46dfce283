"""Problem 5: one consistent form for text that looks the same.

The tokens of a table form a vocabulary, laid out in tries. Every spelling that is
not plain is run through them by a weighted edit automaton: swapping look-alike
characters and skipping ignorable ones costs nothing, other edits cost more than the
budget unless one is given. The spellings it meets are one class, and the vocabulary
decides which of them is canonical: the plain one, else a clean one of a single
script, the more frequent first (so a Cyrillic word stays Cyrillic where nothing says
otherwise). A class without such a spelling is normalised by table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.arrow import tokens_of
from loomtext.functions.lineage import cut

#: Letters of other scripts that are drawn as Latin ones.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀавеѕіјкмнопрсѵхуԁһԛԝүӏ", "ABESIJKMHOPCTYXYGQWlaвesijкмнoпpcvxydhqwyl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυϲϳ", "ABEZHIKMNOPTYXavopucj"),
    "Armenian": ("ՕՏհոսց", "OShnug"),
    "Latin": ("ıɑɡ", "iag"),
}
#: Letters and vowel signs drawn like a sequence of others.
SEQUENCES = {
    "आ": "अा", "ॉ": "ाॅ", "ो": "ाे", "ौ": "ाै", "ॲ": "अॅ", "ऑ": "अाॅ", "ओ": "अाे", "औ": "अाै", "ऍ": "एॅ", "ऐ": "एे",
    "આ": "અા", "ૉ": "ાૅ", "ો": "ાે", "ૌ": "ાૈ", "ઍ": "અૅ", "એ": "અે", "ઐ": "અૈ", "ઑ": "અાૅ", "ઓ": "અાે", "ઔ": "અાૈ",
    "আ": "অা", "ଆ": "ଅା", "ਆ": "ਅਾ", "ਐ": "ਅੈ", "ਔ": "ਅੌ", "ਇ": "ੲਿ", "ਈ": "ੲੀ", "ਏ": "ੲੇ", "ਉ": "ੳੁ", "ਊ": "ੳੂ",
    "แ": "เเ", "ແ": "ເເ",
}
#: Characters that are not drawn: soft hyphen, joiners, direction and variation marks.
IGNORABLE = frozenset(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]))
#: Kinds of compatibility decomposition that do not change what is read.
SAME_READING = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Prices of edits that can be seen; look-alikes and ignorables are free.
EDIT, ACCENT = 1.0, 0.5
_LETTER = {a: b for odd, plain in LOOKALIKES.values() for a, b in zip(odd, plain, strict=True) if a != b}
_JOINED = regex.compile("|".join(sorted(SEQUENCES.values(), key=len, reverse=True)))
_JOIN = {b: a for a, b in SEQUENCES.items()}


@lru_cache(maxsize=1 << 16)
def plain_char(c: str) -> str:
    """What a single character is read as; empty for one that is not drawn."""
    if c in IGNORABLE:
        return ""
    if c in SEQUENCES:
        return SEQUENCES[c]
    if c in _LETTER:
        return _LETTER[c]
    kind, _, points = unicodedata.decomposition(c).partition(" ")
    if kind in SAME_READING:
        parts = [chr(int(p, 16)) for p in points.split()]
        if len(parts) == 1 or parts[0] != " ":
            return "".join(map(plain_char, parts))
    if unicodedata.category(c) == "Zs":
        return " "
    return c


def reading(text: str) -> str:
    """What the whole text is read as, decomposed; blanks at the ends can't be seen."""
    if text.isascii():
        return text.strip(" ")
    return unicodedata.normalize("NFD", "".join(map(plain_char, unicodedata.normalize("NFD", text)))).strip(" ")


def _composed(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    return _JOINED.sub(lambda m: _JOIN[m[0]], text) if max(text, default="") > "\u0900" else text


def table_form(text: str) -> str:
    """The normal form by table: the key by which texts are compared."""
    return text.strip(" ") if text.isascii() else _composed(reading(text))


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    """Script of a letter that has look-alikes in others; else empty."""
    name = unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""
    return name if name in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN") else ""


@lru_cache(maxsize=1 << 16)
def _drawn(c: str) -> str:
    """plain_char() without the letters of other scripts."""
    if c in _LETTER and _script(c) != "LATIN":
        return c
    return plain_char(c)


def clean_form(text: str) -> str:
    """The text without characters that are not drawn, forms of width and composition;
    its letters keep their script if they are of one, and are read as by the table if
    they are of several."""
    if text.isascii():
        return text.strip(" ")
    kept = _composed(unicodedata.normalize("NFD", "".join(map(_drawn, unicodedata.normalize("NFD", text)))).strip(" "))
    return kept if len({_script(c) for c in kept} - {""}) < 2 else table_form(text)


class Trie:
    """Spellings by decomposed character; a node is a dict, its spellings at ''."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, spelling: str) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", spelling):
            node = node.setdefault(c, {})
        node.setdefault("", []).append(spelling)

    def near(self, text: str, budget: float = 0.0) -> dict[str, float]:
        """All spellings that cost at most `budget` from `text`, with their costs. A
        state is how much of the reading of `text` is done, a node, and what was paid.
        An edge is free if its character reads as the next ones do or as nothing."""
        want = reading(text)
        found: dict[str, float] = {}
        least: dict[tuple[int, int], float] = {}
        states = [(0, self.root, 0.0)]
        while states:
            at, node, paid = states.pop()
            if budget and least.get((at, id(node)), budget + 1) <= paid:
                continue
            least[at, id(node)] = paid
            left = budget - paid
            if left and at < len(want):
                price = ACCENT if unicodedata.combining(want[at]) else EDIT
                if price <= left:
                    states.append((at + 1, node, paid + price))
            for c, nxt in node.items():
                if not c:
                    if at == len(want):
                        found.update((s, min(paid, found.get(s, paid))) for s in nxt)
                    continue
                reads = plain_char(c)
                if want.startswith(reads, at):
                    states.append((at + len(reads), nxt, paid))
                elif reads == " " and at in (0, len(want)):
                    states.append((at, nxt, paid))
                if left and reads:
                    price = ACCENT if unicodedata.combining(c) else EDIT
                    if price <= left:
                        states.append((at, nxt, paid + price))
                    if EDIT <= left and at < len(want):
                        states.append((at + 1, nxt, paid + EDIT))
        return found

    def same_looking(self, text: str) -> list[str]:
        """All spellings at distance 0 from `text`."""
        return list(self.near(text))


def chosen(spellings: dict[str, int]) -> str:
    """The canonical spelling of a class of same-looking ones, given how often each
    occurs: a plain one (there is at most one); else a clean one, the most frequent
    first; else the clean form of the most frequent."""
    plain = [s for s in spellings if table_form(s) == s]
    if plain:
        return plain[0]
    clean = [s for s in spellings if clean_form(s) == s]
    best = min(clean or spellings, key=lambda s: (-spellings[s], s))
    return clean_form(best)


def token_hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def placed_keys(hashes: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each token at its place. Those of all tokens of a text,
    joined by exclusive or, are its keys; a token is changed by joining out the old
    values and joining in the new ones."""
    with np.errstate(over="ignore"):
        pos = pos.astype(np.uint64)
        return mix(hashes + (pos + np.uint64(1)) * _P), mix((hashes ^ _P) * np.uint64(3) + mix(pos + np.uint64(7)))


def sequence_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each run of token hashes; `starts` of non-empty runs."""
    sizes = np.diff(np.r_[starts, len(hashes)])
    a, b = placed_keys(hashes, np.arange(len(hashes)) - np.repeat(starts, sizes))
    return np.bitwise_xor.reduceat(a, starts).view(np.int64), np.bitwise_xor.reduceat(b, starts).view(np.int64)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each block, how often they occur, and their shelf: spellings with the
    same beginning, end and length of what is read stand in the same tries."""
    for batch in batches:
        words, _ = tokens_of(batch.column(0))
        if len(words):
            counted = words.cast(pa.string()).value_counts()
            unique = counted.field("values")
            read = [reading(w) for w in unique.to_pylist()]
            shelf = token_hash([f"{r[:3]}\0{r[-3:]}\0{len(r)}" for r in read]).view(np.int64)
            yield pa.record_batch({"token": unique, "n": counted.field("counts"), "shelf": pa.array(shelf)})


def _canonical(chunk_chars: int):
    def settle(count: dict[str, int]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for t in count:
            trie.add(t)
        out: dict[str, tuple[str, int]] = {}
        for t in count:
            if t in out or table_form(t) == t:
                continue
            same = {s: count[s] for s in trie.near(t)} or {t: count[t]}
            form = chosen(same)
            # a clean spelling that is canonical is remembered too, so that its class is settled once
            out.update((s, (form, n)) for s, n in same.items())
        moved = [(s, form, n) for s, (form, n) in out.items() if s != form]
        if moved:
            a, b, n = map(list, zip(*moved, strict=True))
            yield pa.record_batch({"token": pa.array(a), "canonical": pa.array(b), "n": pa.array(n, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, last = {}, 0, None
        for batch in batches:
            for token, n, shelf in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if chars >= chunk_chars and shelf != last:
                    yield from settle(held)
                    held, chars = {}, 0
                held[token] = n
                chars, last = chars + len(token), shelf
        if held:
            yield from settle(held)

    return run


def canonical_spellings(df: DataFrame, sentences: str = "sentences", *, chunk_chars: int = 1_000_000) -> DataFrame:
    """The canonical spelling of every token of the column `sentences`
    (array<array<string>>) that is not canonical itself: `token`, `canonical`, and `n`,
    how often the token occurs.

    Two tokens that read the same get the same canonical spelling. Spellings are spread
    by beginning, end and length of what they read as; a task builds a trie for every
    `chunk_chars` characters or more. Null rows, lists and tokens give nothing; an empty
    token is canonical; an empty table gives no rows; other columns are not read.
    """
    vocabulary = df.select(sentences).mapInArrow(_vocabulary, "token string, n bigint, shelf bigint").groupBy("token", "shelf").agg(F.sum("n").alias("n")).select("token", "n", "shelf")
    return vocabulary.repartition("shelf").sortWithinPartitions("shelf", "token").mapInArrow(_canonical(chunk_chars), "token string, canonical string, n bigint")


def _keyed(frequent):
    """(id, tokens) to (id, two keys of the tokens as stored, two with the frequent
    spellings made canonical, and the other unusual tokens with their places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            words, row = tokens_of(batch.column(1))
            if not len(words):
                continue
            coded = words.cast(pa.string()).dictionary_encode()
            vocabulary = coded.dictionary.to_pylist()
            codes = np.asarray(coded.indices).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            settled = [known.get(w, w) for w in vocabulary]
            odd = np.fromiter((w not in known and table_form(w) != w for w in vocabulary), bool, len(vocabulary))
            k1, k2 = sequence_keys(token_hash(vocabulary)[codes], starts)
            l1, l2 = sequence_keys(token_hash(settled)[codes], starts)
            at = np.flatnonzero(odd[codes])
            pos = at - starts[np.searchsorted(starts, at, "right") - 1]
            upto = np.searchsorted(at, np.r_[starts, len(row)])
            rest = pa.StructArray.from_arrays([pa.array(pos, pa.int64()), coded.dictionary.take(pa.array(codes[at]))], ["pos", "token"])
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rest)
            yield pa.record_batch({"id": batch.column(0).take(pa.array(row[starts])), "k1": pa.array(k1), "k2": pa.array(k2), "l1": pa.array(l1), "l2": pa.array(l2), "odd": lists})

    return run


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, keys, pos, token, canonical) to (id, keys, what the change joins to two of them)."""
    for batch in batches:
        pos = np.asarray(batch.column("pos"))
        old, new = (placed_keys(token_hash(batch.column(c).to_pylist()), pos) for c in ("token", "canonical"))
        ids = {c: batch.column(c) for c in ("id", "k1", "k2", "l1", "l2")}
        yield pa.record_batch(ids | {f"d{i + 1}": pa.array((old[i] ^ new[i]).view(np.int64)) for i in (0, 1)})


def looks(df: DataFrame, key: str, sentences: str = "sentences", *, frequent: int = 10_000) -> DataFrame:
    """`key`, two keys of the tokens as stored (`raw1`, `raw2`) and two of their
    canonical spellings (`look1`, `look2`), for each row with at least one token.

    The `frequent` most frequent spellings that are not canonical are known to every
    task (so that none of them is a hot key); what other unusual tokens there are is
    joined with the table of spellings, and the keys are corrected by the change. A
    plain token is canonical and never looked up. Nothing that grows is broadcast.
    """
    spelling = cut(canonical_spellings(df, sentences))
    top = spelling.orderBy(F.desc("n"), "token").limit(frequent).collect()
    known = df.sparkSession.sparkContext.broadcast({r["token"]: r["canonical"] for r in top})
    kind = df.schema[key].dataType.simpleString()
    keys = "k1 bigint, k2 bigint, l1 bigint, l2 bigint"
    rows = cut(df.select(key, sentences).mapInArrow(_keyed(known), f"id {kind}, {keys}, odd array<struct<pos:bigint,token:string>>"))
    if len(top) < frequent:  # all spellings are known already
        return rows.select(F.col("id").alias(key), F.col("k1").alias("raw1"), F.col("k2").alias("raw2"), F.col("l1").alias("look1"), F.col("l2").alias("look2"))
    odd = rows.filter(F.size("odd") > 0).select("id", "k1", "k2", "l1", "l2", F.inline("odd")).join(spelling.select("token", "canonical"), "token", "left")
    odd = odd.select("id", "k1", "k2", "l1", "l2", "pos", "token", F.coalesce("canonical", "token").alias("canonical"))
    odd = odd.mapInArrow(_changed, f"id {kind}, {keys}, d1 bigint, d2 bigint").groupBy("id", "k1", "k2", "l1", "l2").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    odd = odd.select("id", "k1", "k2", F.col("l1").bitwiseXOR(F.col("d1")), F.col("l2").bitwiseXOR(F.col("d2")))
    return rows.filter(F.size("odd") == 0).select(F.col("id").alias(key), F.col("k1").alias("raw1"), F.col("k2").alias("raw2"), F.col("l1").alias("look1"), F.col("l2").alias("look2")).union(odd)


def same_looking(df: DataFrame, key: str, sentences: str = "sentences") -> DataFrame:
    """The rows that read the same as another one but are stored with a differing
    character: `key`, their class (`look1`, `look2`) and their spelling within it
    (`raw1`, `raw2`). One row for each row of `df`; pairs are not expanded."""
    seen = cut(looks(df, key, sentences))
    several = seen.groupBy("look1", "look2", "raw1", "raw2").agg(F.lit(1).alias("one")).groupBy("look1", "look2").agg(F.count("*").alias("ways")).filter("ways > 1")
    return seen.join(several.select("look1", "look2"), ["look1", "look2"], "left_semi")


def same_looking_pairs(df: DataFrame, key: str, sentences: str = "sentences") -> DataFrame:
    """The classes of same_looking() as pairs of keys (`id_a` < `id_b`): rows with equal
    characters, and rows of one key, are no pair. As many rows as there are pairs; a
    large class is better read from same_looking()."""
    held = cut(same_looking(df, key, sentences))
    a = held.select("look1", "look2", F.col(key).alias("id_a"), F.col("raw1").alias("a1"), F.col("raw2").alias("a2"))
    b = held.select("look1", "look2", F.col(key).alias("id_b"), F.col("raw1").alias("b1"), F.col("raw2").alias("b2"))
    return a.join(b, ["look1", "look2"]).filter("id_a < id_b and (a1 <> b1 or a2 <> b2)").select("id_a", "id_b").distinct()
