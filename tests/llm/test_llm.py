import itertools
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import cross_split, group_split, leakage, lookalike, packing, reading_level, sentences, term_frequency

PARAS = "paragraph_id long, sentences array<array<string>>, n long, gram string, id string, look string, key string"


def paras(spark, rows):
    """Rows with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, s, 1, "g", "x", "l", "k") for i, s in rows], PARAS)


DIRTY = [(1, None), (2, []), (3, [[]]), (4, [["a", None, "b"], []]), (5, [["a", "b"], ["a"]]), (5, [["a", "b"], ["a"]]), (6, [["word"] * 3000])]


# 1 -------------------------------------------------------------------------------------------------
def brute_ngrams(rows, max_n):
    tf, df = Counter(), defaultdict(set)
    for k, (_, s) in enumerate(rows):
        t = [w for x in s or [] for w in x or [] if w is not None]
        for n in range(1, max_n + 1):
            for i in range(len(t) - n + 1):
                tf[tuple(t[i : i + n])] += 1
                df[tuple(t[i : i + n])].add(k)
    return {g: (c, len(df[g])) for g, c in tf.items()}


@pytest.mark.parametrize("block", [1, 10_000])
def test_ngrams_against_counting(spark, block):
    rng = random.Random(1)
    rows = [(i, [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 3))]) for i in range(60)] + DIRTY
    got = {tuple(r["gram"]): (r["tf"], r["df"]) for r in term_frequency.ngram_frequency(paras(spark, rows), max_n=3, block_tokens=block).collect()}
    total = got.pop(())
    assert got == brute_ngrams(rows, 3)
    assert total == (sum(c for g, (c, _) in got.items() if len(g) == 1), sum(1 for _, s in rows if any(w is not None for x in s or [] for w in x)))


@pytest.mark.parametrize("block", [1, 10_000])
def test_distinct_terms_of_groups(spark, block):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), rng.randint(0, 2), [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]]) for i in range(80)] + [(99, "none", 7, None), (98, "empty", 7, [[]]), (97, "null", 7, [[None, "a"], None])]
    df = spark.createDataFrame(rows, "id int, by string, tokens int, sentences array<array<string>>")
    want: dict = defaultdict(list)
    for _, b, t, s in rows:
        want[b, t] += [w for x in s or [] for w in x or [] if w is not None]
    got = {(r["by"], r["tokens"]): (r["unique_terms"], r["words"]) for r in term_frequency.distinct_terms(df, ["by", "tokens"], block_tokens=block).collect()}
    assert got == {k: (len(set(v)), len(v)) for k, v in want.items() if v}
    assert term_frequency.distinct_terms(df.limit(0), ["by"]).count() == 0


def test_marks(spark):
    rows = [(i, [["often", f"once{i}"] + (["some"] if i < 3 else [])]) for i in range(20)]
    m = {r["gram"][0]: r["mark"] for r in term_frequency.mark_terms(term_frequency.ngram_frequency(paras(spark, rows))).collect()}
    assert m["often"] == "common" and m["once3"] == "rare" and m["some"] is None
    assert term_frequency.mark_terms(term_frequency.ngram_frequency(paras(spark, []))).count() == 0


def test_suffix_array_order():
    codes, rec = np.array([2, 1, 2, 1, 2, 1]), np.array([0, 0, 0, 1, 1, 1])
    order = term_frequency.suffix_array(codes, rec, 4)
    suffix = lambda i: codes[i : 3 if i < 3 else 6].tolist()
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(6))


# 2 -------------------------------------------------------------------------------------------------
def test_groups_against_search(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, f"c{rng.randint(0, 60)}"]), rng.choice([None, f"t{rng.randint(0, 90)}"])) for i in range(120)]
    rows += [(500, "c1", None), (500, "c1", None), (501, None, None), (502, "t5", "c5"), (None, "c1", "t1")]
    df = spark.createDataFrame(rows, "pair_id long, correct string, typo string").withColumn("root", F.lit("x")).withColumn("word", F.lit(1))
    out, forest = group_split.related_groups(df, "pair_id", ["correct", "typo"])
    got = {r["pair_id"]: r["group_id"] for r in out.collect()}
    near, words = defaultdict(set), defaultdict(set)
    for i, c, t in rows:
        if i is not None:
            near[i].update(x for x in (("c", c), ("t", t)) if x[1])
            for w in near[i]:
                words[w].add(i)
    want, groups = {}, 0
    for i in sorted(near):
        if i not in want:
            groups += 1
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in want:
                    want[j] = i
                    todo += [k for w in near[j] for k in words[w]]
    assert got == want
    seen = {w for ws in near.values() for w in ws}
    with_words = len({want[i] for i in near if near[i]})
    assert forest.count() == len(seen) - with_words  # edges of a spanning forest


def test_word_key(spark):
    words = [" Ab_c ", "WORD*3", "ét", "x", None, "  ", "a * b", "*4"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(group_split.word_key("w")).collect()]
    assert got == ["ab c", "word", "ét", "x", None, None, "a * b", None]


def test_deal_keeps_shares_with_a_giant_group(spark):
    rng = random.Random(1)
    sizes = [3000] + [rng.choice([1, 1, 1, 2, 3, 8]) for _ in range(3000)]
    g = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "group_id long, group_size long")
    dealt = group_split.deal(g, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(dealt) == len(sizes) and len({r["group_id"] for r in dealt}) == len(sizes)
    per = Counter()
    for r in dealt:
        per[r["split"]] += r["group_size"]
    for k, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert per[k] / sum(sizes) == pytest.approx(share, abs=0.02)
    assert group_split.deal(g.limit(0), {"train": 1.0}).count() == 0
    none, _ = group_split.related_groups(spark.createDataFrame([], "pair_id long, a string"), "pair_id", ["a"])
    assert none.count() == 0


# 3 -------------------------------------------------------------------------------------------------
CASES = [
    "The thing sees e . g . cat vs . dog . | “ A house . ” wrote Bob . | ( One fox . ) | “ Fox ! ” | Her cat at 7 p . m . | One coat etc . | Gen . Bo saw No . 5 and 31 . 70 ... but fell … | The G . C . Duchal ran ?! | the dog sat .",
    "Der Hund mag am 3 . Oktober z . B . Haus . | „ Das Regen ! “ rief Som . | „ Ein Tag . “ | Der Weg bzw . Haus .",
    "Un jardin p . ex . cf . le sel . | « Sel ! » dit X . M . Bo . | « A . » | Le sel",
    "આ ૨૫ કિ . મી . સાથે એતુ । | “ ટાચાં છે . ” એમ ડાધ લીડ છે . | ડૉ . શા છે . | તા . 12 છે",
    'वह था । | " खी था । " ऐसा वह है । | " यह है । " | वह है ॥ | पं . नाम है .',
    "” ایک تھا ۔ “ یوں فڈ تھا ۔ | چی تھی ؟ | لرق",
    "ይህ ነው ። | « ያ ነው ። » ብሎ ረቤ ነበር ። | ያ ነው ፡፡ | ሩ ነበር ።",
    "「 一走 。 」 他說 。 | 「 這 。 」 | 那石 …… | 一",
    "「 ある空 。 」 と馬は言った 。 | その日 ！",
    "นี้ครับ | และนั้นโวงตา ถ้านี้ค่ะ | นั้น",
    "Heading without an end",
    "THE DOG SAT ... AND DR . BO RAN ... | THE CAT . | ( HER HAT . )",
    "Тhе dоg ѕat​ . | Ｔｈｅ end ．",
    "He works at Acme Inc . in Ohio . | Gov . Smith left on Jan . 5 . | She has a Ph . D . in maths .",
    "He joined Acme Inc . | She has a Ph . D . | They ate apples , etc . and left the house .",
    "the cat has milk etc . | her dog sat .",
    "Это т . е . хорошо . | Она живёт на ул . Мира , и т . д . | Он ушёл в 1999 г . и не вернулся .",
    "El Sr . García y la Sra . López viven en la casa . | Los Dres . Ruiz van con él .",
    "Il sig . Rossi è di Roma . | Non ha una casa .",
    "O Sr . Silva não está em casa . | As ruas são p . ex . largas .",
    "De heer is dhr . Jansen en hij woont op nr . 5 . | Dat is het .",
    "To jest ul . Długa , itd . | Nie ma tam prof . Nowaka .",
    "The U . S . Army is here . | It is on the hill .",
]


def test_sentence_rules_by_language(spark):
    rows, want = [], {}
    for i, c in enumerate(CASES):
        parts = [p.split() for p in c.split(" | ")]
        flat = [w for p in parts for w in p]
        cut = i % 3 + 2  # stored lists need not be sentences
        rows.append((i, [flat[k : k + cut] for k in range(0, len(flat), cut)]))
        want[i] = list(np.cumsum([len(p) for p in parts]))
    got = defaultdict(list)
    for r in sentences.sentence_ends(paras(spark, rows), "paragraph_id").collect():
        got[r["paragraph_id"]].append(r["end_token"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_sentences_of_dirty_rows(spark):
    got = Counter(r["paragraph_id"] for r in sentences.sentence_ends(paras(spark, DIRTY), "paragraph_id").collect())
    assert got == {4: 1, 5: 2, 6: 1}
    assert sentences.sentence_ends(paras(spark, []), "paragraph_id").count() == 0


# 4 -------------------------------------------------------------------------------------------------
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_in_order_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert cross_split.in_order(a, b) == lcs(a, b)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, [[rng.choice(words) for _ in range(rng.randint(6, 40))]], rng.choice(["train", "train", "dev", "test", None])) for i in range(120)]
    for k in range(120, 180):
        t = list(rows[rng.randrange(120)][1][0])
        for _ in range(rng.randint(0, max(1, len(t) // 10))):
            t[rng.randrange(len(t))] = rng.choice(words)
        if k % 5 == 0:
            t = [w.upper() + "​" for w in t]
        rows.append((k, [t], rng.choice(["train", "dev", "test"])))
    rows += [(900, None, "train"), (901, [], "dev"), (902, [["a"] * 7], "dev"), (903, [["a"] * 7], "train"), (904, [["z"] * 2500], "dev"), (905, [["z"] * 2500], "train"), (906, [["z"] * 2500], "train")]
    df = spark.createDataFrame(rows, "paragraph_id long, sentences array<array<string>>, split string").withColumn("keys", F.lit(1)).withColumn("n", F.lit(2))
    held = F.when(F.col("split").isin("dev", "test"), True).when(F.col("split") == "train", False)
    got = {(r["held_id"], r["train_id"]) for r in cross_split.overlapping(df, "paragraph_id", held).collect()}
    norm = lambda s: [w.lower().replace("​", "") for x in s or [] for w in x]
    want = set()
    for i, s, a in rows:
        for j, t, b in rows:
            x, y = norm(s), norm(t)
            if a in ("dev", "test") and b == "train" and min(len(x), len(y)) >= 8 and (x == y or max(len(x), len(y)) < 100 and lcs(x, y) >= 0.8 * max(len(x), len(y))):
                want.add((i, j))
    assert got == want and (904, 905) in got
    assert cross_split.overlapping(df.filter("split = 'train'"), "paragraph_id", held).count() == 0


def test_moved_sentences_count():
    a = "a b c d e f g h . i j k l m n o p .".split()
    b = "i j k l m n o p . a b c d e f g h .".split()
    ends = [9, 18]
    assert cross_split.alike(a, ends, b, ends, 0.8)
    assert not cross_split.alike(a, ends, sorted(b, reverse=True), [], 0.8)


def pairs_of(spark, rows):
    df = spark.createDataFrame([(i, [t], a) for i, t, a in rows], "paragraph_id long, sentences array<array<string>>, split string")
    return {(r["held_id"], r["train_id"]) for r in cross_split.overlapping(df, "paragraph_id", F.col("split") == "dev").collect()}


def test_no_candidate_is_lost_up_to_a_fifth(spark):
    """Copies without their longest tokens, and with a token taken out and another put in by turns, so that hardly a window is left."""
    rng, rows = random.Random(4), []
    for i in range(60):
        n = rng.randint(10, 60)
        a = [f"{i}x{k}" + "y" * rng.randint(0, 6) for k in range(n)]
        if i % 2:
            b, longest = list(a), sorted(range(n), key=lambda k: -len(a[k]))
            for k in longest[: n // 5]:
                b[k] = f"new{i}n{k}"
        else:
            b = list(a)
            for c in range(n // 5):
                b[5 * c] = f"in{i}n{c}"
                b[5 * c], b[5 * c + 2] = b[5 * c + 1], b[5 * c]
                b[5 * c + 1] = a[5 * c + 2]
        assert lcs(a, b) >= 0.8 * n - 1e-9
        rows += [(2 * i, a, "dev"), (2 * i + 1, b, "train")]
    assert pairs_of(spark, rows) == {(2 * i, 2 * i + 1) for i in range(60)}


def test_shards_and_their_delivery_change_nothing(spark, monkeypatch):
    """Many shards, hot tokens in all records, copies, and shards sent by broadcast."""
    rng, rows = random.Random(6), []
    for i in range(40):
        a = [rng.choice(["hot", "the", "of", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(10, 30))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            b[rng.randrange(len(b))] = "new"
        rows += [(3 * i, [a], "dev"), (3 * i + 1, [b], "train"), (3 * i + 2, [a], rng.choice(["dev", "train"]))]
    df = spark.createDataFrame(rows, "paragraph_id long, sentences array<array<string>>, split string")
    run = lambda **k: {(r["held_id"], r["train_id"], round(r["coverage"], 6)) for r in cross_split.overlapping(df, "paragraph_id", F.col("split") == "dev", **k).collect()}
    one = run()
    assert {(3 * i, 3 * i + 1) for i in range(40)} <= {x[:2] for x in one}
    toks = {i: s[0] for i, s, _ in rows}
    assert all(lcs(toks[e], toks[t]) >= 0.8 * max(len(toks[e]), len(toks[t])) for e, t, _ in one)
    assert run(shard_tokens=90) == one and {x[:2] for x in run(frequent_tokens=1)} == {x[:2] for x in one}
    monkeypatch.setattr(cross_split, "_readable", lambda path: False)
    assert run(shard_tokens=200) == one


def test_copies_are_classes(spark):
    rows = [(i, [["same", "words", "in", "all", "of", "these", "many", "records"]], "dev" if i < 20 else "train") for i in range(60)]
    df = spark.createDataFrame(rows, "paragraph_id long, sentences array<array<string>>, split string")
    near, classes = cross_split.overlapping_classes(df, "paragraph_id", F.col("split") == "dev")
    assert [(r["e"], r["t"], r["coverage"]) for r in near.collect()] == [(0, 20, 1.0)]
    assert {(r["id"], r["rep"]) for r in classes.collect()} == {(i, 0 if i < 20 else 20) for i in range(60)}


def test_moved_sentences_count_where_a_mark_is_lost():
    a = "a b c d e f . g h i j k l . m n o p q r".split()
    b = "m n o p q r a b c d e f . g h i j k l .".split()
    assert cross_split.alike(a, [7, 14, 20], b, [13, 20], 0.8) and cross_split.alike(b, [13, 20], a, [7, 14, 20], 0.8)
    lost, moved = [x for x in a if x != "."], "g h i j k l m n o p q r a b c d e f".split()
    assert cross_split.alike(a, [7, 14, 20], moved, [18], 0.8)
    assert cross_split.alike(lost, [12, 18], "m n o p q r a b c d e f g h i j k l".split(), [6, 18], 0.8)
    assert cross_split.alike("a b c d e f g h i j k l".split(), [8, 12], "e f g h i j k l a b c d".split(), [4, 8, 12], 0.8)
    assert not cross_split.alike(lost, [18], moved, [18], 0.8)


def test_sentences_of_any_order_against_trying_all():
    rng = random.Random(9)
    for _ in range(150):
        pieces = [[rng.choice("abcdef") for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(2, 5))]
        b = [rng.choice("abcdef") for _ in range(rng.randint(6, 14))]
        best = max(lcs(sum(o, []), b) for o in itertools.permutations(pieces))
        assert cross_split._arranged(pieces, b, best - 1e-9) and not cross_split._arranged(pieces, b, best + 1 - 1e-9)


def test_frequent_keys_lose_no_pair(spark):
    """All windows of both records recur on the other side, and most often the five that the pair has in common."""
    runs = [[f"c{r}t{k}" for k in range(3 if r % 2 else 2)] for r in range(10)]
    a, b = [], []
    for r, run in enumerate(runs):
        a += run + ([f"a{r}"] if r % 2 == 0 else [])
        b += run + ([f"b{r}"] if r % 2 == 1 else [])
    a, b = a + ["a10"], b + ["b10"]
    assert lcs(a, b) == 25 and len(a) == len(b) == 31
    some = lambda x, t: x + [f"{t}{k}" for k in range(31 - len(x))]
    rows = [(0, a, "dev"), (1, b, "train"), (2, some(a[:16], "u"), "train"), (3, some(a[14:], "v"), "train"), (4, some(b[:16], "w"), "dev"), (5, some(b[14:], "x"), "dev")]
    hot = [t for run in runs if len(run) == 3 for t in run]
    rows += [(10 + i, some(hot, f"h{i}n"), "dev" if i % 2 else "train") for i in range(8)]
    assert pairs_of(spark, rows) == {(0, 1)}


# 5 -------------------------------------------------------------------------------------------------
def test_table_form():
    assert lookalike.table_form("ｈｉｓ") == "his" and lookalike.table_form("рrevolutісаtes") == "prevoluticates"
    assert lookalike.table_form("b﻿ad​") == "bad" and lookalike.table_form("the\xa0") == "the"
    assert lookalike.table_form("reguliﬁer") == "regulifier" and lookalike.table_form("⽊車") == "木車"
    assert lookalike.table_form("é") == "é" != lookalike.table_form("e") and lookalike.table_form("Abc") == "Abc"
    assert lookalike.table_form("x²") == "x²" and lookalike.table_form("") == ""


def test_trie_meets_all_spellings():
    t = lookalike.Trie()
    for w in ("salt", "ѕalt", "sal​t", "Salt", "salts", "ｓａｌｔ", "sált"):
        t.add(w)
    assert sorted(t.same_looking("saltѕ"[:4] + "﻿")) == sorted(["salt", "ѕalt", "sal​t", "ｓａｌｔ"])
    assert t.same_looking("á") == [] and t.same_looking("sált") == ["sált"]


def test_weights_of_the_edit_automaton():
    t = lookalike.Trie()
    for s in ("résumé", "resume", "resumes"):
        t.add(s)
    assert t.near("r\u0435sume") == {"resume": 0.0}
    assert t.near("résume", 0.5) == {"résumé": 0.5, "resume": 0.5}
    assert t.near("resumе", 1.0) == {"resume": 0.0, "resumes": 1.0, "résumé": 1.0}


def test_vocabulary_decides_the_spelling(spark):
    """Cyrillic words stay Cyrillic unless a plain word reads the same; a mixed one
    follows what the vocabulary holds."""
    words = ["окно", "окнo", "хор", "хoр", "сор", "cop", "coр", "zеro", "МОСКВА", "અેમ", "એમ", "ok\u200b"]
    got = {r["token"]: r["canonical"] for r in lookalike.canonical_spellings(paras(spark, [(1, [words])])).collect()}
    assert got == {"окнo": "окно", "хoр": "хор", "сор": "cop", "coр": "cop", "zеro": "zero", "અેમ": "એમ", "ok\u200b": "ok"}
    assert got["окнo"] != lookalike.table_form("окнo")
    assert {lookalike.reading(a) == lookalike.reading(b) for a, b in got.items()} == {True}


def test_same_looking_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["salt water", "des été", "के ड़ का", "plain", "木 車"]
    twist = [lambda s: s, lambda s: s.replace("a", "а"), lambda s: s + "​", lambda s: unicodedata.normalize("NFD", s), lambda s: s.upper(), lambda s: s.replace("木", "⽊")]
    rows = [(i, [rng.choice(twist)(rng.choice(base)).split(" ")]) for i in range(80)] + DIRTY[:4]
    got = {(r["id_a"], r["id_b"]) for r in lookalike.same_looking_pairs(paras(spark, [(i + 1000, s) for i, s in rows]), "paragraph_id").collect()}
    flat = [(i + 1000, [w for x in s or [] for w in x if w is not None]) for i, s in rows]
    want = {(i, j) for i, s in flat for j, t in flat if i < j and s and t and s != t and list(map(lookalike.table_form, s)) == list(map(lookalike.table_form, t))}
    assert got == want and want
    assert lookalike.same_looking_pairs(paras(spark, []), "paragraph_id").count() == 0


def test_joined_spellings_equal_those_known_to_all_tasks(spark):
    rows = [(i, [["а" if i % 2 else "a", "b"]]) for i in range(6)]
    a = lookalike.looks(paras(spark, rows), "paragraph_id", frequent=0).select("look1", "look2").distinct().count()
    assert a == lookalike.looks(paras(spark, rows), "paragraph_id").select("look1", "look2").distinct().count() == 1


# 6 -------------------------------------------------------------------------------------------------
def optimum(items, capacity):
    best = [len(items)]

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i]:
                rec(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
        rec(i + 1, [*bins, capacity - items[i]])

    rec(0, [])
    return best[0]


def test_reduction_is_safe_and_packing_whole():
    rng = random.Random(3)
    for _ in range(400):
        c = rng.randint(5, 40)
        items = sorted((rng.randint(1 + rng.randint(0, c // 4), c) for _ in range(rng.randint(1, 7))), reverse=True)
        groups, fixed = packing.reduce_and_fit(Counter(items), c)
        flat = [g for g, n in groups for _ in range(n)]
        assert Counter(x for g in flat for x in g) == Counter(items) and all(sum(g) <= c for g in flat)
        rest = Counter(items) - Counter(x for g in flat[:fixed] for x in g)
        assert fixed + optimum(sorted(rest.elements(), reverse=True), c) == optimum(items, c)
    big = Counter(rng.randint(1, 1024) for _ in range(20_000))
    groups, _ = packing.reduce_and_fit(big, 1024)
    assert sum(s * n for s, n in big.items()) / 1024 / sum(n for _, n in groups) > 0.99
    assert packing.reduce_and_fit({}, 10) == ([], 0)


def test_places(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 7, 7, 7, 64, rng.randint(1, 300)])) for i in range(500)] + [(None, 5), (999, None), (1000, 64 * 40 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("bin", F.lit(1)).withColumn("size", F.lit(1))
    out = packing.pack(df, "doc_id", "tokens", {"a": 64, "b": 100, "none": 0}).collect()
    per = defaultdict(int)
    for kind, c in (("a", 64), ("b", 100)):
        mine = [r for r in out if r["container"] == kind]
        size = defaultdict(int)
        for r in mine:
            size[r["doc_id"]] += r["piece_tokens"]
            if r["bin"] is not None:
                per[kind, r["bin"]] += r["piece_tokens"]
        assert size == {i: t for i, t in rows if i is not None and t is not None}
        pieces = Counter(r["doc_id"] for r in mine)
        assert all(pieces[i] == max(1, -(-t // c)) for i, t in rows if i is not None and t is not None)
        assert all(n <= c for (k, _), n in per.items() if k == kind)
    assert packing.pack(df.limit(0), "doc_id", "tokens", {"a": 64}).count() == 0


def test_token_sizes_follow_the_tokeniser(spark):
    texts = ["one two", "", None, "ગુજરાતી લખાણ", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_sizes(df, "doc_id", "text").collect()}
    enc = packing._encoding(packing.RANKS, packing.PATTERN)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_triples_are_fixed_many_at_a_time():
    for n in (10, 1_000, 100_000):
        patterns, fixed = packing.reduce_and_fit({600: n, 260: n, 140: n}, 1000)
        assert patterns == [((600, 260, 140), n)] and fixed == n
    patterns, _ = packing.reduce_and_fit({s: 10_000 + s for s in range(1, 1001)}, 1000)
    assert len(patterns) < 4_000 and all(sum(g) <= 1000 for g, _ in patterns)
    held = Counter()
    for g, n in patterns:
        for s in g:
            held[s] += n
    assert held == {s: 10_000 + s for s in range(1, 1001)}


# 7 -------------------------------------------------------------------------------------------------
def test_leaks(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    vocab = [word() for _ in range(600)]
    item = {i: [rng.choice(vocab) for _ in range(40)] for i in range(30)}
    filler = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, want = [], set()

    def add(parts, *items):
        docs.append((len(docs), " ".join(w for p in parts for w in p)))
        want.update((len(docs) - 1, i) for i in items)

    for i in range(10):
        add([filler(50), item[i], filler(50)], i)
        add([filler(30), item[i][:22], filler(30)], i)
        add([filler(30), item[i][:12], filler(200), item[i][25:], filler(9)], i)
        changed = list(item[i])
        for k in (7, 15, 30):
            changed[k] = word()
        add([filler(30), [w.upper() + "," for w in changed], ["<br>"]], i)
        shuffled = list(item[i])
        rng.shuffle(shuffled)
        add([filler(30), shuffled])
        add([filler(30), item[i][:10], filler(30)])
        add([filler(400)])
    add([[w.replace("a", "а") for w in item[11]]], 11)
    docs += [(900, None), (901, ""), (902, "   "), (903, " ".join(filler(20_000)))]
    items = [(i, " ".join(w)) for i, w in item.items()] + [(100, " ".join(item[0])), (101, None), (102, ""), (None, "x y z"), (0, " ".join(item[0]))]
    want |= {(d, 100) for d, i in want if i == 0}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("coverage", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item"]) for r in leakage.leaked_items(d.select("doc_id", "text", F.lit(1).alias("extra")), "doc_id", "text", i, "item_id", "text").collect()}
    assert got == want
    assert leakage.leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_stretches_far_apart_are_chained():
    item = np.arange(1, 61)
    text = np.r_[item[:20], np.tile(np.r_[item[25:28], 0], 700), item[40:]]
    three = lambda x: x[:-2] * 10_000 + x[1:-1] * 100 + x[2:]
    got = leakage.covered(item, text, three(item), three(text))
    assert got == [k < 20 or 25 <= k < 28 or k >= 40 for k in range(60)]


def test_bounds_drop_nothing():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(12))) for i in range(60)]
    ix = leakage.Index(items)
    texts = pa.array([" ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(40)) for _ in range(50)])
    ids, passage = leakage.word_ids(texts, ix.known)
    got = set(zip(*(x.tolist() for x in ix.retrieve(ids, passage, 50, 0.2)), strict=True))
    want = set()
    for p in range(50):
        w = ids[passage == p]
        terms = set((w[:-1] * ix.base + w[1:]).tolist())
        score = Counter()
        for t, s, n in zip(ix.terms.tolist(), ix.start, ix.size, strict=True):
            if t in terms:
                for k in range(s, s + n):
                    score[int(ix.item[k])] += ix.weight[k]
        want |= {(p, i) for i, x in score.items() if x >= 0.2}
    assert got == want
    assert 0 < ix.read <= sum(int(n) for p in range(50) for n in ix.size[np.isin(ix.terms, (ids[passage == p][:-1] * ix.base + ids[passage == p][1:]))])


def test_index_of_many_items_reads_few_postings():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, range(300, 0, -1), k=30))) for i in range(3000)]
    ix = leakage.Index(items)
    texts = pa.array([" ".join(rng.choices(vocab, range(300, 0, -1), k=150)) + " " + items[i][1] for i in range(20)])
    ids, passage = leakage.word_ids(texts, ix.known)
    found = set(zip(*(x.tolist() for x in ix.retrieve(ids, passage, 20, 0.5)), strict=True))
    assert {(i, i) for i in range(20)} <= found
    pairs = [np.unique(ids[passage == p][:-1] * ix.base + ids[passage == p][1:]) for p in range(20)]
    assert ix.read < 0.2 * sum(int(ix.size[np.isin(ix.terms, t)].sum()) for t in pairs)


def test_words_without_blanks_are_found(spark):
    item = "the slow river carries seven little boats towards an empty harbour"
    glued = "before " + item.replace(" ", "") + " after"
    half = "x " + "".join(item.split()[:6]) + "zzzz and more"
    odd = "theslowzebraeatsunknownthingsbeforeanyonehaslookedatit"
    docs = spark.createDataFrame([(1, glued), (2, half), (3, odd), (4, "z" * 50_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the slow river carries seven", "little boats towards an empty harbour")], "item_id long, q string, a string")
    got = {r["doc_id"]: r for r in leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "q", "a").collect()}
    assert set(got) == {1, 2} and got[1]["coverage"] == 1 and got[2]["question"] == 1 and 0 < got[2]["answer"] < 0.5


# 8 -------------------------------------------------------------------------------------------------
def graded(rng, level):
    easy, hard = ["the", "dog", "cat", "is", "a", "of", "and", "sun"], ["internationalisation", "counterproductive", "misinterpretation"]
    return ". ".join(" ".join(rng.choice(hard) if rng.random() < 0.08 * level else rng.choice(easy) for _ in range(3 * level + rng.randint(0, 2))) for _ in range(120 // (3 * level) + 3)) + "."


def test_levels_are_told_apart(spark):
    rng = random.Random(1)
    samples = [(i, graded(rng, k), "en", k) for i, k in enumerate([1, 2, 3, 4, 5] * 12)] + [(900, None, "en", 1), (901, "x", None, 1), (902, "x", "en", None)]
    models = reading_level.train(spark.createDataFrame(samples, "i int, text string, lang string, level int"), "text", "lang", "level")
    docs = [(i, graded(rng, k)) for i, k in enumerate([1, 2, 3, 4, 5] * 8)] + [(100, None), (101, ""), (102, "the dog is short."), (103, "यह एक है " * 80), (104, "zzz qqq " * 60)]
    docs += [(200, docs[0][1] + "\n\nRead more >>\nHome | News | About\n"), (0, docs[0][1]), (300, docs[4][1] * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("level", F.lit("x")).withColumn("lang", F.lit("x"))
    got = [(r["doc_id"], r["level"]) for r in reading_level.reading_levels(df, "doc_id", "text", models).collect()]
    right = [k == [1, 2, 3, 4, 5][i % 5] for i, k in got if i < 40]
    assert sum(right) / len(right) > 0.9 and len(right) == 41
    assert {i for i, _ in got} == set(range(40)) | {200, 300}
    level = dict(got)
    assert level[200] == level[0]
    assert reading_level.reading_levels(df.limit(0), "doc_id", "text", models).count() == 0


def test_held_out_accuracy_on_the_samples(spark):
    from loomtext.sources.tables import table

    rows = [(r["text"], r["lang"], r["level"]) for r in table(spark, "/root/testdata/sf0.001", "reading_samples").collect()]
    random.Random(0).shuffle(rows)
    hit = 0
    for f in range(5):
        level, lang, _ = reading_level.Models([r for i, r in enumerate(rows) if i % 5 != f]).assign([r[0] for i, r in enumerate(rows) if i % 5 == f])
        hit += sum(a == r[2] and g == r[1] for a, g, r in zip(level, lang, rows[f::5], strict=True))
    assert hit / len(rows) > 0.85


def test_found_queries_have_their_columns(spark):
    import __spark_entry__ as e

    q = e.queries()
    want = {"p1_found": ["term", "mark"], "p2_found": ["pair_id", "group_id"], "p3_found": ["paragraph_id", "end_token"], "p4_found": ["paragraph_a", "paragraph_b"], "p5_found": ["origin", "id_a", "id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "level"]}
    for name, cols in want.items():
        assert q[name](spark, "/root/testdata/sf0.001").columns == cols
