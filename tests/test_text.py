import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators import latest, morph, ngrams, segment, spell, stats, subword, tagging, text, trees, vector
from loomtext.sources import files


def tokens(spark, s):
    rows = text.tokenised(spark.createDataFrame([(1, s)], "doc_id int, text string")).collect()
    return [(t["tok"], t["type"]) for t in rows[0]["tokens"]] if rows else []


def sentences(spark, s):
    rows = text.with_sentences(text.tokenised(spark.createDataFrame([(1, s)], "doc_id int, text string"))).collect()
    return [" ".join(t["tok"] for t in x) for x in rows[0]["sentences"]] if rows else []


def test_token_classes(spark):
    got = tokens(spark, "12/07/2023 1,00,000 45% a@b.com ... … yes!? 😀 ૩.૧૪ x")
    assert got == [("12/07/2023", "DATE"), ("1,00,000", "NUMBER"), ("45%", "NUMBER"), ("a@b.com", "EMAIL"), ("...", "ELLIPSIS"), ("…", "ELLIPSIS"), ("yes", "WORD"), ("!?", "SENTEND"), ("😀", "OTHER"), ("૩.૧૪", "NUMBER"), ("x", "WORD")]


def test_link_tail(spark):
    assert tokens(spark, "www.a.com. x") == [("www.a.com", "URL"), (".", "PUNCT"), ("x", "WORD")]
    assert tokens(spark, "www... y")[:4] == [("www", "URL"), (".", "PUNCT"), (".", "PUNCT"), (".", "PUNCT")]
    assert sentences(spark, "see www.a.com. Then go.") == ["see www.a.com . Then go ."]


def test_abbreviation_is_no_end(spark):
    assert sentences(spark, "ડૉ. શાહ 3.14 વાગ્યે આવ્યા.") == ["ડૉ . શાહ 3.14 વાગ્યે આવ્યા ."]
    assert sentences(spark, "Go... now! and") == ["Go ...", "now !", "and"]


def test_blank_and_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, " a\r\nb ")], "doc_id int, text string")
    assert [(r["doc_id"], len(r["tokens"])) for r in text.tokenised(df).collect()] == [(4, 2)]
    empty = stats.corpus_stats(text.with_sentences(text.tokenised(df.filter("doc_id < 0")))).collect()[0]
    assert empty["paragraphs"] == 0 and empty["type_token_ratio"] == 0


def test_latest_keeps_one_row_each(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, d) for d in range(1, 4)]
    rows = [(1, t[0], "a"), (1, t[1], "b"), (2, None, "c"), (2, t[0], "d"), (3, t[2], "e"), (None, t[0], "f")]
    df = spark.createDataFrame(rows, "k long, at timestamp, v string")
    for most in (1_000_000, 0):
        assert sorted(r["v"] for r in latest.latest(df, "k", "at", broadcast_rows=most).collect()) == ["b", "d", "e", "f"]
    tied = spark.createDataFrame([(1, t[0], "a"), (1, t[0], "a")], df.schema)
    assert latest.latest(tied, "k", "at").count() == 1
    assert latest.latest(df.limit(0), "k", "at").count() == 0


def test_running_budget_matches_a_loop(spark):
    df = spark.range(250).select("id", (F.col("id") % 7 + 1).alias("size"))
    total, want = 0, 0
    for b in range(0, 250, 20):
        if total >= 300:
            break
        batch = [i % 7 + 1 for i in range(b, min(b + 20, 250))]
        total, want = total + sum(batch), want + len(batch)
    assert stats.running_budget(df, "id", F.col("size"), 300, 20, blocks=7).count() == want


def test_automaton_and_noun_forms(spark):
    words = "foxes fox watches tries bags foxs houses movies stomachs zlotys warys s ys ies boss dog1".split()
    df = spark.createDataFrame([(w,) for w in words], "word string")
    lex = spark.createDataFrame([("house",), ("movie",), ("watch",), ("try",), ("fox",)], "word string")
    got = {r["word"]: r["analysis"] for r in morph.analysed(df, "word", lex).collect()}
    assert got == {"foxes": "fox+N+PL", "fox": "fox+N+SG", "watches": "watch+N+PL", "tries": "try+N+PL", "bags": "bag+N+PL", "foxs": "Invalid Word", "houses": "house+N+PL", "movies": "movie+N+PL", "stomachs": "Invalid Word", "zlotys": "Invalid Word", "warys": "Invalid Word", "s": "+N+PL", "ys": "y+N+PL", "ies": "Invalid Word", "boss": "boss+N+SG", "dog1": "Invalid Word"}
    v = {w: df.sparkSession.range(1).select(morph.verdict(F.lit(w)).alias("v")).first()["v"] for w in ("cat", "", "DogHouse", "a\n")}
    assert v == {"cat": "Accepted", "": "Not Accepted", "DogHouse": "Not Accepted", "a\n": "Not Accepted"}


def test_generator_and_its_inverse(spark):
    r = spark.range(1).select(morph.generated(F.lit("quiz+N+PL")).alias("a"), morph.generated(F.lit("stomach+N+PL")).alias("b"), morph.generated(F.lit("x")).alias("c"), morph.analyses(F.lit("foxes")).alias("d"), morph.analyses(F.lit("stomachs")).alias("e")).first()
    assert (r["a"], r["b"], r["c"]) == ("quizes", "stomaches", None)
    assert r["d"] == ["fox+N+PL", "foxe+N+PL", "foxes+N+SG"] and r["e"] == ["stomachs+N+SG"]


def test_wordpiece_literal(spark):
    words = spark.createDataFrame([("low", 5, 0), ("lower", 2, 1), ("lowest", 3, 4), ("new", 4, 10), ("newer", 2, 13)], "word string, n long, first long")
    steps, final = subword.train(words, 2)
    assert [(a, b, m) for a, b, m, _, _ in steps] == [("##s", "##t", "##st"), ("l", "##o", "lo")] and steps[0][4] == steps[1][4] == 0
    vocab = frozenset(["##e", "##o", "##r", "##s", "##t", "##w", "l", "n", "##st", "lo"])
    assert subword.longest_match("newest", vocab) == ["n", "##e", "##w", "##e", "##st"]
    assert subword.longest_match("zebra", vocab) == ["[UNK]"] and subword.longest_match("", vocab) == []
    assert {r["word"]: r["pieces"] for r in final.collect()}["lowest"] == ["lo", "##w", "##e", "##st"]


def test_tfidf_literal(spark):
    docs = spark.createDataFrame([(i, s.split()) for i, s in enumerate(["cat dog animal", "cat cat pet", "dog pet animal", "cat dog pet"], 1)], "id int, w array<string>")
    got = {(r["a"], r["b"]): r["cosine"] for r in vector.cosine_pairs(vector.weights(docs, "id", "w")).collect()}
    want = {(1, 2): 0.320147, (1, 3): 0.871882, (1, 4): 0.413308, (2, 3): 0.160074, (2, 4): 0.774597, (3, 4): 0.413308}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_bernoulli_literal(spark):
    rows = [((1, 1, 1), "Spam"), ((1, 1, 0), "Spam"), ((1, 0, 1), "Spam"), ((0, 1, 1), "Spam"), ((0, 0, 1), "NotSpam"), ((0, 1, 0), "NotSpam"), ((1, 0, 0), "NotSpam")]
    df = spark.createDataFrame([(*map(bool, x), y) for x, y in rows], "free boolean, win boolean, offer boolean, y string")
    for alpha, spam, ham in ((0.0, 1 / 112, 8 / 63), (1.0, 4 / 189, 81 / 875)):
        m = vector.bernoulli(df, "y", ["free", "win", "offer"], alpha).withColumn("j", vector.bernoulli_joint({f: F.lit(False) for f in ("free", "win", "offer")}))
        got = {r["y"]: r["j"] for r in m.collect()}
        assert got["Spam"] == pytest.approx(spam) and got["NotSpam"] == pytest.approx(ham)


def test_kneser_ney_literal(spark):
    pairs = [p for s in ("I like NLP", "I like AI", "You like NLP", "You love AI", "We love NLP") for p in zip(s.split(), s.split()[1:])]
    df = spark.createDataFrame(pairs, "v string, w string").groupBy("v", "w").agg(F.count("*").alias("c"))
    got = {(r["v"], r["w"]): r["p"] for r in vector.kneser_ney_bigrams(df).collect()}
    assert len(got) == 8 and got["love", "AI"] == pytest.approx(3 / 8) and got["like", "NLP"] == pytest.approx(7 / 12)


def test_segmenters_agree_with_search():
    vocab = {"it": 3, "that": 5, "the": 9, "cat": 2, "hat": 1, "he": 1}
    trie = segment.Trie(vocab)
    for t in ("itthatthecat", "xthehatx", "", "thethethat"):
        assert segment.greedy(t, vocab, 4) == trie.greedy(t)
        best = trie.best_path(t)
        assert "".join(best) == t
    assert trie.best_path("itthatthecat") == ["it", "that", "the", "cat"]


def test_best_path_against_all_segmentations():
    import itertools
    import math

    from loomtext.operators import segment

    vocab = {"a": 4, "ab": 3, "abc": 1, "bc": 5, "c": 2}
    total, trie = sum(vocab.values()), segment.Trie(vocab)

    def score(words):
        return sum(math.log(vocab[w] / total) if w in vocab else math.log(10 / total) - len(w) * math.log(10) for w in words)

    for text in ("abc", "aabcc", "xabcx", "abcabc", "cab"):
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            words = [text[a:b] for a, b in itertools.pairwise(edges)]
            if max(map(len, words)) <= trie.longest:
                ways.append(words)
        assert math.isclose(score(trie.best_path(text)), max(map(score, ways)))


def test_two_edit_search_against_distances(spark):
    import random

    from loomtext.operators import spell

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(80)})
    trie = spell.followers(words)
    for typo in ["abc", "", "cabba", "bbb", "accab"]:
        found = spell.search(typo, frozenset(words), trie, 2)
        far = spell.osa_distance.func(pd.Series([typo] * len(words)), pd.Series(words))
        assert {w for w, d in zip(words, far, strict=True) if d <= 2} <= set(found)
        assert all(len(e) <= 2 for es in found.values() for e in es)
        for w, d in zip(words, far, strict=True):
            if w in found:
                assert min(map(len, found[w])) <= d


def test_language_model_sums_to_one(spark):
    from loomtext.operators import lm

    text_ = [("train", "a b a c".split()), ("train", "a b b".split()), ("train", "c a b".split()), ("dev", "a c b z".split())]
    s = spark.createDataFrame(text_, "split string, words array<string>")
    c = lm.Counts(s)
    assert c.v == 5
    ctx = c.contexts[2].collect()
    words = [r["word"] for r in c.vocab.collect()]
    grid = spark.createDataFrame([("dev", "<s>", "<s>", r["w2"], w) for r in ctx for w in words], "split string, w0 string, w1 string, w2 string, w3 string").withColumn("m", F.lit(1))
    c.evals = grid
    rows = c.scored()
    for p in (F.exp(lm.add_k(c, 2, lm.d(1))), F.exp(lm.add_k(c, 2, lm.d(0.3))), lm.interpolated(c, 2, lm.LAMBDAS)):
        for r in rows.withColumn("p", p).groupBy("w2").agg(F.sum("p").alias("p")).collect():
            assert r["p"] == pytest.approx(1.0)


def test_good_turing_guards():
    from loomtext.operators.lm import good_turing

    assert good_turing({}, 0)["ratio"] == {r: 1.0 for r in range(1, 6)}
    g = good_turing({1: 10, 2: 5, 3: 3, 4: 2, 5: 1, 6: 1}, 60)
    assert all(0 < x <= 1.5 for x in g["ratio"].values())


@pytest.fixture(scope="module")
def tagged(spark):
    import random

    rng = random.Random(5)
    rows = [(s, i, rng.choice(["aa", "bb", "longer", "cc"]) if s < 20 else rng.choice(["aa", "new", "cc"]), rng.choice("XYZ")) for s in range(24) for i in range(1, rng.randint(2, 9))]
    return spark.createDataFrame(rows, "sent long, pos int, word string, tag string")


def test_decoders(spark, tagged):
    train, test = tagged.filter("sent < 20"), tagged.filter("sent >= 20")
    trans, (emit, unk) = tagging.hmm_transitions(train, 0.1), tagging.hmm_emissions(train)
    m = tagging.Hmm(trans.toPandas(), emit.toPandas(), unk.toPandas())
    from itertools import product

    for words in (["aa"], ["aa", "new"], ["new", "cc", "aa", "bb"]):
        e = m.scores(words)
        score = lambda p: m.fwd[m.n, p[0]] + sum(m.fwd[a, b] for a, b in zip(p, p[1:])) + m.fwd[p[-1], m.n] + sum(e[i, t] for i, t in enumerate(p))  # noqa: B023, E731
        best = max(product(range(m.n), repeat=len(words)), key=score)
        assert score(m.forward(words)) == pytest.approx(score(best)) == pytest.approx(score(m.max_marginal(words)))
        assert score(m.backward(words)) == pytest.approx(score(best))
    joint = tagging.hmm_joint(test, trans, emit, unk).collect()
    assert all(r["forward"] == pytest.approx(r["backward"]) for r in joint if r["forward"] > float("-inf"))
    pred = tagging.hmm_decode(test, trans, emit, unk, "posterior")
    o = tagging.overall(pred).first()
    c = tagging.confusion(pred).collect()
    assert o["tokens"] == test.count() == sum(r["n"] for r in c)


def test_perfect_prediction(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "tag string, pred string")
    r = tagging.overall(df).first()
    assert (r["accuracy"], r["macro_f1"], r["weighted_f1"]) == (1.0, 1.0, 1.0)
    never = {x["tag"]: x for x in tagging.per_class(spark.createDataFrame([("a", "b"), ("a", "a")], "tag string, pred string")).collect()}
    assert never["b"]["precision"] == 0 and never["b"]["support"] == 0


def test_one_edit_equals_search(spark):
    words = ["begining", "beginning", "ab", "ba", "abc", "a", "word", "wrod", "x y", "xy"]
    vocab = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    typos = spark.createDataFrame([(w,) for w in ["begining", "ab", "wrod", "x y", "", "1a"]], "typo string")
    near = {(r["typo"], r["cand"], tuple(r["edits"])) for r in spell.candidates(typos, vocab).collect()}
    want = {(t, c, e) for t in ["begining", "ab", "wrod", "x y", "", "1a"] for c, es in spell.search(t, frozenset(words), spell.followers(words), 1).items() for e in es}
    assert near == want
    assert ("begining", "beginning", ("i|in",)) in near and ("begining", "beginning", ("n|nn",)) in near


def test_osa_distance(spark):
    df = spark.createDataFrame([("ca", "abc"), ("caht", "chat"), ("", "ab"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(spell.osa_distance("a", "b")).collect()] == [3, 1, 2, None]


def test_tree_against_a_loop(spark):
    import random

    rng = random.Random(2)
    data = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 4)), rng.random() * 10) for i in range(200)]
    df = spark.createDataFrame(data, "id int, a double, b double, y double")
    t = trees.grow(df, ["a", "b"], F.col("y"), max_depth=2)

    def var(ys):
        m = sum(ys) / len(ys)
        return sum((y - m) ** 2 for y in ys) / len(ys)

    def best(rows):
        out = None
        for f in (1, 2):
            for thr in sorted({r[f] for r in rows}):
                left, right = [r[3] for r in rows if r[f] <= thr], [r[3] for r in rows if r[f] > thr]
                if left and right:
                    g = var([r[3] for r in rows]) - len(left) / len(rows) * var(left) - len(right) / len(rows) * var(right)
                    if out is None or g > out[0] + 1e-9:
                        out = (g, f, thr)
        return out

    _, f, thr = best(data)
    assert t.splits[1] == (["", "a", "b"][f], thr)
    left = [r for r in data if r[f] <= thr]
    _, f2, thr2 = best(left)
    assert t.splits[2] == (["", "a", "b"][f2], thr2)
    m = df.agg(*trees.regression_metrics(F.col("y"), t.predict())).first()
    assert 0 < m["r2"] < 1
    flat = df.withColumn("y", F.lit(1.0))
    assert trees.grow(flat, ["a"], F.col("y")).splits == {}
    assert flat.agg(*trees.regression_metrics(F.col("y"), F.col("y"))).first()["r2"] == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\tX\nb\tY\n\nc\tX\n", encoding="utf-8")
    assert [(r["sent"], r["pos"], r["word"], r["tag"]) for r in files.read_tagged(spark, str(tmp_path / "t.txt")).orderBy("sent", "pos").collect()] == [(0, 1, "a", "X"), (0, 2, "b", "Y"), (1, 1, "c", "X")]
    (tmp_path / "e.txt").write_text("right: rihgt, rite*3\nSame_word: same_word, smae_word\n", encoding="utf-8")
    got = {(r["correct"], r["typo"]): (r["weight"], r["line"]) for r in spell.pairs_of(files.read_error_list(spark, str(tmp_path / "e.txt"))).collect()}
    assert got == {("right", "rihgt"): (1, 0), ("right", "rite"): (3, 0), ("same word", "smae word"): (1, 1)}
    (tmp_path / "c.tsv").write_bytes("é|e\t3\n".encode("latin-1"))
    assert files.read_counts(spark, str(tmp_path / "c.tsv"), "ISO-8859-1").first()["key"] == "é|e"
    paras = spark.createDataFrame([(1, [["a", "b"], ["c"]]), (2, [["d"]])], files.TOKENISED)
    for kind in (None, "gzip"):
        files.write_paragraphs(paras, str(tmp_path / f"p{kind}"), kind)
        assert sorted(map(tuple, files.read_paragraphs(spark, str(tmp_path / f"p{kind}")).collect())) == sorted(map(tuple, paras.collect()))
    files.write_sentences(paras, str(tmp_path / "s"))
    assert sorted(r["sentence"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["a b", "c", "d"]
    assert [r["row_id"] for r in files.numbered(spark, str(tmp_path / "s"), "sentence").orderBy("row_id").collect()] == [0, 1, 2]
    files.write_readable(paras, str(tmp_path / "r"))
    assert files.write_metrics(paras, str(tmp_path / "m")) and not files.write_metrics(paras, str(tmp_path / "m"))
    assert files.read_if_there(spark, str(tmp_path / "none")) is None
    files.write_splits(paras.withColumn("split", F.lit("dev")), str(tmp_path / "k"))
    assert os.path.isdir(tmp_path / "k" / "split=dev")
    (tmp_path / "x.txt").write_text("a  b c\n\n", encoding="utf-8")
    assert files.read_sentences(spark, str(tmp_path / "x.txt")).first()["words"] == ["a", "b", "c"]


def test_vocabulary_and_grams(spark):
    s = spark.createDataFrame([("train", ["a", "a", "b"])], "split string, words array<string>")
    assert sorted(r["word"] for r in ngrams.vocabulary(s).collect()) == ["</s>", "<UNK>", "a"]
    four = ngrams.grams(ngrams.mapped(s, ngrams.vocabulary(s)))
    assert four.count() == 4 and ngrams.order(four.drop("split"), 1).agg(F.sum("c")).first()[0] == 4


def test_streamed_counts(spark, tmp_path):
    from loomtext.streaming.counts import windowed_words

    rows = spark.createDataFrame([("2025-01-01 00:00:00", [["a", "b"]]), ("2025-01-01 05:00:00", [["a"]]), ("2025-01-05 00:00:00", [["c"]])], "t string, sentences array<array<string>>").select(F.col("t").cast("timestamp").alias("ingested_at"), "sentences")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_words(stream).writeStream.format("memory").queryName("words").option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["word"], r["n"]) for r in spark.table("words").collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_every_query_has_a_name_and_columns_are_stable(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80
    assert e.entry(spark).count() == 1


def test_closest_pair_may_share_no_term(spark, tmp_path):
    from loomtext.plans import words

    texts = {1: "a b c d e f g", 2: "a h i j k l m", 3: "n", 4: "o", 5: "n o p q r s t u"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = {(r["a"], r["b"]): r["distance"] for r in words.tfidf_closest(spark, str(tmp_path)).collect()}
    # 3 and 4: one term each, found in two of five texts
    assert got[3, 4] == round(2**0.5 * math.log10(5 / 2), 6) == min(got.values())


def test_boosting_stores_what_it_has(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), float((i * 37) % 11)) for i in range(60)], "a double, b double, _sum double")
    one = trees.boosted(rows, ["a", "b"], F.col("_sum"), rounds=5, max_depth=2, every=100)
    two = trees.boosted(rows, ["a", "b"], F.col("_sum"), rounds=5, max_depth=2, every=2)
    far = rows.agg(F.max(F.abs(one - two)).alias("d")).first()["d"]
    assert far < 1e-9


def test_bootstrap_draws_one_on_average(spark):
    got = spark.range(20_000).select(trees.bootstrap(F.col("id"), 1).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20_000 for r in got}
    assert abs(share[0] - math.exp(-1)) < 0.02 and abs(sum(w * s for w, s in share.items()) - 1) < 0.03


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"".join(b"line %d\r\n" % i if i % 5 else b"\n" for i in range(2000)))
    (tmp_path / "b.tsv").write_text("".join(f"w{i}\tT\n" if i % 4 else "\n" for i in range(1, 900)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sorted((r["line"], r["value"]) for r in files.read_lines(spark, str(tmp_path / "a.txt")).collect())
        tagged = files.read_tagged(spark, str(tmp_path / "b.tsv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f"line {i}" if i % 5 else "") for i in range(2000)]
    assert sorted((r["sent"], r["pos"], r["word"]) for r in tagged) == sorted((i // 4, i % 4, f"w{i}") for i in range(1, 900) if i % 4)
