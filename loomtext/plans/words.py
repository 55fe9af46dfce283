"""Queries on words: automata, morphology, subwords, segmentation, similarity, Bayes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import morph, segment, subword, vector
from loomtext.operators.latest import latest
from loomtext.sources.tables import table

NOUNS = "cat dog book fox box bus glass buzz quiz church watch bench dish brush wish month stomach epoch zinc path bath foxes watches tries bags foxs stomachs houses movies s ys ies".split()
WORDPIECE = [("low", 5, 0), ("lower", 2, 1), ("lowest", 3, 4), ("new", 4, 10), ("newer", 2, 13)]


def vocabulary(spark, sf):
    """Distinct lower-cased tokens of the valid paragraphs, with counts."""
    rows = latest(table(spark, sf, "process_corpus").select("paragraph_id", "sentences", "ingested_at"), "paragraph_id", "ingested_at")
    return rows.select(F.explode(F.flatten("sentences")).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def dfa_verdicts(spark, sf):
    """A1 F5."""
    return vocabulary(spark, sf).select("word", morph.verdict(F.col("word")).alias("verdict"))


def _accepted(spark, sf):
    words = vocabulary(spark, sf).filter(morph.accepted(F.col("word"))).select("word")
    return words.union(spark.createDataFrame([(w,) for w in NOUNS], "word string")).distinct()


def fst_analyse(spark, sf):
    """A2 A3 F6 J6."""
    words = _accepted(spark, sf)
    return morph.analysed(words, "word", words).select("word", "analysis", "trace")


def fst_summary(spark, sf):
    """G15."""
    a = F.col("analysis")
    return fst_analyse(spark, sf).agg(F.count("*").alias("words"), F.count_if(a.endswith(morph.PL)).alias("plural"), F.count_if(a.endswith(morph.SG)).alias("singular"), F.count_if(a == morph.INVALID).alias("invalid"))


def fst_generate(spark, sf):
    """A4."""
    forms = _accepted(spark, sf).select("word", F.explode(F.array(F.lit("+N+SG"), F.lit("+N+PL"))).alias("tag"))
    return forms.select(F.concat("word", "tag").alias("lexical"), morph.generated(F.concat("word", "tag")).alias("surface"))


def fst_inverse(spark, sf):
    """A5."""
    return _accepted(spark, sf).select("word", F.array_join(morph.analyses(F.col("word")), " ").alias("analyses"))


def fst_transitions(spark, sf):
    """A6."""
    return spark.createDataFrame(morph.transitions(), "state string, symbol string, next string, output string")


def _counted(spark, sf):
    return vocabulary(spark, sf).filter(morph.accepted(F.col("word"))).select("word", "n", F.col("word").alias("first"))


def wordpiece_scores(spark, sf):
    """T11-T13 on the accepted words."""
    words = _counted(spark, sf).select("n", "first", subword.pieces_of(F.col("word")).alias("pieces"))
    return subword.pair_scores(words).select("a", "b", "pair_freq", "freq_a", "freq_b", F.round("score", 12).alias("score"))


def wordpiece_train(spark, sf):
    """T14 on the literal corpus (S14): the steps and their ties."""
    words = spark.createDataFrame(WORDPIECE, "word string, n bigint, first bigint")
    steps, _ = subword.train(words, 2)
    return spark.createDataFrame([(i + 1, f"{a} + {b} -> {m}", round(s, 9), t) for i, (a, b, m, s, t) in enumerate(steps)], "step int, merged string, score double, ties int")


def wordpiece_tokenize(spark, sf):
    """Accepted words by the pieces of five merges over them."""
    words = _counted(spark, sf)
    steps, _ = subword.train(words, 5)
    first = words.select(F.explode(subword.pieces_of(F.col("word"))).alias("p")).distinct()
    vocab = [r["p"] for r in first.collect()] + [m for _, _, m, _, _ in steps]  # at most two pieces a letter
    return subword.tokenise(words, "word", vocab).select("word", F.array_join("pieces", " ").alias("pieces"))


def _eval_weights(spark, sf):
    docs = table(spark, sf, "eval_items").select("item_id", F.filter(F.split(F.lower("text"), r"[ \n\t\r]+"), lambda w: w != "").alias("words"))
    return vector.weights(docs, "item_id", "words")


def tfidf_pairs(spark, sf):
    """C1 G23 J13 on the evaluation items (a table of fixed size), pairs without a
    common term too."""
    w = _eval_weights(spark, sf)
    related = vector.cosine_pairs(w)
    return related.unionByName(vector.unrelated_pairs(w, related)).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("distance", 6).alias("distance"))


def tfidf_closest(spark, sf):
    """The most similar pair of different texts, and all as near by distance, of
    pairs without a common term too (O11)."""
    w = _eval_weights(spark, sf)
    related = vector.cosine_pairs(w)
    p = related.unionByName(vector.unrelated_pairs(w, related)).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("distance", 6).alias("distance")).filter("distance > 0")
    best = p.agg(F.max("cosine").alias("c"), F.min("distance").alias("d"))
    return p.join(F.broadcast(best), (p.cosine == F.col("c")) | (p.distance <= F.col("d") + 1e-12)).select("a", "b", "cosine", "distance")


FLAGS = {"digit": r"[0-9]", "mark": r"!", "link": r"www\.|://|@"}


def _flags(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null and lang in ('en', 'gu', 'hi')")
    return docs.select("lang", *[F.col("text").rlike(p).alias(k) for k, p in FLAGS.items()])


def bernoulli_nb(spark, sf):
    """Posteriors of every combination of the flags, with and without smoothing."""
    rows = _flags(spark, sf)
    cases = spark.range(8).select(*[(F.col("id").bitwiseAND(1 << i) > 0).alias(f"x_{k}") for i, k in enumerate(FLAGS)])
    out = None
    for alpha in (0.0, 1.0):
        m = vector.bernoulli(rows, "lang", list(FLAGS), alpha).crossJoin(F.broadcast(cases))  # 8 cases for each class
        j = m.withColumn("joint", vector.bernoulli_joint({k: F.col(f"x_{k}") for k in FLAGS}))
        total = j.groupBy(*[f"x_{k}" for k in FLAGS]).agg(F.sum("joint").alias("z"))
        x = j.join(total, [f"x_{k}" for k in FLAGS]).select("lang", F.lit(alpha).alias("alpha"), *[f"x_{k}" for k in FLAGS], F.round("joint", 9).alias("joint"), F.round(F.coalesce(F.try_divide("joint", "z"), F.lit(0.0)), 9).alias("posterior"))
        out = x if out is None else out.union(x)
    return out


def kn_bigram_exact(spark, sf):
    """L11 J12 on the spelling corrections of several words."""
    w = F.split(F.lower(F.trim("correct")), "[ _]+")
    pairs = table(spark, sf, "spell_results").select("pair_id", w.alias("w")).distinct().filter(F.size("w") > 1)
    pairs = pairs.select(F.inline(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("v"), F.slice("w", 2, F.size("w") - 1).alias("w")))).toDF("v", "w").groupBy("v", "w").agg(F.count("*").alias("c"))
    return vector.kneser_ney_bigrams(pairs)


def _cases(spark, sf):
    return latest(table(spark, sf, "sample_predictions"), "case_id", "predicted_at").filter("input is not null and ground_truth is not null")


def _seg_vocab(spark, sf):
    return _cases(spark, sf).select(F.explode(F.filter(F.split("ground_truth", " "), lambda w: w != "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _segmented(spark, sf):
    return segment.segmented(_cases(spark, sf), "case_id", "input", _seg_vocab(spark, sf))


def seg_greedy(spark, sf):
    """T6 T8 T10."""
    return _segmented(spark, sf).select("case_id", F.col("greedy").alias("segmented"))


def seg_dp(spark, sf):
    """T7."""
    return _segmented(spark, sf).select("case_id", F.col("dp").alias("segmented"))


def seg_metrics(spark, sf):
    """G14 on the stored predictions."""
    rows = _cases(spark, sf).filter("greedy is not null and dp is not null")
    out = None
    for m in ("greedy", "dp"):
        x = rows.agg(F.lit(m).alias("method"), F.count("*").alias("cases"), *[c.alias(k) for k, c in segment.agreement(F.col("ground_truth"), F.col(m)).items()])
        out = x if out is None else out.union(x)
    return out


def seg_metrics_ours(spark, sf):
    """G14 on our own segmentations against the truth."""
    both = _segmented(spark, sf).join(_cases(spark, sf).select("case_id", "ground_truth"), "case_id")
    out = None
    for m in ("greedy", "dp"):
        x = both.agg(F.lit(m).alias("method"), F.count("*").alias("cases"), *[c.alias(k) for k, c in segment.agreement(F.col("ground_truth"), F.col(m)).items()])
        out = x if out is None else out.union(x)
    return out


VOCAB_SQL = """
WITH valid AS (SELECT * FROM process_corpus QUALIFY row_number() OVER (PARTITION BY paragraph_id ORDER BY ingested_at DESC) = 1),
vocabulary AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(flatten(sentences)) AS w FROM valid) GROUP BY 1)"""
ACCEPTED_SQL = VOCAB_SQL + f", acc AS (SELECT word FROM vocabulary WHERE regexp_full_match(word, '[a-z]+') UNION SELECT unnest([{', '.join(repr(w) for w in NOUNS)}]))"
_CUT = lambda k: f"substr(word, 1, greatest(len(word) - {k}, 0))"
_LEX = lambda x: f"({x} IN (SELECT word FROM acc))"
_ES, _S1, _Y = _CUT(2), _CUT(1), f"({_CUT(3)} || 'y')"
_PREF = lambda a, b: f"CASE WHEN {_LEX(b)} AND NOT {_LEX(a)} THEN {b} ELSE {a} END"
FST_SQL = ACCEPTED_SQL + f""", fst AS (SELECT word, CASE
  WHEN word NOT LIKE '%s' OR word LIKE '%ss' THEN word || '+N+SG'
  WHEN regexp_matches(word, '(?:[xz]|[cs]h|[^aeiou]y)s$') OR word = 'ies' THEN 'Invalid Word'
  WHEN word NOT LIKE '%es' THEN {_S1} || '+N+PL'
  WHEN regexp_matches(word, '[aeiou]ies$') THEN {_PREF(_S1, _Y)} || '+N+PL'
  WHEN word LIKE '%ies' THEN {_PREF(_Y, _S1)} || '+N+PL'
  WHEN regexp_matches(word, '(?:[sxz]|[cs]h)es$') THEN {_PREF(_ES, _S1)} || '+N+PL'
  ELSE {_S1} || '+N+PL' END AS analysis, CASE
  WHEN word NOT LIKE '%s' THEN 'Q0 COPY_SG' WHEN word LIKE '%ss' THEN 'Q0 Q_S COPY_SG'
  WHEN regexp_matches(word, '(?:[xz]|[cs]h|[^aeiou]y)s$') THEN 'Q0 Q_S REJECT' WHEN word NOT LIKE '%es' THEN 'Q0 Q_S COPY_PL'
  WHEN word = 'ies' THEN 'Q0 Q_S Q_SE Q_SEI REJECT' WHEN word LIKE '%ies' THEN 'Q0 Q_S Q_SE Q_SEI COPY_PL' ELSE 'Q0 Q_S Q_SE COPY_PL' END AS trace FROM acc)"""
_SIB = "(?:s|x|z|ch|sh)$"
PAIRS_SQL = """
WITH t AS (SELECT item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda w: w <> '')) AS term FROM eval_items),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT id, term, tf * log10((SELECT count(*) FROM eval_items) / df) AS w FROM tf JOIN df USING (term)),
norm AS (SELECT id, sum(w * w) AS sq FROM w GROUP BY id),
dot AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM w x JOIN w y USING (term) WHERE x.id < y.id AND x.w > 0 GROUP BY ALL),
pairs AS (SELECT n.id AS a, m.id AS b, CASE WHEN dot IS NULL THEN 0 ELSE round(dot / sqrt(n.sq * m.sq), 6) END AS cosine, round(sqrt(greatest(n.sq + m.sq - 2 * coalesce(dot, 0), 0)), 6) AS distance FROM norm n JOIN norm m ON n.id < m.id LEFT JOIN dot ON n.id = a AND m.id = b)"""
CASES_SQL = "WITH cases AS (SELECT * FROM sample_predictions QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY predicted_at DESC) = 1), ok AS (SELECT * FROM cases WHERE input IS NOT NULL AND ground_truth IS NOT NULL)"
_BAYES = " UNION ALL ".join(
    f"""SELECT lang, {a}::DOUBLE AS alpha, x_digit, x_mark, x_link, (n / (SELECT sum(n) FROM c)) * (CASE WHEN x_digit THEN (d + {a}) / (n + 2 * {a}::DOUBLE) ELSE 1 - (d + {a}) / (n + 2 * {a}::DOUBLE) END)
  * (CASE WHEN x_mark THEN (m + {a}) / (n + 2 * {a}::DOUBLE) ELSE 1 - (m + {a}) / (n + 2 * {a}::DOUBLE) END) * (CASE WHEN x_link THEN (l + {a}) / (n + 2 * {a}::DOUBLE) ELSE 1 - (l + {a}) / (n + 2 * {a}::DOUBLE) END) AS j FROM c, x""" for a in (0, 1)
)
SQL = {
    "dfa_verdicts": VOCAB_SQL + " SELECT word, CASE WHEN regexp_full_match(word, '[a-z]+') THEN 'Accepted' ELSE 'Not Accepted' END AS verdict FROM vocabulary",
    "fst_analyse": FST_SQL + " SELECT word, analysis, trace FROM fst",
    "fst_summary": FST_SQL + " SELECT count(*) AS words, count(*) FILTER (WHERE analysis LIKE '%+N+PL') AS plural, count(*) FILTER (WHERE analysis LIKE '%+N+SG') AS singular, count(*) FILTER (WHERE analysis = 'Invalid Word') AS invalid FROM fst",
    "fst_generate": ACCEPTED_SQL + f" SELECT word || tag AS lexical, CASE WHEN tag = '+N+SG' THEN word WHEN regexp_matches(word, '{_SIB}') THEN word || 'es' ELSE word || 's' END AS surface FROM acc, (SELECT unnest(['+N+SG', '+N+PL']) AS tag)",
    "fst_inverse": ACCEPTED_SQL + f" SELECT word, array_to_string(list_sort(list_filter([word || '+N+SG', CASE WHEN word LIKE '%s' AND {_S1} <> '' AND NOT regexp_matches({_S1}, '{_SIB}') THEN {_S1} || '+N+PL' END, CASE WHEN word LIKE '%es' AND regexp_matches({_ES}, '{_SIB}') THEN {_ES} || '+N+PL' END], lambda x: x IS NOT NULL)), ' ') AS analyses FROM acc",
    "wordpiece_scores": VOCAB_SQL + """, p AS (SELECT word, n, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM vocabulary WHERE regexp_full_match(word, '[a-z]+')),
      q AS (SELECT word, n, i, CASE WHEN i > 1 THEN '##' ELSE '' END || c AS a FROM p), r AS (SELECT *, lead(a) OVER (PARTITION BY word ORDER BY i) AS b FROM q),
      s AS (SELECT a, sum(n)::BIGINT AS f FROM q GROUP BY a), t AS (SELECT a, b, sum(n)::BIGINT AS pair_freq FROM r WHERE b IS NOT NULL GROUP BY a, b)
      SELECT t.a, t.b, pair_freq, x.f AS freq_a, y.f AS freq_b, round(pair_freq / (x.f * y.f), 12) AS score FROM t JOIN s x ON x.a = t.a JOIN s y ON y.a = t.b""",
    "wordpiece_train": "SELECT * FROM (VALUES (1, '##s + ##t -> ##st', round(3 / 9, 9), 0), (2, 'l + ##o -> lo', 0.1::DOUBLE, 0)) v(step, merged, score, ties)",
    "tfidf_pairs": PAIRS_SQL + " SELECT a, b, cosine, distance FROM pairs",
    "tfidf_closest": PAIRS_SQL + ", p AS (SELECT * FROM pairs WHERE distance > 0), m AS (SELECT max(cosine) AS c, min(distance) AS d FROM p) SELECT a, b, cosine, distance FROM p, m WHERE cosine = c OR distance <= d + 1e-12",
    "bernoulli_nb": f"""WITH f AS (SELECT lang, regexp_matches(text, '[0-9]') AS digit, contains(text, '!') AS mark, regexp_matches(text, 'www\\.|://|@') AS link FROM documents WHERE text IS NOT NULL AND lang IN ('en', 'gu', 'hi')),
      c AS (SELECT lang, count(*) AS n, sum(digit::INT)::DOUBLE AS d, sum(mark::INT)::DOUBLE AS m, sum(link::INT)::DOUBLE AS l FROM f GROUP BY lang),
      x AS (SELECT (i & 1) > 0 AS x_digit, (i & 2) > 0 AS x_mark, (i & 4) > 0 AS x_link FROM range(8) r(i)), j AS ({_BAYES})
      SELECT lang, alpha, x_digit, x_mark, x_link, round(j, 9) AS joint, round(coalesce(j / nullif(sum(j) OVER (PARTITION BY alpha, x_digit, x_mark, x_link), 0), 0), 9) AS posterior FROM j""",
    "kn_bigram_exact": """WITH s AS (SELECT DISTINCT pair_id, regexp_split_to_array(lower(trim(correct)), '[ _]+') AS w FROM spell_results WHERE correct IS NOT NULL), b AS (SELECT unnest(w[1:len(w) - 1]) AS v, unnest(w[2:]) AS w FROM s WHERE len(w) > 1),
      p AS (SELECT v, w, count(*) AS c FROM b GROUP BY ALL), pv AS (SELECT v, sum(c)::BIGINT AS cv, count(*) AS kinds FROM p GROUP BY v), pw AS (SELECT w, count(*) AS before FROM p GROUP BY w), t AS (SELECT count(*) AS types FROM p)
      SELECT v, w, (greatest(2 * c - 1, 0) * types + kinds * before)::BIGINT AS num, (cv * 2 * types)::BIGINT AS den, round((greatest(2 * c - 1, 0) * types + kinds * before) / (cv * 2 * types), 9) AS p FROM p JOIN pv USING (v) JOIN pw USING (w), t""",
    "seg_greedy": CASES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(ground_truth, ' ')) AS word FROM ok) WHERE word <> ''),
      m AS (SELECT max(len(word)) AS longest FROM v), vs AS (SELECT set_agg.l AS l FROM (SELECT list(word) AS l FROM v) set_agg),
      g AS (SELECT case_id, input AS rest, '' AS done, 0 AS steps FROM ok
        UNION ALL SELECT g.case_id, substr(rest, k + 1), done || CASE WHEN steps > 0 THEN ' ' ELSE '' END || substr(rest, 1, k), steps + 1
        FROM (SELECT g.*, coalesce((SELECT max(len(v.word)) FROM v WHERE starts_with(g.rest, v.word)), 1) AS k FROM g WHERE rest <> '') g)
      SELECT case_id, done AS segmented FROM g WHERE rest = ''""",
    "seg_metrics": CASES_SQL + ", r AS (SELECT * FROM ok WHERE greedy IS NOT NULL AND dp IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{m}' AS method, count(*) AS cases, round(avg((ground_truth = {m})::INT), 6) AS exact, round(avg(lv), 6) AS distance, round(avg(lv / greatest(len(ground_truth), 1)), 6) AS normalised FROM (SELECT *, levenshtein_chars({m}, ground_truth) AS lv FROM r)" for m in ("greedy", "dp")),
}
SQL["fst_transitions"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in morph.transitions()) + ") v(state, symbol, next, output)"
del SQL["seg_metrics"]  # the other engine's edit distance counts bytes
QUERIES = {f.__name__: f for f in (dfa_verdicts, fst_analyse, fst_summary, fst_generate, fst_inverse, fst_transitions, wordpiece_scores, wordpiece_train, wordpiece_tokenize, tfidf_pairs, tfidf_closest, bernoulli_nb, kn_bigram_exact, seg_greedy, seg_dp, seg_metrics, seg_metrics_ours)}
