"""Queries on sequence labelling, over events: a sentence is a user's events in
order, a tag is an event's type, a word the class of its value."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from loomtext.functions.lineage import cut
from loomtext.operators import tagging
from loomtext.sources.tables import table


NB_ALPHAS = (1.0, 0.3, 0.1, 0.03, 0.01)
HMM_KS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def tokens(spark, sf):
    """Sentences of all users; of every ten, the last but one is dev and the last test."""
    rows = table(spark, sf, "events").filter("event_type is not null and user_id is not null")
    word = F.when(F.col("value").isNull(), "none").otherwise(F.concat(F.lit("v"), F.floor(F.col("value") / 5).cast("string")))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = F.col("user_id") % 10
    split = F.when(r < 8, "train").when(r == 8, "dev").otherwise("test")
    return rows.select(F.col("user_id").alias("sent"), pos.alias("pos"), word.alias("word"), F.col("event_type").alias("tag"), split.alias("split"))


def _parts(spark, sf):
    t = tokens(spark, sf)
    return t.filter("split = 'train'").drop("split"), t.filter("split = 'test'").drop("split")


def nb_fit(spark, sf):
    lik, _ = tagging.nb_fit(_parts(spark, sf)[0], 0.1)
    return lik.select("feature", "value", "tag", F.round("ll", 6).alias("ll"))


def _nb(spark, sf, alpha=0.1):
    train, test = _parts(spark, sf)
    lik, prior = tagging.nb_fit(train, alpha)
    return tagging.nb_tag_gold(test, lik, prior)


def nb_tag_gold(spark, sf):
    return _nb(spark, sf).select("sent", "pos", "tag", "pred")


def nb_tag_greedy(spark, sf):
    train, test = _parts(spark, sf)
    return tagging.nb_decode(test, *tagging.nb_fit(train, 0.1)).select("sent", "pos", "tag", "pred")


def nb_tune(spark, sf):
    """Accuracy on dev for the grid of alpha, the best one marked."""
    t = tokens(spark, sf)
    train, dev = t.filter("split = 'train'").drop("split"), t.filter("split = 'dev'").drop("split")
    out = None
    for a in NB_ALPHAS:
        lik, prior = tagging.nb_fit(train, a)
        x = tagging.overall(tagging.nb_tag_gold(dev, lik, prior)).select(F.lit(a).alias("alpha"), "accuracy")
        out = x if out is None else out.union(x)
    first = F.row_number().over(Window.orderBy(F.desc("accuracy"), F.desc("alpha"))) == 1  # five rows
    return out.withColumn("best", first)


def hmm_tune(spark, sf):
    """Accuracy on dev of three decoders for the grid of k, tokens in which the two
    directions differ, and the k of the greatest sum of accuracies (C12 O10)."""
    t = cut(tokens(spark, sf))
    train, dev = t.filter("split = 'train'").drop("split"), t.filter("split = 'dev'").drop("split")
    emit, unk = tagging.hmm_emissions(train)
    sentences, unk = cut(tagging.hmm_sentences(dev, emit, unk)), cut(unk)
    ways, out = ("forward", "backward", "posterior"), None
    for k in HMM_KS:
        runs = tagging.hmm_runs(sentences, tagging.hmm_transitions(train, k), unk, *ways)
        x = runs.agg(F.lit(k).alias("k"), *[F.round(F.avg((F.col("tag") == F.col(how)).cast("double")), 6).alias(how) for how in ways], F.count_if(F.col("forward") != F.col("backward")).alias("differ"))
        out = x if out is None else out.union(x)
    first = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("forward") + F.col("backward") + F.col("posterior"), 6)), "k")) == 1  # six rows
    return out.withColumn("best", first)


def hmm_transitions(spark, sf):
    t = tagging.hmm_transitions(_parts(spark, sf)[0], 0.1)
    return t.select("a", "b", "c", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"))


def hmm_emissions(spark, sf):
    emit, unk = tagging.hmm_emissions(_parts(spark, sf)[0])
    return emit.union(unk.select(F.lit("<UNK>").alias("word"), "tag", "p")).select("word", "tag", F.round("p", 6).alias("p"))


def _hmm(spark, sf, k=0.1):
    train, test = _parts(spark, sf)
    return test, tagging.hmm_transitions(train, k), *tagging.hmm_emissions(train)


def hmm_joint(spark, sf):
    j = tagging.hmm_joint(*_hmm(spark, sf))
    return j.select("sent", "tokens", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"))


def _decoded(how):
    def q(spark, sf):
        return tagging.hmm_decode(*_hmm(spark, sf), how).select("sent", "pos", "tag", "pred")

    return q


def tag_prf(spark, sf):
    s = tagging.per_class(_nb(spark, sf))
    return s.select("tag", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def tag_overall(spark, sf):
    return tagging.overall(_nb(spark, sf))


def tag_confusion(spark, sf):
    return tagging.confusion(_nb(spark, sf))


def top_confusions(spark, sf):
    """O5."""
    return tagging.confusion(_nb(spark, sf)).filter("tag <> pred").orderBy(F.desc("n"), "tag", "pred").limit(12)


def confusion_matrix(spark, sf):
    """The matrix itself (K9): a column for each predicted tag."""
    return _nb(spark, sf).groupBy("tag").pivot("pred").count().na.fill(0)


def known_accuracy(spark, sf):
    """Accuracy on words seen in training and on others (F16)."""
    train, test = _parts(spark, sf)
    pred = _nb(spark, sf).join(train.select("word").distinct().withColumn("known", F.lit(True)), "word", "left")
    return pred.groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("tokens"), F.round(F.avg((F.col("tag") == F.col("pred")).cast("double")), 6).alias("accuracy"))


def tag_agreement(spark, sf):
    """Agreement of the taggers two by two, and sentences in which they differ."""
    runs = {"nb_gold": _nb(spark, sf), "forward": _decoded("forward")(spark, sf), "posterior": _decoded("posterior")(spark, sf)}
    all_ = None
    for k, x in runs.items():
        y = x.select("sent", "pos", F.lit(k).alias("run"), "pred")
        all_ = y if all_ is None else all_.union(y)
    a, b = all_.toDF("sent", "pos", "a", "pa"), all_.toDF("sent", "pos", "b", "pb")
    same = a.join(b, ["sent", "pos"]).filter("a < b")
    per = same.groupBy("a", "b", "sent").agg(F.avg((F.col("pa") == F.col("pb")).cast("double")).alias("s"), F.count("*").alias("n"), F.bool_or(F.col("pa") != F.col("pb")).alias("differs"))
    return per.groupBy("a", "b").agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 6).alias("agreement"), F.count_if("differs").alias("sentences_apart"))


TOKENS_SQL = """
WITH tok AS (SELECT user_id AS sent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN value IS NULL THEN 'none' ELSE 'v' || floor(value / 5)::BIGINT END AS word, event_type AS tag,
  CASE WHEN user_id % 10 < 8 THEN 'train' WHEN user_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL),
feats AS (SELECT *, CASE WHEN len(word) > 4 THEN 'MORE' ELSE 'LESS' END AS f_len, lag(word, 1, '<s>') OVER w AS f_prev, lead(word, 1, '</s>') OVER w AS f_next, lag(tag, 1, '<s>') OVER w AS f_ptag FROM tok WINDOW w AS (PARTITION BY sent ORDER BY pos)),
melt AS (SELECT sent, pos, word, tag, split, unnest(['len', 'word', 'prev', 'next', 'ptag']) AS feature, unnest([f_len, word, f_prev, f_next, f_ptag]) AS value FROM feats),
tags AS (SELECT tag, count(*) AS n FROM tok WHERE split = 'train' GROUP BY tag)"""
NB_SQL = TOKENS_SQL + """,
cnt AS (SELECT feature, value, tag, count(*) AS c FROM melt WHERE split = 'train' GROUP BY ALL), kinds AS (SELECT DISTINCT feature, value FROM cnt), size AS (SELECT feature, count(*) AS vals FROM kinds GROUP BY feature),
lik AS (SELECT feature, value, tag, ln((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (vals + 1))) AS ll FROM kinds JOIN size USING (feature) CROSS JOIN tags LEFT JOIN cnt USING (feature, value, tag)),
uns AS (SELECT feature, tag, ln(0.1::DOUBLE / (n + 0.1::DOUBLE * (vals + 1))) AS unseen FROM size, tags),
score AS (SELECT m.sent, m.pos, m.word, m.tag, u.tag AS t, round(sum(coalesce(ll, unseen)) + any_value(ln(tags.n / (SELECT sum(n) FROM tags))), 9) AS s FROM melt m JOIN uns u ON u.feature = m.feature LEFT JOIN lik ON lik.feature = m.feature AND lik.value = m.value AND lik.tag = u.tag JOIN tags ON tags.tag = u.tag WHERE m.split = 'test' GROUP BY ALL),
pred AS (SELECT sent, pos, word, tag, t AS pred FROM score QUALIFY row_number() OVER (PARTITION BY sent, pos ORDER BY s DESC, t) = 1)"""
PRF_SQL = NB_SQL + """,
prf AS (SELECT t.tag, coalesce(tp, 0) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(g, 0) - coalesce(tp, 0) AS fn, coalesce(g, 0) AS support FROM (SELECT tag FROM pred UNION SELECT pred FROM pred) t
  LEFT JOIN (SELECT tag, count(*) FILTER (WHERE tag = pred) AS tp, count(*) AS g FROM pred GROUP BY tag) a USING (tag) LEFT JOIN (SELECT pred AS tag, count(*) AS p FROM pred GROUP BY pred) b USING (tag)),
f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM prf),
ff AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f)"""
CONF_SQL = NB_SQL + ", c AS (SELECT tag, pred, count(*) AS n FROM pred GROUP BY ALL), cs AS (SELECT *, round(n / sum(n) OVER (PARTITION BY tag), 6) AS share FROM c)"
HMM_SQL = TOKENS_SQL + """,
chain AS (SELECT lag(tag, 1, '<s>') OVER w AS a, tag AS b, lead(tag) OVER w IS NULL AS fin FROM tok WHERE split = 'train' WINDOW w AS (PARTITION BY sent ORDER BY pos)),
pc AS (SELECT a, b, count(*) AS c FROM (SELECT a, b FROM chain UNION ALL SELECT b, '</s>' FROM chain WHERE fin) GROUP BY ALL),
grid AS (SELECT a, b FROM (SELECT tag AS a FROM tags UNION SELECT '<s>'), (SELECT tag AS b FROM tags UNION SELECT '</s>')),
trans AS (SELECT a, b, coalesce(c, 0) AS c, (coalesce(c, 0) + 0.1::DOUBLE) / sum(coalesce(c, 0) + 0.1::DOUBLE) OVER (PARTITION BY a) AS forward, (coalesce(c, 0) + 0.1::DOUBLE) / sum(coalesce(c, 0) + 0.1::DOUBLE) OVER (PARTITION BY b) AS backward FROM grid LEFT JOIN pc USING (a, b)),
wt AS (SELECT word, tag, count(*) AS c FROM tok WHERE split = 'train' GROUP BY ALL), wn AS (SELECT word, sum(c) AS wn FROM wt GROUP BY word),
hx AS (SELECT tag, n, 0.5::DOUBLE + coalesce(h, 0) AS h FROM tags LEFT JOIN (SELECT tag, count(*) AS h FROM wt JOIN wn USING (word) WHERE wn = 1 GROUP BY tag) USING (tag)),
emit AS (SELECT word, tag, c / (n + h) AS p FROM wt JOIN hx USING (tag)), unk AS (SELECT tag, h / (n + h) AS p FROM hx),
le AS (SELECT t.word, unk.tag, CASE WHEN wn.word IS NULL THEN ln(unk.p) WHEN emit.p IS NULL THEN '-inf'::DOUBLE ELSE ln(emit.p) END AS le FROM (SELECT DISTINCT word FROM tok WHERE split = 'test') t CROSS JOIN unk LEFT JOIN wn ON wn.word = t.word LEFT JOIN emit ON emit.word = t.word AND emit.tag = unk.tag)"""
SQL = {
    "nb_fit": NB_SQL + " SELECT feature, value, tag, round(ll, 6) AS ll FROM lik",
    "nb_tag_gold": NB_SQL + " SELECT sent, pos, tag, pred FROM pred",
    "tag_prf": PRF_SQL + " SELECT tag, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ff",
    "tag_overall": PRF_SQL + " SELECT sum(support)::BIGINT AS tokens, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM ff",
    "tag_confusion": CONF_SQL + " SELECT tag, pred, n, share FROM cs",
    "top_confusions": CONF_SQL + " SELECT tag, pred, n, share FROM cs WHERE tag <> pred ORDER BY n DESC, tag, pred LIMIT 12",
    "known_accuracy": NB_SQL + " SELECT w.word IS NOT NULL AS known, count(*) AS tokens, round(avg((tag = pred)::INT), 6) AS accuracy FROM pred LEFT JOIN (SELECT DISTINCT word FROM tok WHERE split = 'train') w USING (word) GROUP BY 1",
    "hmm_transitions": HMM_SQL + " SELECT a, b, c, round(forward, 6) AS forward, round(backward, 6) AS backward FROM trans",
    "hmm_emissions": HMM_SQL + " SELECT word, tag, round(p, 6) AS p FROM emit UNION ALL SELECT '<UNK>', tag, round(p, 6) FROM unk",
    "hmm_joint": HMM_SQL + """, r AS (SELECT sent, word, tag, lag(tag, 1, '<s>') OVER w AS a, lead(tag) OVER w IS NULL AS fin FROM tok WHERE split = 'test' WINDOW w AS (PARTITION BY sent ORDER BY pos))
      SELECT sent, count(*) AS tokens, round(sum(le + ln(x.forward) + CASE WHEN fin THEN ln(y.forward) ELSE 0 END), 6) AS forward, round(sum(le + ln(x.backward) + CASE WHEN fin THEN ln(y.backward) ELSE 0 END), 6) AS backward
      FROM r JOIN le USING (word, tag) JOIN trans x ON x.a = r.a AND x.b = r.tag JOIN trans y ON y.a = r.tag AND y.b = '</s>' GROUP BY sent""",
    "viterbi_forward": HMM_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
      test AS (SELECT sent, pos, word, tag, count(*) OVER (PARTITION BY sent) AS n FROM tok WHERE split = 'test'),
      v AS (SELECT sent, pos, n, le.tag AS t, ln(x.forward) + le AS s, [le.tag] AS path FROM test JOIN le USING (word) JOIN trans x ON x.a = '<s>' AND x.b = le.tag WHERE pos = 1
        UNION ALL SELECT sent, pos, n, t, s + le AS s, list_append(path, t) FROM (SELECT v.sent, v.pos + 1 AS pos, v.n, x.b AS t, max(v.s + ln(x.forward)) AS s, arg_max(v.path, v.s + ln(x.forward)) AS path, any_value(test.word) AS word FROM v JOIN trans x ON x.a = v.t AND x.b <> '</s>' JOIN test ON test.sent = v.sent AND test.pos = v.pos + 1 GROUP BY v.sent, v.pos, v.n, x.b) q JOIN le ON le.word = q.word AND le.tag = q.t),
      fin AS (SELECT sent, arg_max(path, s + ln(x.forward)) AS path FROM v JOIN trans x ON x.a = v.t AND x.b = '</s>' WHERE pos = n GROUP BY sent)
      SELECT sent, pos, tag, path[pos] AS pred FROM test JOIN fin USING (sent)""",
}
_TUNE = lambda a: NB_SQL.replace("0.1::DOUBLE", f"{a}::DOUBLE").replace("m.split = 'test'", "m.split = 'dev'")
SQL["nb_tune"] = "WITH " + ", ".join(f"a{i} AS ({_TUNE(a)} SELECT {a}::DOUBLE AS alpha, round(avg((tag = pred)::INT), 6) AS accuracy FROM pred)" for i, a in enumerate(NB_ALPHAS)) + " SELECT *, row_number() OVER (ORDER BY accuracy DESC, alpha DESC) = 1 AS best FROM (" + " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(len(NB_ALPHAS))) + ")"
SQL["confusion_matrix"] = NB_SQL + " SELECT * FROM (PIVOT (SELECT tag, pred FROM pred) ON pred USING count(*) GROUP BY tag)"
#: The path of the words read backwards, each tag given the next one.
SQL["viterbi_backward"] = HMM_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
      test AS (SELECT sent, pos, word, tag, count(*) OVER (PARTITION BY sent) AS n FROM tok WHERE split = 'test'),
      v AS (SELECT sent, pos, le.tag AS t, ln(x.backward) + le AS s, [le.tag] AS path FROM test JOIN le USING (word) JOIN trans x ON x.b = '</s>' AND x.a = le.tag WHERE pos = n
        UNION ALL SELECT sent, pos, t, s + le AS s, list_prepend(t, path) FROM (SELECT v.sent, v.pos - 1 AS pos, x.a AS t, max(v.s + ln(x.backward)) AS s, arg_max(v.path, v.s + ln(x.backward)) AS path, any_value(test.word) AS word FROM v JOIN trans x ON x.b = v.t AND x.a <> '<s>' JOIN test ON test.sent = v.sent AND test.pos = v.pos - 1 GROUP BY v.sent, v.pos, x.a) q JOIN le ON le.word = q.word AND le.tag = q.t),
      fin AS (SELECT sent, arg_max(path, s + ln(x.backward)) AS path FROM v JOIN trans x ON x.b = v.t AND x.a = '<s>' WHERE pos = 1 GROUP BY sent)
      SELECT sent, pos, tag, path[pos] AS pred FROM test JOIN fin USING (sent)"""
#: What leads to and from every tag at every place: in sum (posterior) or at most.
_SIDES = lambda fold: HMM_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
      test AS (SELECT sent, pos, word, tag, count(*) OVER (PARTITION BY sent) AS n FROM tok WHERE split = 'test'),
      al AS (SELECT sent, pos, le.tag AS t, ln(x.forward) + le AS s FROM test JOIN le USING (word) JOIN trans x ON x.a = '<s>' AND x.b = le.tag WHERE pos = 1
        UNION ALL SELECT q.sent, q.pos, q.t, {fold} + any_value(le) FROM (SELECT al.sent, al.pos + 1 AS pos, x.b AS t, al.s + ln(x.forward) AS y, test.word, max(al.s + ln(x.forward)) OVER (PARTITION BY al.sent, al.pos, x.b) AS top FROM al JOIN trans x ON x.a = al.t AND x.b <> '</s>' JOIN test ON test.sent = al.sent AND test.pos = al.pos + 1) q JOIN le ON le.word = q.word AND le.tag = q.t GROUP BY q.sent, q.pos, q.t),
      be AS (SELECT sent, pos, x.a AS t, ln(x.forward) AS s FROM test JOIN trans x ON x.b = '</s>' AND x.a <> '<s>' WHERE pos = n
        UNION ALL SELECT q.sent, q.pos, q.t, {fold} FROM (SELECT be.sent, be.pos - 1 AS pos, x.a AS t, be.s + ln(x.forward) + le.le AS y, max(be.s + ln(x.forward) + le.le) OVER (PARTITION BY be.sent, be.pos, x.a) AS top FROM be JOIN test ON test.sent = be.sent AND test.pos = be.pos JOIN le ON le.word = test.word AND le.tag = be.t JOIN trans x ON x.b = be.t AND x.a <> '<s>' WHERE be.pos > 1) q GROUP BY q.sent, q.pos, q.t),
      best AS (SELECT sent, pos, al.t AS pred FROM al JOIN be USING (sent, pos, t) QUALIFY row_number() OVER (PARTITION BY sent, pos ORDER BY round(al.s + be.s, 9) DESC, al.t) = 1)
      SELECT sent, pos, tag, pred FROM test JOIN best USING (sent, pos)"""  # noqa: E731
SQL["hmm_posterior"] = _SIDES("any_value(top) + ln(sum(CASE WHEN top = '-inf'::DOUBLE THEN 1 ELSE exp(y - top) END))")
SQL["hmm_max_marginal"] = _SIDES("any_value(top)")
SQL["nb_tag_greedy"] = NB_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
      fixed AS (SELECT m.sent, m.pos, u.tag AS t, sum(coalesce(ll, unseen)) + any_value(ln(tags.n / (SELECT sum(n) FROM tags))) AS s FROM melt m JOIN uns u ON u.feature = m.feature LEFT JOIN lik ON lik.feature = m.feature AND lik.value = m.value AND lik.tag = u.tag JOIN tags ON tags.tag = u.tag WHERE m.split = 'test' AND m.feature <> 'ptag' GROUP BY ALL),
      walk AS (SELECT sent, 1::BIGINT AS pos, arg_min(t, (-round(s, 9), t)) AS prev FROM (SELECT f.sent, f.t, f.s + coalesce(ll, unseen) AS s FROM fixed f JOIN uns ON uns.feature = 'ptag' AND uns.tag = f.t LEFT JOIN lik ON lik.feature = 'ptag' AND lik.value = '<s>' AND lik.tag = f.t WHERE pos = 1) GROUP BY sent
        UNION ALL SELECT sent, pos, arg_min(t, (-round(s, 9), t)) FROM (SELECT f.sent, f.pos, f.t, f.s + coalesce(ll, unseen) AS s FROM walk JOIN fixed f ON f.sent = walk.sent AND f.pos = walk.pos + 1 JOIN uns ON uns.feature = 'ptag' AND uns.tag = f.t LEFT JOIN lik ON lik.feature = 'ptag' AND lik.value = walk.prev AND lik.tag = f.t) GROUP BY sent, pos)
      SELECT tok.sent, tok.pos, tok.tag, prev AS pred FROM tok JOIN walk USING (sent, pos)"""
SQL["tag_agreement"] = "WITH runs AS (" + " UNION ALL ".join(f"SELECT '{run}' AS run, sent, pos, pred FROM ({SQL[q]}) q{i}" for i, (run, q) in enumerate((("nb_gold", "nb_tag_gold"), ("forward", "viterbi_forward"), ("posterior", "hmm_posterior")))) + """),
      per AS (SELECT x.run AS a, y.run AS b, sent, avg((x.pred = y.pred)::INT) AS s, count(*) AS n, bool_or(x.pred <> y.pred) AS differs FROM runs x JOIN runs y USING (sent, pos) WHERE x.run < y.run GROUP BY ALL)
      SELECT a, b, round(sum(s * n) / sum(n), 6) AS agreement, count(*) FILTER (WHERE differs) AS sentences_apart FROM per GROUP BY a, b"""
QUERIES = {f.__name__: f for f in (nb_fit, nb_tag_gold, nb_tag_greedy, nb_tune, hmm_tune, hmm_transitions, hmm_emissions, hmm_joint, tag_prf, tag_overall, tag_confusion, top_confusions, confusion_matrix, known_accuracy, tag_agreement)}
QUERIES |= {"viterbi_forward": _decoded("forward"), "viterbi_backward": _decoded("backward"), "hmm_posterior": _decoded("posterior"), "hmm_max_marginal": _decoded("max_marginal")}
