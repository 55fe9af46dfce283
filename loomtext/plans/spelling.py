"""Queries on spelling correction, over spell_results."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomtext.functions.lineage import cut
from loomtext.operators import spell
from loomtext.sources.tables import table

P_ERR = 0.05


def spell_pairs(spark, sf):
    """S13 G26."""
    rows = table(spark, sf, "spell_results").filter("correct is not null and typo is not null").select("pair_id", "correct", "typo", "weight", "line").distinct()
    return spell.pairs_of(rows)


def _vocab(spark, sf):
    """Correct words with their weights stand for the word counts."""
    return spell_pairs(spark, sf).groupBy(F.col("correct").alias("word")).agg(F.sum("weight").alias("n"))


def _typos(spark, sf):
    return spell_pairs(spark, sf).select("typo").distinct()


def _cands(spark, sf):
    return spell.candidates(_typos(spark, sf), _vocab(spark, sf))


def spell_candidates_d1(spark, sf):
    """P2 P3 J14."""
    return _cands(spark, sf).select("typo", "cand", F.coalesce(F.try_element_at("edits", F.lit(1)), F.lit("")).alias("edit"))


def spell_candidates_d2(spark, sf):
    """P1 P2 at two edits."""
    c = spell.candidates_within(_typos(spark, sf), _vocab(spark, sf), 2)
    return c.groupBy("typo", "cand").agg(F.count("*").alias("sequences"), F.min(F.size("edits")).alias("edits"))


def spell_edit_counts(spark, sf):
    """P9 S12."""
    return spell.edit_counts(spell_pairs(spark, sf))


def spell_context_counts(spark, sf):
    """G25."""
    return spell.context_counts(_vocab(spark, sf))


def _scored(spark, sf, p_err: Column, by_context: bool = False):
    """Candidates in both settings and all modes with their score, rounded so that
    ties are ties everywhere."""
    v = _vocab(spark, sf)
    ch = spell.channel(spell.candidates(_typos(spark, sf), v), spell_edit_counts(spark, sf), spell.context_counts(v) if by_context else None)
    total = v.agg(F.sum("n").alias("_n"))
    lc = F.when(F.col("identity"), F.log(1 - p_err)).otherwise(F.log(p_err) + F.col("lp"))
    prior = F.log(F.col("n") / F.col("_n"))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.round(s, 9).alias("score")) for m, s in (("prior", prior), ("channel", lc), ("noisy", prior + lc))])
    rows = ch.crossJoin(F.broadcast(total)).select("typo", "cand", "identity", F.explode(modes).alias("x")).select("typo", "cand", "identity", "x.*")
    settings = F.when(F.col("identity"), F.array(F.lit("open"))).otherwise(F.array(F.lit("open"), F.lit("detected")))
    return rows.withColumn("setting", F.explode(settings))


def _ranked(rows, *by):
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("typo", "setting", "mode", *by).orderBy(F.desc("score"), "cand")))


def spell_rank(spark, sf):
    """The five best candidates."""
    return _ranked(_scored(spark, sf, F.lit(P_ERR))).filter("rank <= 5").select("typo", "setting", "mode", "rank", "cand", F.round("score", 6).alias("score"))


def _hits(spark, sf, ranked, *by):
    """Every pair with the rank of its correct word, null where it isn't found."""
    pairs = spell_pairs(spark, sf)
    grid = ranked.select("setting", "mode", *by).distinct()
    found = ranked.select("typo", F.col("cand").alias("correct"), "setting", "mode", "rank", *by)
    return pairs.crossJoin(F.broadcast(grid)).join(found, ["typo", "correct", "setting", "mode", *by], "left")  # the grid has a few rows


def _accuracy(k: int = 1) -> dict[str, Column]:
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return {"accuracy": F.round(F.avg(hit.cast("double")), 6), "token_accuracy": F.round(F.sum(F.when(hit, F.col("weight")).otherwise(0)) / F.sum("weight"), 6)}


def spell_score(spark, sf):
    """G28 P11 over settings and modes."""
    h = _hits(spark, sf, _ranked(_scored(spark, sf, F.lit(P_ERR))))
    return h.groupBy("setting", "mode").agg(F.count("*").alias("pairs"), *[c.alias(k) for k, c in _accuracy().items()])


def spell_score_conditional(spark, sf):
    """The same with edits conditional on their correct side."""
    h = _hits(spark, sf, _ranked(_scored(spark, sf, F.lit(P_ERR), True)))
    return h.groupBy("setting", "mode").agg(F.count("*").alias("pairs"), *[c.alias(k) for k, c in _accuracy().items()])


def spell_topk(spark, sf):
    """Hits among the first 1, 3 and 5."""
    h = _hits(spark, sf, _ranked(_scored(spark, sf, F.lit(P_ERR)))).filter("mode = 'noisy'")
    return h.groupBy("setting").agg(*[F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6).alias(f"top{k}") for k in (1, 3, 5)])


def spell_oracle(spark, sf):
    """Pairs whose correct word is reachable at all."""
    c = _cands(spark, sf).select("typo", F.col("cand").alias("correct")).distinct().withColumn("there", F.lit(True))
    return spell_pairs(spark, sf).join(c, ["typo", "correct"], "left").agg(F.count("*").alias("pairs"), F.round(F.avg(F.coalesce(F.col("there"), F.lit(False)).cast("double")), 6).alias("reachable"))


def spell_breakdown(spark, sf):
    """Accuracy of groups that overlap: in the vocabulary or not, reachable, all."""
    h = _hits(spark, sf, _ranked(_scored(spark, sf, F.lit(P_ERR)))).filter("setting = 'detected' and mode = 'noisy'")
    known = _vocab(spark, sf).select(F.col("word").alias("typo"), F.lit(True).alias("known"))
    h = h.join(known, "typo", "left")
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("known"), "word").otherwise("non-word"), F.when(F.col("rank").isNotNull(), "reachable"), F.when(F.col("rank").isNotNull() & F.col("known").isNull(), "classic")))
    return h.withColumn("part", F.explode(groups)).groupBy("part").agg(F.count("*").alias("pairs"), *[c.alias(k) for k, c in _accuracy().items()])


P_ERRS = [0.0001, 0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.9, 0.99]


def perr_sweep(spark, sf):
    """Accuracy in the open setting for each probability of an error."""
    v = _vocab(spark, sf)
    ch = spell.channel(spell.candidates(_typos(spark, sf), v), spell_edit_counts(spark, sf))
    total = v.agg(F.sum("n").alias("_n"))
    rows = ch.crossJoin(F.broadcast(total)).withColumn("p_err", F.explode(F.array(*map(F.lit, P_ERRS))))
    score = F.log(F.col("n") / F.col("_n")) + F.when(F.col("identity"), F.log(1 - F.col("p_err"))).otherwise(F.log("p_err") + F.col("lp"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("typo", "p_err").orderBy(F.desc(F.round(score, 9)), "cand"))).filter("rank = 1")
    grid = spell_pairs(spark, sf).withColumn("p_err", F.explode(F.array(*map(F.lit, P_ERRS))))
    h = grid.join(ranked.select("typo", "p_err", F.col("cand").alias("correct"), "rank"), ["typo", "p_err", "correct"], "left")
    return h.groupBy("p_err").agg(*[c.alias(k) for k, c in _accuracy().items()])


FOLDS = 5


def spell_cv(spark, sf):
    """Five folds by line, the edit counts of each taken from the other four."""
    pairs = spell_pairs(spark, sf).withColumn("fold", F.pmod("line", F.lit(FOLDS)).cast("int"))
    v = _vocab(spark, sf)
    own = spell.edit_counts(pairs, "fold")
    folds = spark.range(FOLDS).select(F.col("id").cast("int").alias("test"))
    others = own.join(F.broadcast(folds), F.col("fold") != F.col("test")).groupBy("edit", F.col("test").alias("fold")).agg(F.sum("c").alias("c"))
    ch = spell.channel(spell.candidates(_typos(spark, sf), v), others, None, "fold").filter("not identity")
    total = v.agg(F.sum("n").alias("_n"))
    score = F.round(F.log(F.col("n") / F.col("_n")) + F.col("lp"), 9)
    ranked = ch.crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(Window.partitionBy("typo", "fold").orderBy(F.desc(score), "cand"))).filter("rank = 1")
    h = pairs.join(ranked.select("typo", "fold", F.col("cand").alias("correct"), "rank"), ["typo", "fold", "correct"], "left")
    per = h.groupBy("fold").agg(F.count("*").alias("pairs"), F.avg(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("double")).alias("a"))
    return per.select("fold", "pairs", F.round("a", 6).alias("accuracy"))


MODES = ("prior", "channel", "noisy_joint", "noisy_conditional")


def _within(spark, sf, distance: int):
    """Candidates up to a distance with all their edit sequences, each sequence once."""
    if distance == 1:
        return spell.candidates(_typos(spark, sf), _vocab(spark, sf))
    return spell.candidates_within(_typos(spark, sf), _vocab(spark, sf), distance)


def _channels(spark, sf):
    """(distance, typo, cand, n, identity, joint, conditional, prior) for one and two edits."""
    v = _vocab(spark, sf)
    counts, contexts, total = cut(spell_edit_counts(spark, sf)), spell.context_counts(v), v.agg(F.sum("n").alias("_n"))
    out = None
    for d in (1, 2):
        c = cut(_within(spark, sf, d))
        joint = spell.channel(c, counts, most=d).withColumnRenamed("lp", "joint")
        conditional = spell.channel(c, counts, contexts, most=d).select("typo", "cand", F.col("lp").alias("conditional"))
        x = joint.join(conditional, ["typo", "cand"]).withColumn("distance", F.lit(d))
        out = x if out is None else out.unionByName(x)
    return out.crossJoin(F.broadcast(total)).withColumn("prior", F.log(F.col("n") / F.col("_n"))).drop("_n")


def _grid_ranked(spark, sf):
    """Ranks of all candidates in the sixteen cells of setting, distance and mode."""
    no_error, error = F.log(F.lit(1 - P_ERR)), F.log(F.lit(P_ERR))
    joint, conditional = (F.when(F.col("identity"), no_error).otherwise(error + F.col(c)) for c in ("joint", "conditional"))
    scores = (F.col("prior"), joint, F.col("prior") + joint, F.col("prior") + conditional)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.round(s, 9).alias("score")) for m, s in zip(MODES, scores, strict=True)])
    settings = F.when(F.col("identity"), F.array(F.lit("open"))).otherwise(F.array(F.lit("open"), F.lit("detected")))
    rows = _channels(spark, sf).select("distance", "typo", "cand", F.explode(settings).alias("setting"), modes.alias("m")).select("distance", "typo", "cand", "setting", F.inline("m"))
    return _ranked(rows, "distance")


def spell_grid(spark, sf):
    """Two settings, two distances and four modes, with hits among the
    first three and five."""
    h = _hits(spark, sf, cut(_grid_ranked(spark, sf)), "distance")
    tops = [F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6).alias(f"top{k}") for k in (3, 5)]
    return h.groupBy("setting", "distance", "mode").agg(F.count("*").alias("pairs"), *[c.alias(k) for k, c in _accuracy().items()], *tops)


def spell_reach(spark, sf):
    """Pairs whose correct word is reachable within one and two edits."""
    pairs, out = spell_pairs(spark, sf), None
    for d in (1, 2):
        there = _within(spark, sf, d).select("typo", F.col("cand").alias("correct")).distinct().withColumn("there", F.lit(True))
        x = pairs.join(there, ["typo", "correct"], "left").agg(F.lit(d).alias("distance"), F.count("*").alias("pairs"), F.round(F.avg(F.coalesce(F.col("there"), F.lit(False)).cast("double")), 6).alias("reachable"))
        out = x if out is None else out.union(x)
    return out


def perr_grid(spark, sf):
    """Accuracy in the open setting for ten probabilities of an error, two
    distances and both channels."""
    rows = cut(_channels(spark, sf)).select("distance", "typo", "cand", "identity", "prior", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("lp")) for c in ("joint", "conditional")])))
    rows = rows.withColumn("p_err", F.explode(F.array(*map(F.lit, P_ERRS))))
    score = F.round(F.col("prior") + F.when(F.col("identity"), F.log(1 - F.col("p_err"))).otherwise(F.log("p_err") + F.col("lp")), 9)
    best = rows.groupBy("distance", "channel", "p_err", "typo").agg(F.min(F.struct((-score).alias("s"), "cand")).alias("m")).select("distance", "channel", "p_err", "typo", F.col("m.cand").alias("correct"), F.lit(1).alias("rank"))
    grid = spark.createDataFrame([(d, c, p) for d in (1, 2) for c in ("joint", "conditional") for p in P_ERRS], "distance int, channel string, p_err double")
    h = spell_pairs(spark, sf).crossJoin(F.broadcast(grid)).join(best, ["typo", "correct", "distance", "channel", "p_err"], "left")
    return h.groupBy("distance", "channel", "p_err").agg(*[c.alias(k) for k, c in _accuracy().items()])


def spell_cv_grid(spark, sf):
    """Mean accuracy over five folds by line, with the edit counts of all pairs
    one edit apart, and with those of the other folds' alignments of up to two."""
    pairs = cut(spell_pairs(spark, sf).withColumn("fold", F.pmod("line", F.lit(FOLDS)).cast("int")))
    v = _vocab(spark, sf)
    total, contexts = v.agg(F.sum("n").alias("_n")), spell.context_counts(v)
    folds = spark.range(FOLDS).select(F.col("id").cast("int").alias("fold"))
    two = cut(_within(spark, sf, 2))
    own = cut(spell.aligned_counts(pairs, two, "fold"))
    others = own.withColumnRenamed("fold", "own").join(F.broadcast(folds), F.col("own") != F.col("fold")).groupBy("edit", "fold").agg(F.sum("c").alias("c"))
    every = spell_edit_counts(spark, sf).crossJoin(F.broadcast(folds))
    out = None
    for source, counts in (("all", cut(every)), ("held_out", cut(others))):
        for d, cands in ((1, _within(spark, sf, 1)), (2, two)):
            for name, ctx in (("joint", None), ("conditional", contexts)):
                ch = spell.channel(cands, counts, ctx, "fold", most=d).filter("not identity").crossJoin(F.broadcast(total))
                score = F.round(F.log(F.col("n") / F.col("_n")) + F.col("lp"), 9)
                best = ch.groupBy("typo", "fold").agg(F.min(F.struct((-score).alias("s"), "cand")).alias("m")).select("typo", "fold", F.col("m.cand").alias("correct"), F.lit(True).alias("hit"))
                per = pairs.join(best, ["typo", "fold", "correct"], "left").groupBy("fold").agg(F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("double")).alias("a"))
                x = per.agg(F.lit(source).alias("source"), F.lit(d).alias("distance"), F.lit(name).alias("channel"), F.round(F.avg("a"), 6).alias("accuracy"))
                out = x if out is None else out.union(x)
    return out


def edit_direction(spark, sf):
    """Correlation of the counts of insertions and deletions in even and odd lines,
    with the sides as they are and exchanged (P10 G30 F18)."""
    pairs = spell_pairs(spark, sf)
    a = spell.edit_counts(pairs.filter("pmod(line, 2) = 0")).withColumnRenamed("c", "x")
    b = spell.edit_counts(pairs.filter("pmod(line, 2) = 1")).withColumnRenamed("c", "y")
    left, right = F.split_part("edit", F.lit("|"), F.lit(1)), F.split_part("edit", F.lit("|"), F.lit(2))
    a = a.filter(F.length(left) != F.length(right))
    out = None
    for name, e in (("typo|correct", F.col("edit")), ("correct|typo", F.concat(right, F.lit("|"), left))):
        x = a.select(e.alias("edit"), "x").join(b, "edit", "left").na.fill(0, ["y"]).agg(F.lit(name).alias("reading"), F.count("*").alias("edits"), F.count_if(F.col("y") == 0).alias("missing"), F.round(F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), F.lit(0.0)), 6).alias("r"))
        out = x if out is None else out.union(x)
    return out


def spell_distances(spark, sf):
    """Pairs by edit distance, four and more together."""
    return spell_pairs(spark, sf).withColumn("d", F.least(spell.osa_distance("correct", "typo"), F.lit(4))).groupBy("d").agg(F.count("*").alias("pairs"), F.sum("weight").alias("tokens"))


def spell_examples(spark, sf):
    """Four hundred pairs by the hash of their words, with the best candidate."""
    best = _ranked(_scored(spark, sf, F.lit(P_ERR))).filter("rank = 1 and setting = 'detected' and mode = 'noisy'").select("typo", F.col("cand").alias("guess"))
    some = spell_pairs(spark, sf).orderBy(F.md5(F.concat("correct", F.lit(":"), "typo"))).limit(400)
    return some.join(best, "typo", "left").select("correct", "typo", "guess")


_WORD = lambda c: f"replace(lower(regexp_replace(trim({c}), '\\*[0-9]+$', '')), '_', ' ')"
PAIRS_SQL = f"""
WITH r AS (SELECT DISTINCT pair_id, correct, typo, weight, line FROM spell_results WHERE correct IS NOT NULL AND typo IS NOT NULL),
c AS (SELECT {_WORD('correct')} AS correct, {_WORD('typo')} AS typo, coalesce(weight, 1) * coalesce(nullif(regexp_extract(trim(typo), '\\*([0-9]+)$', 1), '')::BIGINT, 1) AS w, coalesce(line, -1) AS l FROM r),
pairs AS (SELECT correct, typo, sum(w)::BIGINT AS weight, min(l) AS line FROM c WHERE correct <> '' AND typo <> '' AND correct <> typo GROUP BY ALL),
vocab AS (SELECT correct AS word, sum(weight)::BIGINT AS n FROM pairs GROUP BY 1), typos AS (SELECT DISTINCT typo FROM pairs),
sp AS (SELECT typo, substr(typo, 1, i) AS hd, substr(typo, i + 1) AS tl FROM (SELECT typo, unnest(range(0, len(typo) + 1)) AS i FROM typos)),
ok AS (SELECT *, CASE WHEN hd = '' THEN '>' ELSE right(hd, 1) END AS p, substr(tl, 1, 1) AS t0, substr(tl, 2, 1) AS t1 FROM sp WHERE regexp_full_match(hd, '[a-z]*')),
abc AS (SELECT unnest(string_split('{spell.ALPHABET}', '')) AS x),
edits AS (SELECT DISTINCT * FROM (SELECT typo, hd || x || tl AS cand, p || '|' || p || x AS label FROM ok, abc
  UNION ALL SELECT typo, hd || x || substr(tl, 2), t0 || '|' || x FROM ok, abc WHERE tl <> '' AND x <> t0
  UNION ALL SELECT typo, hd || substr(tl, 2), p || t0 || '|' || p FROM ok WHERE tl <> ''
  UNION ALL SELECT typo, hd || t1 || t0 || substr(tl, 3), t0 || t1 || '|' || t1 || t0 FROM ok WHERE len(tl) >= 2 AND t0 <> t1)),
cands AS (SELECT typo, cand, n, label FROM edits JOIN vocab ON word = cand UNION ALL SELECT typo, typo, n, NULL FROM typos JOIN vocab ON word = typo),
least_label AS (SELECT typo, correct, weight, line, min(label) AS edit FROM pairs JOIN edits USING (typo) WHERE cand = correct GROUP BY ALL),
ec AS (SELECT edit, sum(weight)::BIGINT AS c FROM least_label GROUP BY edit)"""
CTX_SQL = """, sx AS (SELECT '>' || word AS s, n FROM vocab), cx AS (SELECT n, s, unnest(range(1, len(s) + 1)) AS i FROM sx),
ctx AS (SELECT ctx, sum(n)::BIGINT AS cc FROM (SELECT n, substr(s, i, 1) AS ctx FROM cx UNION ALL SELECT n, substr(s, i, 2) FROM cx WHERE i < len(s)) GROUP BY ctx)"""


def _rank_sql(le: str, more: str = "", join: str = "") -> str:
    return PAIRS_SQL + more + f""",
ch AS (SELECT typo, cand, n, label IS NULL AS identity, max(CASE WHEN label IS NULL THEN 0 ELSE {le} END) AS lp FROM cands LEFT JOIN ec ON ec.edit = cands.label {join} GROUP BY ALL),
lc AS (SELECT *, ln(n / (SELECT sum(n) FROM vocab)) AS prior, CASE WHEN identity THEN ln(1 - {P_ERR}::DOUBLE) ELSE ln({P_ERR}::DOUBLE) + lp END AS lc FROM ch),
sc AS (SELECT typo, cand, identity, unnest(['prior', 'channel', 'noisy']) AS mode, round(unnest([prior, lc, prior + lc]), 9) AS score FROM lc),
st AS (SELECT *, 'open' AS setting FROM sc UNION ALL SELECT *, 'detected' FROM sc WHERE NOT identity),
ranked AS (SELECT *, row_number() OVER (PARTITION BY typo, setting, mode ORDER BY score DESC, cand) AS rank FROM st),
hits AS (SELECT p.*, g.setting, g.mode, r.rank FROM pairs p CROSS JOIN (SELECT DISTINCT setting, mode FROM ranked) g LEFT JOIN ranked r ON r.typo = p.typo AND r.cand = p.correct AND r.setting = g.setting AND r.mode = g.mode)"""


#: Sequences of one and two edits: the second edit follows the first, and what is kept
#: before it is the beginning of a word.
TWO_SQL = PAIRS_SQL + """,
pre AS (SELECT DISTINCT substr(word, 1, i) AS h FROM (SELECT word, unnest(range(0, len(word) + 1)) AS i FROM vocab)),
one AS (SELECT DISTINCT * FROM (SELECT typo, hd || x AS h, tl AS t, p || '|' || p || x AS l FROM ok, abc
  UNION ALL SELECT typo, hd || x, substr(tl, 2), t0 || '|' || x FROM ok, abc WHERE tl <> '' AND x <> t0
  UNION ALL SELECT typo, hd, substr(tl, 2), p || t0 || '|' || p FROM ok WHERE tl <> ''
  UNION ALL SELECT typo, hd || t1, t0 || substr(tl, 3), t0 || t1 || '|' || t1 || t0 FROM ok WHERE len(tl) >= 2 AND t0 <> t1) SEMI JOIN pre USING (h)),
sp2 AS (SELECT typo, l, h || substr(t, 1, i) AS hd, substr(t, i + 1) AS tl FROM (SELECT *, unnest(range(0, len(t) + 1)) AS i FROM one)),
ok2 AS (SELECT *, CASE WHEN hd = '' THEN '>' ELSE right(hd, 1) END AS p, substr(tl, 1, 1) AS t0, substr(tl, 2, 1) AS t1 FROM sp2 SEMI JOIN pre ON pre.h = sp2.hd WHERE regexp_full_match(hd, '[a-z]*')),
two AS (SELECT typo, hd || x AS h, tl AS t, l, p || '|' || p || x AS l2 FROM ok2, abc
  UNION ALL SELECT typo, hd || x, substr(tl, 2), l, t0 || '|' || x FROM ok2, abc WHERE tl <> '' AND x <> t0
  UNION ALL SELECT typo, hd, substr(tl, 2), l, p || t0 || '|' || p FROM ok2 WHERE tl <> ''
  UNION ALL SELECT typo, hd || t1, t0 || substr(tl, 3), l, t0 || t1 || '|' || t1 || t0 FROM ok2 WHERE len(tl) >= 2 AND t0 <> t1),
seqs AS (SELECT 1 AS distance, typo, cand, n, CASE WHEN label IS NULL THEN []::VARCHAR[] ELSE [label] END AS edits FROM cands
  UNION ALL SELECT 2, typo, cand, n, CASE WHEN label IS NULL THEN []::VARCHAR[] ELSE [label] END FROM cands
  UNION ALL SELECT DISTINCT 2, typo, word, n, [l, l2] FROM two JOIN vocab ON word = h || t)"""


def _channels_sql(counts: str = "SELECT 0 AS fold, edit, c FROM ec") -> str:
    """ch: distance, fold, typo, cand, n, identity, joint, conditional."""
    return CTX_SQL + f""", fe AS ({counts}), ft AS (SELECT fold, sum(c) AS total FROM fe GROUP BY fold),
labels AS (SELECT DISTINCT unnest(edits) AS edit FROM seqs),
le AS (SELECT ft.fold, labels.edit, ln(coalesce(c, 0.5)::DOUBLE / total) AS lj, ln(coalesce(c, 0.5)::DOUBLE / greatest(coalesce(cc, 0), 1)) AS lc FROM labels CROSS JOIN ft LEFT JOIN fe ON fe.edit = labels.edit AND fe.fold = ft.fold LEFT JOIN ctx ON ctx.ctx = split_part(labels.edit, '|', 2)),
ways AS (SELECT distance, ft.fold, typo, cand, n, len(edits) = 0 AS same, coalesce(a.lj, 0) + coalesce(b.lj, 0) AS lj, coalesce(a.lc, 0) + coalesce(b.lc, 0) AS lc FROM seqs CROSS JOIN ft LEFT JOIN le a ON a.edit = edits[1] AND a.fold = ft.fold LEFT JOIN le b ON b.edit = edits[2] AND b.fold = ft.fold),
ch AS (SELECT distance, fold, typo, cand, n, bool_or(same) AS identity, max(lj) AS joint, max(lc) AS conditional, ln(n / (SELECT sum(n) FROM vocab)) AS prior FROM ways GROUP BY ALL)"""


_JOINT = "ln(coalesce(c, 0.5)::DOUBLE / (SELECT sum(c) FROM ec))"
RANK_SQL = _rank_sql(_JOINT)
_ACC = "round(avg(coalesce(rank <= 1, false)::INT), 6) AS accuracy, round(sum(CASE WHEN rank <= 1 THEN weight ELSE 0 END) / sum(weight), 6) AS token_accuracy"
SQL = {
    "spell_pairs": PAIRS_SQL + " SELECT correct, typo, weight, line FROM pairs",
    "spell_candidates_d1": PAIRS_SQL + " SELECT typo, cand, coalesce(label, '') AS edit FROM cands",
    "spell_edit_counts": PAIRS_SQL + " SELECT edit, c FROM ec",
    "spell_context_counts": PAIRS_SQL + CTX_SQL + " SELECT ctx, cc FROM ctx",
    "spell_rank": RANK_SQL + " SELECT typo, setting, mode, rank, cand, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "spell_score": RANK_SQL + f" SELECT setting, mode, count(*) AS pairs, {_ACC} FROM hits GROUP BY setting, mode",
    "spell_score_conditional": _rank_sql("ln(coalesce(c, 0.5)::DOUBLE / greatest(coalesce(cc, 0), 1))", CTX_SQL, "LEFT JOIN ctx ON ctx.ctx = split_part(cands.label, '|', 2)") + f" SELECT setting, mode, count(*) AS pairs, {_ACC} FROM hits GROUP BY setting, mode",
    "spell_topk": RANK_SQL + " SELECT setting, " + ", ".join(f"round(avg(coalesce(rank <= {k}, false)::INT), 6) AS top{k}" for k in (1, 3, 5)) + " FROM hits WHERE mode = 'noisy' GROUP BY setting",
    "spell_oracle": PAIRS_SQL + " SELECT count(*) AS pairs, round(avg((c.typo IS NOT NULL)::INT), 6) AS reachable FROM pairs p LEFT JOIN (SELECT DISTINCT typo, cand FROM cands) c ON c.typo = p.typo AND c.cand = p.correct",
    "spell_breakdown": RANK_SQL + f""", h AS (SELECT hits.*, v.word IS NOT NULL AS known FROM hits LEFT JOIN vocab v ON v.word = hits.typo WHERE setting = 'detected' AND mode = 'noisy'),
      g AS (SELECT *, unnest(list_filter(['all', CASE WHEN known THEN 'word' ELSE 'non-word' END, CASE WHEN rank IS NOT NULL THEN 'reachable' END, CASE WHEN rank IS NOT NULL AND NOT known THEN 'classic' END], lambda x: x IS NOT NULL)) AS part FROM h)
      SELECT part, count(*) AS pairs, {_ACC} FROM g GROUP BY part""",
    "perr_sweep": PAIRS_SQL + f""", ch AS (SELECT typo, cand, n, label IS NULL AS identity, max(CASE WHEN label IS NULL THEN 0 ELSE {_JOINT} END) AS lp FROM cands LEFT JOIN ec ON ec.edit = cands.label GROUP BY ALL),
      g AS (SELECT unnest({P_ERRS!r}::DOUBLE[]) AS p_err), s AS (SELECT p_err, typo, cand, round(ln(n / (SELECT sum(n) FROM vocab)) + CASE WHEN identity THEN ln(1 - p_err) ELSE ln(p_err) + lp END, 9) AS score FROM ch, g),
      rk AS (SELECT *, row_number() OVER (PARTITION BY typo, p_err ORDER BY score DESC, cand) AS rank FROM s QUALIFY rank = 1)
      SELECT g.p_err, {_ACC} FROM pairs p CROSS JOIN g LEFT JOIN rk AS r ON r.typo = p.typo AND r.p_err = g.p_err AND r.cand = p.correct GROUP BY g.p_err""",
    "spell_cv": PAIRS_SQL + f""", ll AS (SELECT *, ((line % {FOLDS}) + {FOLDS}) % {FOLDS} AS fold FROM least_label), f AS (SELECT unnest(range({FOLDS})) AS fold),
      fe AS (SELECT f.fold, edit, sum(weight) AS c FROM ll JOIN f ON ll.fold <> f.fold GROUP BY ALL), ft AS (SELECT fold, sum(c) AS total FROM fe GROUP BY fold),
      ch AS (SELECT ft.fold, typo, cand, n, max(ln(coalesce(fe.c, 0.5)::DOUBLE / total)) AS lp FROM cands CROSS JOIN ft LEFT JOIN fe ON fe.edit = cands.label AND fe.fold = ft.fold WHERE label IS NOT NULL GROUP BY ALL),
      rk AS (SELECT *, row_number() OVER (PARTITION BY typo, fold ORDER BY round(ln(n / (SELECT sum(n) FROM vocab)) + lp, 9) DESC, cand) AS rank FROM ch QUALIFY rank = 1),
      p AS (SELECT *, ((line % {FOLDS}) + {FOLDS}) % {FOLDS} AS fold FROM pairs)
      SELECT p.fold::INT AS fold, count(*) AS pairs, round(avg((r.rank IS NOT NULL)::INT), 6) AS accuracy FROM p LEFT JOIN rk AS r ON r.typo = p.typo AND r.fold = p.fold AND r.cand = p.correct GROUP BY p.fold""",
    "spell_candidates_d2": TWO_SQL + " SELECT typo, cand, count(*) AS sequences, min(len(edits))::INT AS edits FROM seqs WHERE distance = 2 GROUP BY typo, cand",
    "spell_reach": TWO_SQL + ", d AS (SELECT unnest([1, 2]) AS distance) SELECT d.distance::INT AS distance, count(*) AS pairs, round(avg((s.typo IS NOT NULL)::INT), 6) AS reachable FROM pairs p CROSS JOIN d LEFT JOIN (SELECT DISTINCT distance, typo, cand FROM seqs) s ON s.distance = d.distance AND s.typo = p.typo AND s.cand = p.correct GROUP BY d.distance",
    "spell_grid": TWO_SQL + _channels_sql() + f""", lc AS (SELECT *, CASE WHEN identity THEN ln(1 - {P_ERR}::DOUBLE) ELSE ln({P_ERR}::DOUBLE) + joint END AS j, CASE WHEN identity THEN ln(1 - {P_ERR}::DOUBLE) ELSE ln({P_ERR}::DOUBLE) + conditional END AS k FROM ch),
      sc AS (SELECT distance, typo, cand, identity, unnest({list(MODES)!r}) AS mode, round(unnest([prior, j, prior + j, prior + k]), 9) AS score FROM lc),
      st AS (SELECT *, 'open' AS setting FROM sc UNION ALL SELECT *, 'detected' FROM sc WHERE NOT identity),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY distance, typo, setting, mode ORDER BY score DESC, cand) AS rank FROM st),
      hits AS (SELECT p.*, g.setting, g.mode, g.distance, r.rank FROM pairs p CROSS JOIN (SELECT DISTINCT setting, mode, distance FROM ranked) g LEFT JOIN ranked r ON r.typo = p.typo AND r.cand = p.correct AND r.setting = g.setting AND r.mode = g.mode AND r.distance = g.distance)
      SELECT setting, distance::INT AS distance, mode, count(*) AS pairs, {_ACC}, round(avg(coalesce(rank <= 3, false)::INT), 6) AS top3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS top5 FROM hits GROUP BY setting, distance, mode""",
    "perr_grid": TWO_SQL + _channels_sql() + f""", g AS (SELECT d.distance, c.channel, p.p_err FROM (SELECT unnest([1, 2]) AS distance) d, (SELECT unnest(['joint', 'conditional']) AS channel) c, (SELECT unnest({P_ERRS!r}::DOUBLE[]) AS p_err) p),
      s AS (SELECT g.*, typo, cand, round(prior + CASE WHEN identity THEN ln(1 - p_err) ELSE ln(p_err) + CASE WHEN channel = 'joint' THEN joint ELSE conditional END END, 9) AS score FROM ch JOIN g USING (distance)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY typo, distance, channel, p_err ORDER BY score DESC, cand) AS rank FROM s QUALIFY rank = 1)
      SELECT g.distance::INT AS distance, g.channel, g.p_err, {_ACC} FROM pairs p CROSS JOIN g LEFT JOIN rk AS r ON r.typo = p.typo AND r.distance = g.distance AND r.channel = g.channel AND r.p_err = g.p_err AND r.cand = p.correct GROUP BY ALL""",
    "spell_cv_grid": TWO_SQL + f""", pf AS (SELECT *, ((line % {FOLDS}) + {FOLDS}) % {FOLDS} AS fold FROM pairs), f AS (SELECT unnest(range({FOLDS})) AS fold),
      al AS (SELECT pf.typo, pf.correct, weight, fold, min((len(edits), edits)) AS m FROM pf JOIN seqs ON seqs.distance = 2 AND seqs.typo = pf.typo AND seqs.cand = pf.correct GROUP BY ALL),
      ae AS (SELECT fold, edit, sum(weight) AS c FROM (SELECT fold, weight, unnest(m[2]) AS edit FROM al) GROUP BY ALL)"""
      + _channels_sql("SELECT f.fold, edit, sum(c) AS c FROM ae JOIN f ON ae.fold <> f.fold GROUP BY ALL UNION ALL SELECT 100 + f.fold, edit, c FROM ec, f") + f""",
      s AS (SELECT fold, typo, cand, distance, unnest(['joint', 'conditional']) AS channel, round(prior + unnest([joint, conditional]), 9) AS score FROM ch WHERE NOT identity),
      rk AS (SELECT *, row_number() OVER (PARTITION BY fold, typo, distance, channel ORDER BY score DESC, cand) AS rank FROM s QUALIFY rank = 1),
      g AS (SELECT s.source, s.more, d.distance, c.channel FROM (SELECT 'all' AS source, 100 AS more UNION ALL SELECT 'held_out', 0) s, (SELECT unnest([1, 2]) AS distance) d, (SELECT unnest(['joint', 'conditional']) AS channel) c),
      per AS (SELECT g.source, g.distance, g.channel, pf.fold, avg((r.typo IS NOT NULL)::INT) AS a FROM pf CROSS JOIN g LEFT JOIN rk r ON r.fold = pf.fold + g.more AND r.distance = g.distance AND r.channel = g.channel AND r.typo = pf.typo AND r.cand = pf.correct GROUP BY ALL)
      SELECT source, distance::INT AS distance, channel, round(avg(a), 6) AS accuracy FROM per GROUP BY ALL""",
    "edit_direction": PAIRS_SQL + """, e AS (SELECT edit, sum(weight) FILTER (WHERE line % 2 = 0) AS x, sum(weight) FILTER (WHERE abs(line % 2) = 1) AS y FROM least_label GROUP BY edit),
      a AS (SELECT split_part(edit, '|', 1) AS l, split_part(edit, '|', 2) AS r, edit, x FROM e WHERE x IS NOT NULL AND len(split_part(edit, '|', 1)) <> len(split_part(edit, '|', 2))),
      u AS (SELECT 'typo|correct' AS reading, edit, x FROM a UNION ALL SELECT 'correct|typo', r || '|' || l, x FROM a)
      SELECT reading, count(*) AS edits, count(*) FILTER (WHERE coalesce(e.y, 0) = 0) AS missing, round(coalesce(CASE WHEN isnan(corr(u.x, coalesce(e.y, 0))) THEN 0 ELSE corr(u.x, coalesce(e.y, 0)) END, 0), 6) AS r FROM u LEFT JOIN e ON e.edit = u.edit GROUP BY reading""",
    "spell_examples": RANK_SQL + ", s AS (SELECT correct, typo FROM pairs ORDER BY md5(correct || ':' || typo) LIMIT 400) SELECT s.correct, s.typo, r.cand AS guess FROM s LEFT JOIN (SELECT * FROM ranked WHERE rank = 1 AND setting = 'detected' AND mode = 'noisy') r USING (typo)",
}
QUERIES = {f.__name__: f for f in (spell_pairs, spell_candidates_d1, spell_candidates_d2, spell_edit_counts, spell_context_counts, spell_rank, spell_score, spell_score_conditional, spell_topk, spell_oracle, spell_breakdown, perr_sweep, spell_cv, spell_grid, spell_reach, perr_grid, spell_cv_grid, edit_direction, spell_distances, spell_examples)}
