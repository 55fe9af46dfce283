"""Queries over the operators of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.lineage import spread
from loomtext.llm import cross_split, group_split, leakage, lookalike, packing, reading_level, sentences, term_frequency
from loomtext.operators.latest import latest
from loomtext.sources.tables import table


def valid_corpus(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The valid rows of process_corpus with the given columns."""
    need = dict.fromkeys(["paragraph_id", "ingested_at", *columns])
    return latest(spread(table(spark, sf, "process_corpus").select(*need)), "paragraph_id", "ingested_at").select(*columns)


def _few(df: DataFrame, most: int) -> list:
    """All rows of a small table; more than `most` are refused, not left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of settings with over {most} rows")
    return rows


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    counts = term_frequency.ngram_frequency(valid_corpus(spark, sf, "sentences"))
    return term_frequency.mark_terms(counts).filter("mark is not null").select(F.col("gram")[0].alias("term"), "mark")


def p1_unique_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Each newest claim of corpus_statistics beside the tokens really there."""
    rows = valid_corpus(spark, sf, "shard", "source", "sentences").filter("source is not null")
    real = term_frequency.distinct_terms(rows, ["shard", "source"]).select("shard", "source", F.col("unique_terms").alias("unique_found"), F.col("words").alias("words_found"))
    claims = table(spark, sf, "corpus_statistics").select("shard", "source", "unique_tokens", "computed_at")
    newest = claims.groupBy("shard", "source").agg(F.max_by("unique_tokens", "computed_at").alias("unique_claimed"))
    return newest.join(real, ["shard", "source"], "left").select("shard", "source", "unique_claimed", F.coalesce("unique_found", F.lit(0)).alias("unique_found"), F.coalesce("words_found", F.lit(0)).alias("words_found"), F.coalesce(F.col("unique_claimed") == F.col("unique_found"), F.lit(False)).alias("agrees"))


P1_UNIQUE_TOKENS = """
WITH v AS (SELECT * FROM process_corpus QUALIFY row_number() OVER (PARTITION BY paragraph_id ORDER BY ingested_at DESC) = 1),
t AS (SELECT shard, source, unnest(flatten(sentences)) AS token FROM v WHERE source IS NOT NULL),
r AS (SELECT shard, source, count(DISTINCT token) AS u, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT shard, source, unique_tokens FROM corpus_statistics QUALIFY row_number() OVER (PARTITION BY shard, source ORDER BY computed_at DESC) = 1)
SELECT c.shard, c.source, c.unique_tokens AS unique_claimed, coalesce(r.u, 0) AS unique_found, coalesce(r.n, 0) AS words_found,
       coalesce(c.unique_tokens = r.u, false) AS agrees
FROM c LEFT JOIN r ON c.shard = r.shard AND c.source = r.source"""

P1_FOUND = """
WITH v AS (SELECT * FROM process_corpus QUALIFY row_number() OVER (PARTITION BY paragraph_id ORDER BY ingested_at DESC) = 1),
t AS (SELECT DISTINCT paragraph_id, unnest(flatten(sentences)) AS term FROM v),
n AS (SELECT count(DISTINCT paragraph_id) AS n FROM t),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT term, CASE WHEN df < 3 THEN 'rare' ELSE 'common' END AS mark FROM f, n WHERE df < 3 OR df > 0.2 * n.n"""


def p1_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs and triples of tokens that stand in three records or more, and in at most a fifth."""
    counts = term_frequency.ngram_frequency(valid_corpus(spark, sf, "sentences"), max_n=3)
    return term_frequency.mark_terms(counts).filter((F.size("gram") > 1) & F.col("mark").isNull()).select(F.size("gram").alias("n"), F.array_join("gram", "\x1f").alias("gram"), "tf", "df")


P1_NGRAMS = """
WITH v AS (SELECT * FROM process_corpus QUALIFY row_number() OVER (PARTITION BY paragraph_id ORDER BY ingested_at DESC) = 1),
t AS (SELECT paragraph_id, flatten(sentences) AS w FROM v WHERE len(flatten(sentences)) > 0),
n AS (SELECT count(*) AS n FROM t),
g AS (SELECT paragraph_id, k AS n, unnest([array_to_string(w[i:i + k - 1], chr(31)) FOR i IN range(1, len(w) - k + 2)]) AS gram FROM t, (VALUES (2), (3)) x(k)),
f AS (SELECT g.n, gram, count(*) AS tf, count(DISTINCT paragraph_id) AS df FROM g GROUP BY ALL)
SELECT f.n::INT AS n, gram, tf, df FROM f, n WHERE df >= 3 AND df <= 0.2 * n.n"""


def _spelling(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "spell_results").select("pair_id", "correct", "typo").distinct()
    return pairs.select("pair_id", group_split.word_key("correct").alias("correct"), group_split.word_key("typo").alias("typo"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    groups, _ = group_split.related_groups(_spelling(spark, sf), "pair_id", ["correct", "typo"])
    return groups.filter("group_size > 1").select("pair_id", "group_id")


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split of every record, in the shares of split_ratio."""
    records, _ = group_split.related_groups(_spelling(spark, sf), "pair_id", ["correct", "typo"])
    shares = {r["split"]: r["share"] for r in _few(table(spark, sf, "split_ratio"), 1_000)}
    splits = group_split.deal(records.select("group_id", "group_size").distinct(), shares)
    return records.join(splits.select("group_id", "split"), "group_id").select("pair_id", "group_id", "split")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_ends(valid_corpus(spark, sf, "paragraph_id", "sentences"), "paragraph_id")


def p3_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences beside the inner lists as stored, per source."""
    rows = valid_corpus(spark, sf, "paragraph_id", "source", "sentences").filter("sentences is not null")
    ends = sentences.sentence_ends(rows, "paragraph_id").groupBy("paragraph_id").agg(F.count("*").alias("n"))
    held = rows.select("paragraph_id", "source", F.size(F.filter("sentences", lambda s: F.size(s) > 0)).alias("lists"))
    return held.join(ends, "paragraph_id").groupBy("source").agg(F.count("*").alias("paragraphs"), F.sum("lists").alias("lists"), F.sum("n").alias("sentences"))


def _held() -> Column:
    return F.when(F.col("split").isin("dev", "test"), True).when(F.col("split") == "train", False)


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split.overlapping(valid_corpus(spark, sf, "paragraph_id", "split", "sentences"), "paragraph_id", _held())


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _overlaps(spark, sf)
    return pairs.select(F.least("held_id", "train_id").alias("paragraph_a"), F.greatest("held_id", "train_id").alias("paragraph_b"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source of the held-out record: records, records that recur in
    train, and pairs, beside the sizes that split_meta claims."""
    hit = _overlaps(spark, sf).groupBy(F.col("held_id").alias("paragraph_id")).agg(F.count("*").alias("pairs"))
    held = valid_corpus(spark, sf, "paragraph_id", "source", "split").filter(F.col("split").isin("dev", "test"))
    found = held.join(hit, "paragraph_id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("recurring"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    meta = table(spark, sf, "split_meta").groupBy("shard", "source").agg(F.max_by(F.struct("n_train", "n_dev", "n_test"), "built_at").alias("m"))
    claimed = meta.groupBy(F.col("source").alias("s")).agg(F.sum("m.n_train").alias("claimed_train"), F.sum("m.n_dev").alias("d"), F.sum("m.n_test").alias("t"))
    return found.join(claimed, F.col("source").eqNullSafe(F.col("s")), "left").select("split", "source", "records", "recurring", "pairs", "claimed_train", F.when(F.col("split") == "dev", F.col("d")).otherwise(F.col("t")).alias("claimed_held"))


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    cases = latest(table(spark, sf, "sample_predictions").select("case_id", "input", "predicted_at"), "case_id", "predicted_at")
    return cases.select("case_id", F.when(F.col("input").isNotNull(), F.array(F.array("input"))).alias("sentences"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    tokens = lookalike.same_looking_pairs(valid_corpus(spark, sf, "paragraph_id", "sentences"), "paragraph_id")
    inputs = lookalike.same_looking_pairs(_inputs(spark, sf), "case_id")
    return tokens.withColumn("origin", F.lit("process_corpus")).unionByName(inputs.withColumn("origin", F.lit("sample_predictions"))).select("origin", "id_a", "id_b")


def p5_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Every token and input that is not canonical, and its canonical spelling."""
    texts = valid_corpus(spark, sf, "sentences").unionByName(_inputs(spark, sf).select("sentences"))
    return lookalike.canonical_spellings(texts).select("token", "canonical")


def p6_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The container or containers of every document, for each kind of pack_capacity."""
    kinds = {r["container"]: r["capacity_tokens"] for r in _few(table(spark, sf, "pack_capacity"), 1_000)}
    return packing.pack(packing.token_sizes(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text"), "doc_id", "tokens", kinds)


def p6_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind: containers, tokens in them and the share of room used."""
    bins = p6_assignment(spark, sf).filter("bin is not null").groupBy("container", "capacity", "bin").agg(F.sum("piece_tokens").alias("t"))
    per = bins.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return per.withColumn("used", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", F.col("item").alias("item_id"))


def p7_by_task(spark: SparkSession, sf: str) -> DataFrame:
    """Per task and split: items, items that leaked, documents concerned, and pairs in which both halves did."""
    hits = _leaks(spark, sf).select("doc_id", F.col("item").alias("item_id"), "question", "answer")
    items = table(spark, sf, "eval_items").select("item_id", "task", "split")
    per = hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if((F.col("question") > 0.5) & (F.col("answer") > 0.5)).alias("both_halves"))
    return items.join(per, "item_id", "left").groupBy("task", "split").agg(F.count("*").alias("items"), F.count("documents").alias("leaked"), F.coalesce(F.sum("documents"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("both_halves"), F.lit(0)).alias("both_halves"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    models = reading_level.train(table(spark, sf, "reading_samples"), "text", "lang", "level")
    return reading_level.reading_levels(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", models)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per source, language and level."""
    sources = table(spark, sf, "documents").select("doc_id", "source")
    return _levels(spark, sf).join(sources, "doc_id").groupBy("source", "lang", "level").agg(F.count("*").alias("documents"))


_KEY = "nullif(trim(replace(lower(nfc_normalize(regexp_replace(trim({0}), '\\*[0-9]+$', ''))), '_', ' ')), '')"
P2_FOUND = f"""
WITH RECURSIVE r AS (SELECT DISTINCT pair_id, {_KEY.format('correct')} AS c, {_KEY.format('typo')} AS t FROM spell_results),
e AS (SELECT a.pair_id AS a, b.pair_id AS b FROM r a JOIN r b ON a.c = b.c UNION SELECT a.pair_id, b.pair_id FROM r a JOIN r b ON a.t = b.t),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS pair_id, min(b) AS group_id, count(*) AS n FROM reach GROUP BY a)
SELECT pair_id, group_id FROM g WHERE n > 1"""

QUERIES = {"p1_found": p1_found, "p1_unique_tokens": p1_unique_tokens, "p1_ngrams": p1_ngrams, "p2_found": p2_found, "p2_splits": p2_splits, "p3_found": p3_found, "p3_by_source": p3_by_source, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_spellings": p5_spellings, "p6_assignment": p6_assignment, "p6_usage": p6_usage, "p7_found": p7_found, "p7_by_task": p7_by_task, "p8_found": p8_found, "p8_profile": p8_profile}
SQL = {"p1_found": P1_FOUND, "p1_unique_tokens": P1_UNIQUE_TOKENS, "p1_ngrams": P1_NGRAMS, "p2_found": P2_FOUND}
