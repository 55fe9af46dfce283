"""Queries on texts and corpora: tokens, sentences, statistics, frequencies, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import stats, text
from loomtext.operators.latest import latest
from loomtext.sources.tables import table


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


#: Cleaned texts, tokens with class and position, and sentence ends, in SQL.
TOKENS_SQL = f"""
WITH clean AS (SELECT doc_id, lang, source, translate(regexp_replace(text, '\\A[{text.SPACE}]+|[{text.SPACE}]+\\z', '', 'g'), chr(13) || chr(10), '  ') AS t FROM documents),
raw AS (SELECT doc_id, lang, source, i, r FROM (SELECT doc_id, lang, source, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT *, regexp_extract_all(t, '{_q(text.TOKEN)}') AS rs FROM clean WHERE t <> ''))),
cut AS (SELECT *, regexp_full_match(r, '{_q(text.URL)}') AS link, CASE WHEN regexp_full_match(r, '{_q(text.URL)}') THEN rtrim(r, '{_q(text.URL_TAIL)}') ELSE r END AS base FROM raw),
parts AS (SELECT doc_id, lang, source, i, 0 AS j, base AS tok, link, false AS tail FROM cut
  UNION ALL SELECT doc_id, lang, source, i, unnest(range(1, len(r) - len(base) + 1)), unnest(string_split(substr(r, len(base) + 1), '')), link, true FROM cut WHERE len(r) > len(base)),
tokens AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos, tok, CASE
  WHEN tail THEN 'PUNCT' WHEN link THEN 'URL' WHEN regexp_full_match(tok, '{_q(text.EMAIL)}') THEN 'EMAIL' WHEN regexp_full_match(tok, '{_q(text.DATE)}') THEN 'DATE'
  WHEN regexp_full_match(tok, '{_q(text.NUMBER)}') THEN 'NUMBER' WHEN regexp_full_match(tok, '{_q(text.ELLIPSIS)}') THEN 'ELLIPSIS' WHEN tok = '.' OR regexp_full_match(tok, '{_q(text.SENTEND)}') THEN 'SENTEND'
  WHEN regexp_full_match(tok, '{_q(text.PUNCT)}') THEN 'PUNCT' WHEN regexp_full_match(tok, '{_q(text.WORD)}') THEN 'WORD' ELSE 'OTHER' END AS type FROM parts),
ends AS (SELECT *, type IN ('SENTEND', 'ELLIPSIS') AND NOT (tok = '.' AND coalesce(lag(type) OVER w, '') = 'WORD' AND coalesce(lower(lag(tok) OVER w), '') IN ({", ".join(f"'{a}'" for a in text.ABBREVIATIONS)})) AS fin FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sents AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM ends)
"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return text.tokenised(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return text.with_sentences(_tokens(spark, sf))


def _stats_sql(by: str) -> str:
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return TOKENS_SQL + f"""SELECT {cols} count(DISTINCT doc_id) AS paragraphs, count(DISTINCT (doc_id, sent)) AS total_sentences, count(*) AS total_words, sum(len(tok))::BIGINT AS total_characters, count(DISTINCT tok) AS unique_tokens,
    round(count(*) / count(DISTINCT (doc_id, sent)), 6) AS average_sentence_length, round(sum(len(tok)) / count(*), 6) AS average_word_length, round(count(DISTINCT tok) / count(*), 6) AS type_token_ratio FROM sents {group}"""


def corpus_stats(spark, sf):
    """S1 F1 F2 T1-T5 G1 G2."""
    return stats.corpus_stats(_sentences(spark, sf))


def corpus_stats_by_lang(spark, sf):
    return stats.corpus_stats(_sentences(spark, sf), "lang")


def stats_text(spark, sf):
    """The statistics as formatted lines (K7)."""
    s = corpus_stats(spark, sf)
    line = lambda k, label: F.format_string(label, F.format_number(k, 0))
    return s.select(F.explode(F.array(line("total_sentences", "Total sentences: %s"), line("total_words", "Total words: %s"), line("total_characters", "Total characters: %s"), F.format_string("Average sentence length: %.4f", "average_sentence_length"))).alias("line"))


def token_type_dist(spark, sf):
    """G3."""
    return stats.type_counts(_tokens(spark, sf))


def token_type_share(spark, sf):
    """G3 G6."""
    return stats.share(token_type_dist(spark, sf), "n")


def top_words(spark, sf):
    """G4 F8 O1."""
    return stats.top(stats.word_counts(_tokens(spark, sf)), "n", "word", 50)


def word_retest(spark, sf):
    """Tokens re-tested against the WORD class by their text alone."""
    toks = _tokens(spark, sf).select(F.explode("tokens").alias("t")).groupBy("t.tok", "t.type").agg(F.count("*").alias("n"))
    return toks.groupBy("type", F.col("tok").rlike(rf"\A{text.WORD}\z").alias("looks_word")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


def sentence_length_hist(spark, sf):
    """G5."""
    return stats.length_histogram(_sentences(spark, sf))


def sentence_length_hist_capped(spark, sf):
    """G5 F12."""
    return stats.length_histogram(_sentences(spark, sf), 60)


def sentence_length_pct(spark, sf):
    """Percent before the filter."""
    return stats.share(sentence_length_hist_capped(spark, sf), "n").filter("length <= 40")


def tokenized_sentences(spark, sf):
    """One row per sentence, tokens joined by a blank."""
    return _sentences(spark, sf).select("doc_id", F.posexplode("sentences").alias("sent", "s")).select("doc_id", F.col("sent").cast("long").alias("sent"), F.array_join("s.tok", " ").alias("sentence"))


def stored_stats(spark, sf):
    """G1 on the valid tokenised paragraphs as stored, by source."""
    valid = latest(table(spark, sf, "process_corpus").select("paragraph_id", "source", "sentences", "ingested_at"), "paragraph_id", "ingested_at")
    rows = valid.filter("sentences is not null").select("source", F.filter("sentences", lambda s: F.size(s) > 0).alias("s")).filter(F.size("s") > 0)
    per = rows.groupBy("source").agg(F.count("*").alias("paragraphs"), F.sum(F.size("s")).alias("sentences"), F.sum(F.size(F.flatten("s"))).alias("words"))
    chars = rows.select("source", F.explode(F.flatten("s")).alias("t")).groupBy(F.col("source").alias("_s")).agg(F.sum(F.length("t")).alias("characters"))
    return per.join(chars, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def systematic_sample(spark, sf):
    """Every 7th document by id, up to 100 (S3 W6 Q5): a range numbering and a residue test."""
    at = stats.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id", "at")
    return at.filter(F.col("at") % 7 == 0).orderBy("at").limit(100).select("doc_id", (F.col("at") / 7).cast("long").alias("k"))


def split_sizes(spark, sf):
    """A split by residue of the id and its sizes."""
    r = F.col("doc_id") % 10
    return table(spark, sf, "documents").groupBy(F.when(r < 8, "train").when(r == 8, "dev").otherwise("test").alias("split")).agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


def byte_budget(spark, sf):
    """Documents that fit a budget tested once for each 100 rows."""
    docs = table(spark, sf, "documents").select("doc_id", text.cleaned(F.col("text")).alias("t")).filter("t is not null").withColumn("bytes", F.octet_length("t") + 1).drop("t")
    return stats.running_budget(docs, "doc_id", F.col("bytes"), 1_000_000, 100).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.max("doc_id").alias("last"))


def line_paragraphs(spark, sf):
    """Lines of documents as numbered paragraphs, blank lines dropped."""
    lines = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "t"))
    return lines.filter(text.cleaned(F.col("t")).isNotNull()).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max("line").cast("long").alias("last_line"), F.sum(F.length(text.cleaned(F.col("t")))).alias("chars"))


def stats_compare(spark, sf):
    """Two corpora side by side, one row per measure (chart data of G1)."""
    run = lambda label, df: stats.corpus_stats(df).select(F.lit(label).alias("run"), F.expr("stack(3, 'average_sentence_length', average_sentence_length, 'average_word_length', average_word_length, 'type_token_ratio', type_token_ratio) as (measure, value)"))
    docs = _tokens(spark, sf)
    return run("partial", text.with_sentences(docs.filter("doc_id % 2 = 0"))).union(run("full", text.with_sentences(docs)))


_S = "SELECT type, count(*) AS n FROM tokens GROUP BY type"
_LEN = "SELECT len AS length, count(*) AS n FROM (SELECT count(*) AS len FROM sents GROUP BY doc_id, sent) GROUP BY len"
_CAP = "SELECT len AS length, count(*) AS n FROM (SELECT least(count(*), 60) AS len FROM sents GROUP BY doc_id, sent) GROUP BY len"
_WS = text.SPACE

SQL = {
    "corpus_stats": _stats_sql(""),
    "corpus_stats_by_lang": _stats_sql("lang"),
    "stats_text": f"""WITH s AS ({_stats_sql("")}) SELECT unnest([format('Total sentences: {{:,}}', total_sentences), format('Total words: {{:,}}', total_words), format('Total characters: {{:,}}', total_characters), format('Average sentence length: {{:.4f}}', average_sentence_length)]) AS line FROM s""",
    "token_type_dist": TOKENS_SQL + _S,
    "token_type_share": TOKENS_SQL + f"SELECT type, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS percent FROM ({_S})",
    "top_words": TOKENS_SQL + "SELECT tok AS word, count(*) AS n FROM tokens WHERE type = 'WORD' GROUP BY tok ORDER BY n DESC, word LIMIT 50",
    "word_retest": TOKENS_SQL + f"SELECT type, regexp_full_match(tok, '{text.WORD}') AS looks_word, count(*) AS n, count(DISTINCT tok) AS kinds FROM tokens GROUP BY ALL",
    "sentence_length_hist": TOKENS_SQL + _LEN,
    "sentence_length_hist_capped": TOKENS_SQL + _CAP,
    "sentence_length_pct": TOKENS_SQL + f"SELECT * FROM (SELECT length, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS percent FROM ({_CAP})) WHERE length <= 40",
    "tokenized_sentences": TOKENS_SQL + "SELECT doc_id, sent::BIGINT AS sent, string_agg(tok, ' ' ORDER BY pos) AS sentence FROM sents GROUP BY doc_id, sent",
    "stored_stats": """WITH valid AS (SELECT * FROM process_corpus QUALIFY row_number() OVER (PARTITION BY paragraph_id ORDER BY ingested_at DESC) = 1), s AS (SELECT source, list_filter(sentences, lambda x: len(x) > 0) AS s FROM valid WHERE sentences IS NOT NULL), r AS (SELECT * FROM s WHERE len(s) > 0)
      SELECT source, count(*) AS paragraphs, sum(len(s))::BIGINT AS sentences, sum(len(flatten(s)))::BIGINT AS words, sum(list_sum(list_transform(flatten(s), lambda x: len(x))))::BIGINT AS characters FROM r GROUP BY source""",
    "systematic_sample": "SELECT doc_id, (p // 7)::BIGINT AS k FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p % 7 = 0 ORDER BY p LIMIT 100",
    "split_sizes": "SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split, count(*) AS rows, sum(coalesce(len(text), 0))::BIGINT AS chars FROM documents GROUP BY 1",
    "byte_budget": f"""WITH c AS (SELECT doc_id, translate(regexp_replace(text, '\\A[{_WS}]+|[{_WS}]+\\z', '', 'g'), chr(13) || chr(10), '  ') AS t FROM documents),
      n AS (SELECT doc_id, strlen(t) + 1 AS b, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS g FROM c WHERE t <> ''),
      s AS (SELECT g, sum(sum(b)) OVER (ORDER BY g) - sum(b) AS before FROM n GROUP BY g)
      SELECT count(*) AS rows, sum(b)::BIGINT AS bytes, max(doc_id) AS last FROM n JOIN s USING (g) WHERE before < 1000000""",
    "line_paragraphs": f"""WITH l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS ls FROM documents WHERE text IS NOT NULL)),
      c AS (SELECT doc_id, line, regexp_replace(t, '\\A[{_WS}]+|[{_WS}]+\\z', '', 'g') AS t FROM l)
      SELECT doc_id, count(*) AS paragraphs, max(line)::BIGINT AS last_line, sum(len(t))::BIGINT AS chars FROM c WHERE t <> '' GROUP BY doc_id""",
    "stats_compare": TOKENS_SQL + ", m AS (" + " UNION ALL ".join(
        f"SELECT '{r}' AS run, round(count(*) / count(DISTINCT (doc_id, sent)), 6) AS a, round(sum(len(tok)) / count(*), 6) AS b, round(count(DISTINCT tok) / count(*), 6) AS c FROM sents {w}" for r, w in (("partial", "WHERE doc_id % 2 = 0"), ("full", ""))
    ) + ") SELECT run, unnest(['average_sentence_length', 'average_word_length', 'type_token_ratio']) AS measure, unnest([a, b, c]) AS value FROM m",
}
QUERIES = {f.__name__: f for f in (corpus_stats, corpus_stats_by_lang, stats_text, token_type_dist, token_type_share, top_words, word_retest, sentence_length_hist, sentence_length_hist_capped, sentence_length_pct, tokenized_sentences, stored_stats, systematic_sample, split_sizes, byte_budget, line_paragraphs, stats_compare)}
