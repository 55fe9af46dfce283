"""Cleaning, typed tokens and sentences, as column expressions: nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.lineage import spread

# The token classes, in the order in which they are tried, and the
# abbreviations whose full stop ends no sentence.
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = rf"(?:https?://|www\.)[^{SPACE}]+"
DATE = r"\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{2,4}|\p{Nd}{4}-\p{Nd}{1,2}-\p{Nd}{1,2}"
NUMBER = r"\p{Nd}{1,3}(?:,\p{Nd}{2,3})+(?:\.\p{Nd}+)?%?|\p{Nd}+(?:\.\p{Nd}+)?%?"
ELLIPSIS = r"\.{2,}|…"
SENTEND = r"[।॥]|[!?]+"
PUNCT = r"""[.,;:'"“”‘’()\[\]{}<>\-–—/\\|@#$%^&*+=~_`॰]"""
WORD = r"[\p{L}\p{M}]+"
OTHER = rf"[^{SPACE}]"
URL_TAIL = r""".,;:!?)”’'\""""
ABBREVIATIONS = ["ડૉ", "ડો", "શ્રી", "શ્રીમતી", "કુ", "કુમારી", "પ્રો", "સૌ", "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "no", "co", "inc", "ltd", "fig", "approx"]
TOKEN = "|".join([EMAIL, URL, DATE, NUMBER, ELLIPSIS, SENTEND, PUNCT, WORD, OTHER])
TYPES = ["EMAIL", "URL", "DATE", "NUMBER", "ELLIPSIS", "SENTEND", "PUNCT", "WORD", "OTHER"]


def _is(column: Column, pattern: str) -> Column:
    return column.rlike(rf"\A(?:{pattern})\z")


def cleaned(text: Column) -> Column:
    """Without white space at the ends, line breaks as blanks; null if nothing is left (F1)."""
    bare = F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    return F.when(bare != "", F.translate(bare, "\r\n", "  "))


def token_type(token: Column) -> Column:
    """The class of a token by its text (T1); a lone full stop ends a sentence."""
    return (
        F.when(_is(token, WORD), "WORD").when(token == ".", "SENTEND").when((F.length(token) == 1) & _is(token, PUNCT), "PUNCT")
        .when(_is(token, EMAIL), "EMAIL").when(_is(token, URL), "URL").when(_is(token, DATE), "DATE").when(_is(token, NUMBER), "NUMBER")
        .when(_is(token, ELLIPSIS), "ELLIPSIS").when(_is(token, SENTEND), "SENTEND").otherwise("OTHER")
    )


def typed_tokens(text: Column) -> Column:
    """array<struct<tok, type>> of a text; marks glued to a link's end become tokens
    of their own that end no sentence (T1, T2)."""

    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    linked = lambda t: (t.startswith("http") | t.startswith("www.")) & _is(t, URL)

    def split(token: Column) -> Column:
        base = F.rtrim(token, F.lit(URL_TAIL))
        tail = F.filter(F.split(F.substring(token, F.length(base) + 1, F.length(token)), ""), lambda c: c != "")
        link = F.concat(F.array(F.struct(base.alias("tok"), F.lit("URL").alias("type"))), F.transform(tail, lambda c: F.struct(c.alias("tok"), F.lit("PUNCT").alias("type"))))
        return F.when(linked(token), link).otherwise(F.array(typed(token)))

    def typed(token: Column) -> Column:
        return F.struct(token.alias("tok"), token_type(token).alias("type"))

    # texts without a link, most of them, need no list for each token
    some = text.contains("http") | text.contains("www.")
    return F.when(some, F.flatten(F.transform(raw, split))).otherwise(F.transform(raw, typed))


def sentences_of(tokens: Column) -> Column:
    """array<array<struct>>: cut after sentence ends and ellipses, but not after the
    full stop of an abbreviation; what is left at the end is a sentence (T3, T4)."""

    def end(x: Column, i: Column) -> Column:
        before = F.try_element_at(tokens, F.when(i > 0, i).cast("int"))
        short = (x["tok"] == ".") & (before["type"] == "WORD") & F.lower(before["tok"]).isin(ABBREVIATIONS)
        return F.when(x["type"].isin("SENTEND", "ELLIPSIS") & ~F.coalesce(short, F.lit(False)), i + 1)

    ends = F.array_union(F.array_compact(F.transform(tokens, end)), F.when(F.size(tokens) > 0, F.array(F.size(tokens))).otherwise(F.array().cast("array<int>")))
    begins = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    return F.when(F.size(tokens) > 0, F.zip_with(begins, ends, lambda a, b: F.slice(tokens, a + 1, b - a))).otherwise(F.array())


def once(column: Column) -> Column:
    """The column by way of a one-row generator, which keeps the optimizer from
    repeating its expression wherever it is used."""
    return F.explode(F.array(column))


def tokenised(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `tokens` instead of `text`, for rows with any text."""
    rest = [c for c in df.columns if c != text]
    return spread(df).select(*rest, cleaned(F.col(text)).alias("_t")).filter("_t is not null").select(*rest, once(typed_tokens(F.col("_t"))).alias("tokens"))


def with_sentences(df: DataFrame) -> DataFrame:
    """tokenised() with `sentences`, without rows that have none (F2)."""
    rest = [c for c in df.columns if c != "tokens"]
    return df.filter(F.size("tokens") > 0).select(*rest, once(sentences_of(F.col("tokens"))).alias("sentences"))
