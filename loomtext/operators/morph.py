"""Word recognition and noun morphology, as expressions over a word column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SG, PL, INVALID = "+N+SG", "+N+PL", "Invalid Word"


def accepted(word: Column) -> Column:
    """Whether the automaton over a-z ends in its accepting state."""
    return F.coalesce(word.rlike(r"\A[a-z]+\z"), F.lit(False))


def verdict(word: Column) -> Column:
    return F.when(accepted(word), "Accepted").otherwise("Not Accepted")


def _roots(w: Column) -> tuple[Column, Column, Column]:
    """The word less `es`, less `s`, and less `ies` with `y` for it."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), F.greatest(n - k, F.lit(0)))
    return cut(2), cut(1), F.concat(cut(3), F.lit("y"))


def analysed(df: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """Add `analysis` and `trace` (A2 A3 J6): from the right, with the lexicon
    (a column `word`) asked at the two ambiguous branches. A lexicon that is small
    enough is broadcast by the planner; others are joined on the candidate root."""
    w = F.col(word)
    no_es, no_s, ies_y = _roots(w)
    lex = lexicon.select(F.col("word").alias("_l")).distinct()
    out = df
    for name, root in (("_in_es", no_es), ("_in_s", no_s), ("_in_y", ies_y)):
        out = out.join(lex.select(F.col("_l"), F.lit(True).alias(name)), root == F.col("_l"), "left").drop("_l")
    known = {k: F.coalesce(F.col(k), F.lit(False)) for k in ("_in_es", "_in_s", "_in_y")}

    def prefer(a: Column, in_a: Column, b: Column, in_b: Column) -> Column:
        return F.when(in_b & ~in_a, b).otherwise(a)

    y_first = prefer(ies_y, known["_in_y"], no_s, known["_in_s"])
    e_first = prefer(no_s, known["_in_s"], ies_y, known["_in_y"])
    es = prefer(no_es, known["_in_es"], no_s, known["_in_s"])
    path = lambda *states: F.lit(" ".join(states))
    rules = [
        (~accepted(w), F.lit(INVALID), path("REJECT")),
        (~w.endswith("s"), F.concat(w, F.lit(SG)), path("Q0", "COPY_SG")),
        (w.endswith("ss"), F.concat(w, F.lit(SG)), path("Q0", "Q_S", "COPY_SG")),
        (w.rlike(r"(?:[xz]|[cs]h|[^aeiou]y)s\z"), F.lit(INVALID), path("Q0", "Q_S", "REJECT")),
        (~w.endswith("es"), F.concat(no_s, F.lit(PL)), path("Q0", "Q_S", "COPY_PL")),
        (w == "ies", F.lit(INVALID), path("Q0", "Q_S", "Q_SE", "Q_SEI", "REJECT")),
        (w.rlike(r"[aeiou]ies\z"), F.concat(e_first, F.lit(PL)), path("Q0", "Q_S", "Q_SE", "Q_SEI", "COPY_PL")),
        (w.endswith("ies"), F.concat(y_first, F.lit(PL)), path("Q0", "Q_S", "Q_SE", "Q_SEI", "COPY_PL")),
        (w.rlike(r"(?:[sxz]|[cs]h)es\z"), F.concat(es, F.lit(PL)), path("Q0", "Q_S", "Q_SE", "COPY_PL")),
        (F.lit(True), F.concat(no_s, F.lit(PL)), path("Q0", "Q_S", "Q_SE", "COPY_PL")),
    ]
    analysis, trace = F.lit(None), F.lit(None)
    for test, a, t in reversed(rules):
        analysis, trace = F.when(test, a).otherwise(analysis), F.when(test, t).otherwise(trace)
    return out.withColumn("analysis", analysis).withColumn("trace", trace).drop("_in_es", "_in_s", "_in_y")


def generated(lexical: Column) -> Column:
    """Surface form of `stem+N+SG` or `stem+N+PL`; null for anything else (A4)."""
    stem = F.regexp_extract(lexical, r"\A([a-z]+)\+N\+(?:SG|PL)\z", 1)
    plural = F.when(stem.rlike(r"(?:s|x|z|ch|sh)\z"), F.concat(stem, F.lit("es"))).otherwise(F.concat(stem, F.lit("s")))
    return F.when(stem == "", None).when(lexical.endswith(PL), plural).otherwise(stem)


def analyses(surface: Column) -> Column:
    """All lexical forms that generate a surface form, sorted (A5)."""
    less = lambda k: F.substring(surface, F.lit(1), F.greatest(F.length(surface) - k, F.lit(0)))
    sibilant = r"(?:s|x|z|ch|sh)\z"
    found = F.array(
        F.concat(surface, F.lit(SG)),
        F.when(surface.endswith("s") & (less(1) != "") & ~less(1).rlike(sibilant), F.concat(less(1), F.lit(PL))),
        F.when(surface.endswith("es") & less(2).rlike(sibilant), F.concat(less(2), F.lit(PL))),
    )
    return F.when(accepted(surface), F.array_sort(F.array_compact(found))).otherwise(F.array().cast("array<string>"))


def transitions() -> list[tuple[str, str, str, str]]:
    """The generator's table by rule: (state, symbol, next state, output)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    target = lambda c: "C" if c == "c" else "S" if c == "s" else "SIB" if c in "xz" else "STEM"
    rows = []
    for state in ("START", "STEM", "C", "S", "SIB"):
        for c in letters:
            rows.append((state, c, "SIB" if c == "h" and state in ("C", "S") else target(c), c))
        if state != "START":
            rows.append((state, "+N", "NOUN_ES" if state in ("S", "SIB") else "NOUN_S", ""))
    for state, ending in (("NOUN_S", "s"), ("NOUN_ES", "es")):
        rows += [(state, "+SG", "END", ""), (state, "+PL", "END", ending)]
    return rows
