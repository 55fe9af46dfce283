"""Queries over the core operators, and the SQL that checks them."""

from __future__ import annotations

from loomtext.plans import corpus, forests, language, spelling, tagging, words

MODULES = [corpus, language, words, tagging, spelling, forests]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
