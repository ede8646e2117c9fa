"""Registry of queries: a function of (spark, sf_dir) and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers the decorated function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Common table expressions of the SQL twins.
WORDS = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')), ' '), lambda x: x <> '')"
REC = f"rec AS (SELECT doc_id, lang, source, {WORDS} AS ws FROM documents)"
TOK = f"{REC}, tok AS (SELECT doc_id, lang, source, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM rec)"
TYPES = f"{TOK}, types AS (SELECT w, count(*) AS freq FROM tok GROUP BY w)"
#: ln k! for k up to m, by prefix sums.
LF = "lf AS (SELECT k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (ORDER BY k) AS f FROM (SELECT unnest(range({m})) AS k))"


def ascii_letters(x: str) -> str:
    """SQL that gives each accented small letter of Latin scripts one sign that words don't have: the twin's levenshtein counts bytes."""
    return f"translate({x}, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ', '0123456789ABCDEFGHIJKLMNOPQRSTUVW')"
