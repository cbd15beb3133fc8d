"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERM = "length({t}) BETWEEN 3 AND 40 AND NOT regexp_full_match({t}, '[0-9]+') AND {t} NOT IN (" + STOPS + ")"


def words(x: str) -> str:
    return WORDS.format(x=x)


def is_term(t: str) -> str:
    return TERM.format(t=t)


IDF = f"""
terms AS (SELECT doc_id, t AS term FROM (SELECT doc_id, unnest(list_distinct({words('text')})) AS t FROM documents) WHERE {is_term('t')}),
idf AS (SELECT term, count(*)::BIGINT AS df, ln(1 + ((SELECT count(*) FROM documents) + 1) / (count(*) + 0.5)) AS idf FROM terms GROUP BY term)
"""
