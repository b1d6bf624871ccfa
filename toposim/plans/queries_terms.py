"""Frequent-term queries (N1: H1-H3, G6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from toposim.operators.terms import (STOP_WORDS, TERM_FILTER, TOKEN_REGEX, certified_terms, suffix_stem, term_counts,
                                     top_terms)
from toposim.plans import sqlgen as Q
from toposim.plans import views as V
from toposim.plans.catalog import register
from toposim.session import checkpoint_dir
from toposim.sources.readers import read_frequent_terms
from toposim.sources.sinks import write_frequent_terms


def _terms_sql(source_sql: str, stem_sql: str) -> str:
    return f"""
, src AS ({source_sql}),
t AS (SELECT unnest(regexp_extract_all(s, '{TOKEN_REGEX}')) AS term FROM src),
k AS (SELECT term, {stem_sql} AS stem FROM t
      WHERE NOT list_contains({Q.str_list(STOP_WORDS)}, term) AND length(term) >= 3
        AND regexp_matches(term, '{TERM_FILTER}')),
bt AS (SELECT stem, term, count(*) AS n FROM k GROUP BY stem, term),
bs AS (SELECT stem, CAST(sum(n) AS BIGINT) AS cnt FROM bt GROUP BY stem),
res AS (SELECT term AS gram, stem, cnt AS "count" FROM bt JOIN bs USING (stem))"""


_NAMES_SRC = f"SELECT {Q.canon('Name1')} AS s FROM pairs UNION ALL SELECT {Q.canon('Name2')} FROM pairs"
_DOCS_SRC = f"SELECT {Q.canon('text')} AS s FROM documents"
_SUFFIX = "CASE WHEN length(term) > 4 AND suffix(term, 's') THEN substr(term, 1, length(term) - 1) ELSE term END"


@register("freq_terms", V.with_views(_terms_sql(_NAMES_SRC, "term") + "\nSELECT * FROM res", "pairs"))
def q_freq_terms(spark, sf_dir):
    """J1 on the pair names: every term with its stem's count."""
    p = V.pairs(spark, sf_dir).select("Name1", "Name2")
    return term_counts(p, ["Name1", "Name2"])


@register("freq_terms_docs", "WITH dummy AS (SELECT 1)" + _terms_sql(_DOCS_SRC, _SUFFIX)
          + "\nSELECT * FROM res")
def q_freq_terms_docs(spark, sf_dir):
    """J1 over whole document texts with a plural-stripping stem."""
    d = V.table(spark, sf_dir, "documents").select("text")
    return term_counts(d, ["text"], stem=suffix_stem)


@register("top_terms", "WITH dummy AS (SELECT 1)" + _terms_sql(_DOCS_SRC, _SUFFIX)
          + '\nSELECT * FROM res ORDER BY "count" DESC, stem, gram LIMIT 400')
def q_top_terms(spark, sf_dir):
    """H3: the 400 most frequent document terms (the frequent-term list)."""
    d = V.table(spark, sf_dir, "documents").select("text")
    return top_terms(term_counts(d, ["text"], stem=suffix_stem))


@register("certified_terms", "WITH dummy AS (SELECT 1)" + _terms_sql(_DOCS_SRC, _SUFFIX)
          + '\nSELECT * FROM res ORDER BY "count" DESC, stem, gram LIMIT 400')
def q_certified_terms(spark, sf_dir):
    """H3 by mergeable summaries and a certified second scan."""
    d = V.table(spark, sf_dir, "documents").select("text")
    return certified_terms(d, ["text"], stem=suffix_stem)


@register("term_list_files", V.with_views(_terms_sql(_NAMES_SRC, "term") + """
, top AS (SELECT gram FROM res ORDER BY "count" DESC, stem, gram LIMIT 400)
SELECT DISTINCT 'tokens' AS kind, term FROM (SELECT gram AS term FROM top UNION ALL SELECT reverse(gram) FROM top)""", "pairs"))
def q_term_list_files(spark, sf_dir):
    """K4 then A3: the list written in order by many tasks, its first 400 rows read back."""
    p = V.pairs(spark, sf_dir).select("Name1", "Name2")
    path = f"{checkpoint_dir(spark).rstrip('/')}/toposim-{uuid.uuid4().hex}/gram_tokens_latin.csv"
    write_frequent_terms(term_counts(p, ["Name1", "Name2"]), path)
    return read_frequent_terms(spark, path).select("kind", "term")
