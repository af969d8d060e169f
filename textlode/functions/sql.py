"""The engine from SQL: functions defined in SQL, so that all of a statement is one plan for Catalyst and nothing of it runs in Python.

    tokenize(text)         ARRAY<STRING>                 SELECT doc_id, tokenize(text) AS words FROM documents
    search_bm25(query)     TABLE (doc_id, score)         SELECT * FROM search_bm25('some words') ORDER BY score DESC LIMIT 10

Tokens as rows: SELECT doc_id, t.* FROM (SELECT doc_id, tokenize(text) AS words FROM documents), LATERAL posexplode(words) AS t(pos, term).
There is no table function for that: Spark takes one with a column of another table as its argument for a join on that column, and
would exchange whole texts; a generator stays where its row is. The names are temporary functions of the session; registering again replaces them. A statement keeps those it was analysed with.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .analysis import ALONE, GAP, PUNCTUATION, Analyzer


def literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_sql(analyzer: Analyzer, text: str) -> str:
    """The analyzer's tokens of a text as a SQL expression."""
    if analyzer.language is not None:
        raise ValueError("stems are no SQL expression: use an analyzer without a language")
    signs = "[" + "".join(f"\\x{ord(c):02X}" for c in PUNCTUATION) + "]"
    spaced = f"regexp_replace(coalesce({text}, ''), {literal(signs)}, ' ')"
    alone = f"regexp_replace({spaced}, {literal(ALONE)}, {literal(' $0 ')})"
    tests = ["t <> ''"]
    if analyzer.min_length:
        tests.append(f"length(t) >= {analyzer.min_length}")
    if analyzer.stop_words:
        tests.append(f"t NOT IN ({', '.join(map(literal, analyzer.stop_words))})")
    return f"filter(split(lower({alone}), {literal(GAP)}), t -> {' AND '.join(tests)})"


def register_analysis(spark: SparkSession, analyzer: Analyzer) -> None:
    """tokenize by an analyzer without stems. A null text has no tokens."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(body STRING) RETURNS ARRAY<STRING> RETURN {tokens_sql(analyzer, 'body')}")


def register_search(spark: SparkSession, index, k: float = 0.75, b: float = 0.5) -> None:
    """search_bm25 over an index with counted postings, with tokenize by its analyzer; views `indexed_postings` and `indexed_terms` stand for its tables.

    A query is a constant of the statement. A repeated word counts once; words that the index lacks, empty and null queries find nothing.
    """
    if "tf" not in index.postings.columns or "dl" not in index.postings.columns:
        raise ValueError("search_bm25 needs postings with frequencies")
    register_analysis(spark, index.analyzer)
    index.postings.createOrReplaceTempView("indexed_postings")
    index.terms.createOrReplaceTempView("indexed_terms")
    n, average = float(index.n_docs), float(index.stats["avgdl"] or 1.0)
    norm = f"bround(p.dl / {average!r}D, 3)"
    part = f"p.tf * {k + 1!r}D / (p.tf + {float(k)!r}D * (1 - {float(b)!r}D + {float(b)!r}D * {norm}))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_bm25(query STRING) RETURNS TABLE (doc_id BIGINT, score DOUBLE) RETURN
        SELECT p.doc_id, sum(bround(ln({n!r}D / t.df), 3) * ({part})) AS score
        FROM indexed_postings p
        JOIN (SELECT DISTINCT q.term FROM (SELECT explode({tokens_sql(index.analyzer, "query")}) AS term) q) a ON a.term = p.term
        JOIN indexed_terms t ON t.term = p.term
        GROUP BY p.doc_id""")
