"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, collocations, html_text, jaccard_join, line_runs, oracle, packing, quality_rules, sharding, spelling, token_counts, toxicity, url_filters
from .common import ship

QUERIES = {
    "op8_sharding": sharding.op8_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op1_cross_polytope": ann.op1_cross_polytope,
    "op2_ngram_jaccard": jaccard_join.op2_ngram_jaccard,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op9_url_filters": url_filters.op9_url_filters,
    "op11_collocations": collocations.op11_collocations,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_line_dedup": line_runs.op13_line_dedup,
}


def queries() -> dict:
    def shipped(f):
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
