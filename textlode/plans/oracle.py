"""DuckDB statements for the queries of this package, put together from common table expressions."""

from __future__ import annotations

from pathlib import Path

from ..functions.analysis import PUNCTUATION, STOP_WORDS
from ..operators.blocks import SPAN
from .settings import BATCH, LOOKUP, LOOKUP_MANY, PRUNED, QUERY, SCHEMAS, SHARDS, SIZES, TOP

EXAMPLES = Path(__file__).resolve().parents[1] / "sources" / "examples"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


TOKEN = r"[^\s\x{0B}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|\t|\n"
STOP = "[" + ", ".join(map(text, STOP_WORDS)) + "]"


def split(column: str) -> str:
    return f"regexp_extract_all(lower(translate({column}, {text(PUNCTUATION)}, {text(' ' * 32)})), {text(TOKEN)})"


def analyzed(source: str, key: str, column: str, least: int = 0, stop: bool = False) -> str:
    tests = ([f"length(t) >= {least}"] if least else []) + ([f"NOT list_contains({STOP}, t)"] if stop else [])
    found = split(f"coalesce({column}, '')")
    kept = f"list_filter({found}, lambda t: {' AND '.join(tests)})" if tests else found
    return f"SELECT {key}, {kept} AS toks FROM {source}"


def tokens(least: int = 0, stop: bool = False) -> str:
    return f"tok AS ({analyzed('documents', 'doc_id', 'text', least, stop)})"


OCC = "occ AS (SELECT doc_id, unnest(toks) AS term, CAST(unnest(range(len(toks))) AS INTEGER) AS pos FROM tok)"
STANDARD = f"{tokens(3, True)}, {OCC}"
POST = "post AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY term, doc_id)"
LENGTHS = "len AS (SELECT doc_id, len(toks)::BIGINT AS dl FROM tok)"
STATS = "stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len)"
NORMS = "nrm AS (SELECT doc_id, round_even(dl / avgdl, 3) AS nd FROM len, stat), lim AS (SELECT min(nd) AS lo, max(nd) AS hi FROM nrm)"
TERMS = "tdf AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
BASE = f"{STANDARD}, {POST}, {LENGTHS}, {STATS}, {NORMS}, {TERMS}"


def asked_of(queries: str) -> str:
    """Query terms of a statement for (query_id, query)."""
    return f"qs AS ({queries}), qtok AS ({analyzed('qs', 'query_id', 'query', 3, True)}), q AS (SELECT query_id, unnest(toks) AS term, CAST(unnest(range(len(toks))) AS INTEGER) AS qpos FROM qtok), qd AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY query_id, term)"


def asked(queries: list[tuple[int, str]]) -> str:
    rows = ", ".join(f"({i}, {text(q)})" for i, q in queries)
    return asked_of(f"SELECT * FROM (VALUES {rows}) AS v(query_id, query)")


ONE, MANY = asked([(0, QUERY)]), asked(BATCH)


def idf(letter: str) -> str:
    n, df = "(SELECT n FROM stat)::DOUBLE", "df::DOUBLE"
    return {"n": "1.0::DOUBLE", "t": f"round_even(ln({n} / {df}), 3)", "p": f"CASE WHEN {df} >= {n} THEN 0.0::DOUBLE ELSE round_even(greatest(0.0::DOUBLE, ln(({n} - {df}) / {df})), 3) END"}[letter]


def damp(tf: str, letter: str) -> str:
    return {"n": f"{tf}::DOUBLE", "l": f"(1 + ln({tf}::DOUBLE))", "b": "1.0::DOUBLE"}[letter]


def doc_weights(triple: str) -> str:
    if triple[2] == "n":
        return "dw AS (SELECT doc_id, term, 1.0::DOUBLE AS w FROM post)"
    d = damp("tf", triple[0])
    return f"dw AS (SELECT doc_id, term, round_even({d} / sqrt(sum({d} * {d}) OVER (PARTITION BY doc_id)), 3) AS w FROM post)"


def tfidf(doc: str, query: str) -> str:
    raw = f"qraw AS (SELECT query_id, qd.term, {damp('qtf', query[0])} * {idf(query[1])} AS raw, {idf(doc[1])} AS idf FROM qd JOIN tdf USING (term))"
    norm = "CASE WHEN sum(raw * raw) OVER (PARTITION BY query_id) > 0 THEN raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) ELSE 0 END" if query[2] == "c" else "1.0::DOUBLE"
    return f"{raw}, qw AS (SELECT query_id, term, idf, {norm} AS qw FROM qraw), {doc_weights(doc)}, sc AS (SELECT query_id, doc_id, sum(idf * w * qw) AS score FROM dw JOIN qw USING (term) GROUP BY query_id, doc_id)"


def bm25(k: float = 0.75, b: float = 0.5) -> str:
    return f"sc AS (SELECT query_id, doc_id, sum({idf('t')} * tf * ({k} + 1)::DOUBLE / (tf + {k}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * nd))) AS score FROM post JOIN qd USING (term) JOIN tdf USING (term) JOIN nrm USING (doc_id) GROUP BY query_id, doc_id)"


PAIRS = """prs AS (SELECT a.query_id, a.qpos AS i, b.qpos AS j, a.term AS t1, b.term AS t2 FROM q a JOIN q b ON a.query_id = b.query_id AND a.qpos < b.qpos AND a.term <> b.term),
qocc AS (SELECT * FROM occ WHERE term IN (SELECT term FROM q)),
near AS (SELECT query_id, x.doc_id, i, j, x.pos AS p1, y.pos AS p2 FROM prs JOIN qocc x ON x.term = t1 JOIN qocc y ON y.term = t2 AND y.doc_id = x.doc_id WHERE abs(y.pos - x.pos) <= 10),
both_terms AS (SELECT DISTINCT query_id, x.doc_id FROM prs JOIN post x ON x.term = t1 JOIN post y ON y.term = t2 AND y.doc_id = x.doc_id)"""
PROX = f"""{PAIRS},
dst AS (SELECT *, CASE WHEN p2 - p1 < 0 THEN (p2 - p1) - (j - i + 1) ELSE (j - i + 1) - (p2 - p1) END AS d FROM near),
aff AS (SELECT *, CASE WHEN d >= 0 THEN log10(15) - log10(d + 1) ELSE 0.8::DOUBLE * (log10(1 - d) + log10(15)) END AS a FROM dst),
mx AS (SELECT query_id, doc_id, i, j, p1, greatest(0, max(a)) AS a FROM aff GROUP BY ALL),
prox AS (SELECT b.query_id, b.doc_id, coalesce(sum(a), 0) AS s FROM both_terms b LEFT JOIN mx USING (query_id, doc_id) GROUP BY b.query_id, b.doc_id),
bst AS (SELECT *, CASE WHEN s > 0 THEN log10(s) ELSE 0 END AS boost FROM prox)"""

LOOP = f"""deep AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM sc),
sizes AS (SELECT unnest({SIZES}) AS n), firsts AS (SELECT n, deep.* FROM deep JOIN sizes ON rank <= n),
ret AS (SELECT n, query_id, count(*) AS nr, sum((pow(2, score) - 1) / log2(rank + 1)) AS dcg FROM firsts GROUP BY ALL),
hit AS (SELECT n, query_id, count(*) AS nh FROM firsts SEMI JOIN qrel USING (query_id, doc_id) GROUP BY ALL),
jud AS (SELECT query_id, count(*) AS nj, sum((pow(2, grade) - 1) / log2(place + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM qrel) GROUP BY 1),
lpr AS (SELECT CAST(n AS INTEGER) AS n, query_id, coalesce(nr, 0) AS n_results, CASE WHEN nr > 0 THEN coalesce(nh, 0)::DOUBLE / nr ELSE 0 END AS precision, coalesce(nh, 0)::DOUBLE / nj AS recall, coalesce(dcg, 0) / idcg AS ndcg
FROM (SELECT * FROM jud, sizes) LEFT JOIN ret USING (n, query_id) LEFT JOIN hit USING (n, query_id)),
lp AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f_score FROM lpr)"""


def file(name: str, columns: str) -> str:
    """Lines of an example file, numbered from 0."""
    return f"SELECT {columns} FROM (SELECT unnest(l) AS line, unnest(range(len(l))) AS no FROM (SELECT string_split(content, chr(10)) AS l FROM read_text({text(str(EXAMPLES / name))})))"


SPANS = f"""shd AS (SELECT doc_id, dl, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {SHARDS} AS shard FROM len),
spn AS (SELECT doc_id, dl, (row_number() OVER (PARTITION BY shard ORDER BY dl, doc_id) - 1) // {SPAN} * {SHARDS} + shard AS span FROM shd),
blk AS (SELECT term, span, count(*)::INTEGER AS n, max(tf)::INTEGER AS max_tf, min(dl)::INTEGER AS min_dl, list(doc_id ORDER BY doc_id) AS ids, list(tf::INTEGER ORDER BY doc_id) AS tfs FROM post JOIN spn USING (doc_id) GROUP BY term, span)"""
OUT = "SELECT doc_id, round(score, 6) AS score FROM sc"
RANKED = f"rk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM sc QUALIFY rank <= {TOP})"
QRELS = "qrel AS (SELECT query_id, doc_id, CAST(doc_id % 3 + 1 AS INTEGER) AS grade FROM qs, labels WHERE quality = 1)"
FOUND = f"WITH {BASE}, {MANY}, {bm25()}, {RANKED}, {QRELS}"
PR = """pr AS (SELECT query_id, CASE WHEN coalesce(nr, 0) > 0 THEN coalesce(nh, 0)::DOUBLE / nr ELSE 0 END AS precision, coalesce(nh, 0)::DOUBLE / nj AS recall
FROM (SELECT query_id, count(*) AS nj FROM qrel GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS nr FROM rk GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS nh FROM rk SEMI JOIN qrel USING (query_id, doc_id) GROUP BY 1) USING (query_id)),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f_score FROM pr)"""


def spots(least: int = 0, stop: bool = False) -> str:
    return f"WITH {tokens(least, stop)}, {OCC} SELECT doc_id, pos, term FROM occ"


def with_base(rest: str) -> str:
    return f"WITH {BASE} {rest}"

BM25 = f"WITH {BASE}, {ONE}, {bm25()} {OUT}"

SQL = {
    "corpus_scan": "SELECT doc_id, text FROM documents",
    "doc_text_projection": "SELECT doc_id, concat_ws(' ', source, lang, text) AS text FROM documents",
    "tokenize": spots(),
    "token_positions": f"WITH {tokens()}, {OCC} SELECT doc_id, term, pos FROM occ",
    "tokenize_min_len": spots(3),
    "tokenize_stopwords": spots(0, True),
    "analyze_full": spots(3, True),
    "stopword_anti_join": f"WITH {tokens()}, {OCC} SELECT DISTINCT term FROM occ WHERE NOT list_contains({STOP}, term)",
    "postings_boolean": f"WITH {STANDARD} SELECT DISTINCT term, doc_id FROM occ",
    "postings_frequency": f"WITH {STANDARD} SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY term, doc_id",
    "postings_positional": f"WITH {STANDARD} SELECT term, doc_id, list(pos ORDER BY pos) AS positions FROM occ GROUP BY term, doc_id",
    "posting_lines": f"WITH {STANDARD}, {POST} SELECT term, term || ' ' || string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS line FROM post GROUP BY term",
    "posting_lines_boolean": f"WITH {STANDARD}, post AS (SELECT DISTINCT term, doc_id FROM occ) SELECT term, term || ' ' || string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS line FROM post GROUP BY term",
    "posting_lines_positional": f"WITH {STANDARD}, post AS (SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS ps FROM occ GROUP BY term, doc_id) SELECT term, term || ' ' || string_agg(doc_id || ':' || ps, ' ' ORDER BY doc_id) AS line FROM post GROUP BY term",
    "posting_lines_read": f"WITH {STANDARD} SELECT term, doc_id, list(pos ORDER BY pos) AS positions FROM occ GROUP BY term, doc_id",
    "term_df": with_base("SELECT term, df FROM tdf"),
    "vocab_size": with_base("SELECT count(*) AS n_terms FROM tdf"),
    "sorted_terms": with_base("SELECT term FROM tdf ORDER BY term"),
    "corpus_stats": with_base("SELECT n AS n_docs, avgdl, lo AS min_norm, hi AS max_norm FROM stat, lim"),
    "doc_lengths": with_base("SELECT doc_id, dl FROM len"),
    "doc_length_norm": with_base("SELECT doc_id, nd AS dl_norm FROM nrm"),
    "term_lookup": with_base(f"SELECT term, doc_id, tf FROM post WHERE term = {text(LOOKUP)}"),
    "term_lookup_multi": with_base(f"SELECT term, doc_id, tf FROM post WHERE term IN ({', '.join(map(text, LOOKUP_MANY))})"),
    "boolean_search": f"WITH {BASE}, {ONE} SELECT doc_id, 0.0::DOUBLE AS score FROM post JOIN qd USING (term)",
    "idf_plain": with_base(f"SELECT term, {idf('t')} AS idf FROM tdf"),
    "idf_prob": with_base(f"SELECT term, {idf('p')} AS idf FROM tdf"),
    **{f"tfidf_doc_weights_{t}": with_base(f", {doc_weights(t)} SELECT doc_id, term, w FROM dw") for t in ("lnc", "nnc", "bnc", "lnn")},
    **{f"tfidf_{a}_{b}": f"WITH {BASE}, {ONE}, {tfidf(a, b)} {OUT}" for a, b in SCHEMAS},
    **dict.fromkeys(("bm25", "stream_bm25", "index_snapshot", "sql_bm25"), BM25),
    "bm25_k12_b075": f"WITH {BASE}, {ONE}, {bm25(1.2, 0.75)} {OUT}",
    "topk_bm25": f"WITH {BASE}, {ONE}, {bm25()}, {RANKED} SELECT rank, doc_id, score FROM rk",
    "topk_batch": f"WITH {BASE}, {MANY}, {bm25()}, {RANKED} SELECT query_id, rank, doc_id, score FROM rk",
    "topk_pruned": f"WITH {BASE}, {asked(PRUNED)}, {bm25()}, {RANKED} SELECT query_id, rank, doc_id, score FROM rk",
    "search_benchmark": f"WITH {BASE}, {asked_of('SELECT item_id AS query_id, text AS query FROM benchmark')}, {bm25()}, {RANKED} SELECT query_id, rank, doc_id, score FROM rk",
    "posting_blocks": f"WITH {BASE}, {SPANS} SELECT term, span, n, ids[1] AS first, ids[-1] AS last, max_tf, min_dl, list_transform(ids, lambda x: x - ids[1]) AS offsets, tfs FROM blk",
    "posting_blocks_read": with_base("SELECT term, doc_id, tf, CAST(dl AS INTEGER) AS dl FROM post JOIN len USING (doc_id)"),
    "ranker_hooks": f"WITH {BASE}, {ONE}, mxt AS (SELECT doc_id, max(tf) AS max_tf FROM post GROUP BY doc_id), cfs AS (SELECT term, sum(tf) AS cf FROM post GROUP BY term), all_tokens AS (SELECT sum(dl)::DOUBLE AS total FROM len) SELECT doc_id, round(sum(ln(total / cf) * (0.5::DOUBLE + 0.5::DOUBLE * tf / max_tf)), 6) AS score FROM post JOIN qd USING (term) JOIN mxt USING (doc_id) JOIN cfs USING (term), all_tokens GROUP BY doc_id",
    "forward_fill": "WITH lines AS (SELECT doc_id, 0 AS kind, 'Q:' || doc_id AS value FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1, concat_ws(chr(9), doc_id, quality) FROM labels) SELECT doc_id, kind, value, last_value(CASE WHEN kind = 0 THEN value END IGNORE NULLS) OVER (ORDER BY doc_id, kind, value) AS block FROM lines",
    "number_documents": "SELECT ext_id, row_number() OVER (ORDER BY md5(ext_id), ext_id) - 1 AS doc_id FROM (SELECT concat_ws('-', source, doc_id::VARCHAR) AS ext_id FROM documents)",
    "sql_tokenize": spots(3, True),
    "position_pairs": f"WITH {BASE}, {ONE}, {PAIRS} SELECT doc_id, i, j, p1, p2 FROM near",
    "proximity_boost": f"WITH {BASE}, {ONE}, {PROX} SELECT doc_id, round(s, 6) AS s, round(boost, 6) AS boost FROM bst",
    "bm25_proximity": f"WITH {BASE}, {ONE}, {bm25()}, {PROX} SELECT sc.doc_id, round(score + CASE WHEN boost > 0 AND hi > lo AND nd > lo THEN 0.01::DOUBLE * boost / log2((nd - lo) / (hi - lo) + 1) ELSE 0 END, 6) AS score FROM sc LEFT JOIN bst ON sc.query_id = bst.query_id AND sc.doc_id = bst.doc_id JOIN nrm ON nrm.doc_id = sc.doc_id, lim",
    "tfidf_proximity": f"WITH {BASE}, {ONE}, {tfidf('lnc', 'ltc')}, {PROX} SELECT sc.doc_id, round(score + CASE WHEN boost > 0 THEN 0.1::DOUBLE * boost ELSE 0 END, 6) AS score FROM sc LEFT JOIN bst ON sc.query_id = bst.query_id AND sc.doc_id = bst.doc_id",
    "resolve_doc_ids": f"WITH {BASE}, {ONE}, {bm25()}, {RANKED} SELECT rank, source || '-' || rk.doc_id AS ext_id, score FROM rk JOIN documents d ON d.doc_id = rk.doc_id",
    "qrels_semi_join": f"{FOUND} SELECT query_id, doc_id FROM rk SEMI JOIN qrel USING (query_id, doc_id)",
    "eval_precision_recall": f"{FOUND}, {PR} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_score, 6) AS f_score FROM prf",
    "eval_ndcg_reference": f"{FOUND}, o AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(k + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM qrel) GROUP BY 1), g AS (SELECT query_id, sum((pow(2, score) - 1) / log2(rank + 1)) AS dcg FROM rk GROUP BY 1) SELECT query_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM o LEFT JOIN g USING (query_id)",
    "eval_ndcg": f"{FOUND}, o AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(k + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS k FROM qrel QUALIFY k <= 10) GROUP BY 1), g AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM rk JOIN qrel USING (query_id, doc_id) GROUP BY 1) SELECT query_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM o LEFT JOIN g USING (query_id)",
    "eval_summary": f"{FOUND}, {PR} SELECT round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f_score), 6) AS mean_f_score FROM prf",
    "eval_loop": f"WITH {BASE}, {MANY}, {bm25()}, {QRELS}, {LOOP} SELECT n, query_id, n_results, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_score, 6) AS f_score, round(ndcg, 6) AS ndcg FROM lp",
    "eval_loop_summary": f"WITH {BASE}, {MANY}, {bm25()}, {QRELS}, {LOOP} SELECT n, count(*) AS n_queries, CAST(sum(n_results) AS BIGINT) AS n_results, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f_score), 6) AS mean_f_score, round(avg(ndcg), 6) AS mean_ndcg FROM lp GROUP BY n",
    "eval_latency": f"{FOUND}, {PR}, lat AS (SELECT query_id, query_id * query_id / 8.0::DOUBLE AS seconds, (SELECT count(*) FROM rk WHERE rk.query_id = qs.query_id) AS n_results FROM qs) SELECT (SELECT round(avg(precision), 6) FROM prf) AS mean_precision, (SELECT round(avg(recall), 6) FROM prf) AS mean_recall, (SELECT round(avg(f_score), 6) FROM prf) AS mean_f_score, round(median(seconds), 6) AS median_seconds, round(sum(n_results) / sum(seconds), 6) AS results_per_second FROM lat",
    "stop_word_file": file("stop_words.txt", "DISTINCT line AS word") + " WHERE line <> ''",
    "qrels_load": f"WITH lines AS ({file('judgments.txt', 'trim(line) AS line, no')}), marked AS (SELECT *, last_value(CASE WHEN contains(line, 'Q:') THEN no END IGNORE NULLS) OVER (ORDER BY no) AS block FROM lines), named AS (SELECT no AS block, trim(string_split(line, ':')[2]) AS query FROM lines WHERE contains(line, 'Q:') QUALIFY row_number() OVER (PARTITION BY query ORDER BY no DESC) = 1) SELECT query, row_number() OVER (PARTITION BY query ORDER BY no) - 1 AS ord, string_split(line, chr(9))[1] AS ext_id, CAST(string_split(line, chr(9))[2] AS INTEGER) AS grade FROM marked JOIN named USING (block) WHERE line <> '' AND NOT contains(line, 'Q:')",
    "reviews_scan": f"SELECT review_id AS ext_id, concat_ws(' ', review_headline, review_body) AS text FROM read_csv({text(str(EXAMPLES / 'reviews.tsv.gz'))}, delim = chr(9), header = true, quote = '\"', escape = '\"', all_varchar = true)",
}
