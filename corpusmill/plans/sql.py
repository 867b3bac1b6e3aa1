"""Pieces of the queries' SQL."""

from __future__ import annotations

from ..functions.text import KEYWORD_STOPWORDS, STOPWORDS

GAP = r"[^\p{L}\p{N}]+"


def listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(table: str, key: str, text: str, stop: list[str] = STOPWORDS, least: int = 2) -> str:
    """(id, t): index terms."""
    cut = f" AND t NOT IN ({listed(stop)})" if stop else ""
    return f"(SELECT id, t FROM (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '{GAP}')) AS t FROM {table}) WHERE octet_length(encode(t)) >= {least}{cut})"


def keywords(text: str, stop: list[str] = KEYWORD_STOPWORDS, least: int = 3) -> str:
    cut = f" AND NOT list_contains([{listed(stop)}], w)" if stop else ""
    return f"list_filter(regexp_split_to_array(lower({text}), '{GAP}'), lambda w: octet_length(encode(w)) >= {least}{cut})"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])([\s\p{{Z}}\p{{Lu}}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {trimmed('s')}), lambda s: s <> '')"


def found(text: str, part: str) -> str:
    """Byte offset of part in text, or 0."""
    return f"CASE WHEN strpos({text}, {part}) > 0 THEN octet_length(encode(substr({text}, 1, strpos({text}, {part}) - 1))) ELSE 0 END"


def top(scores: str, k: int | None = None) -> str:
    """A ranked list from (query_id, chunk_id, score)."""
    cut = f" WHERE rank <= {k}" if k else ""
    return f"(SELECT query_id, chunk_id, rank, score FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {scores}){cut})"


POSTINGS = f"""p AS (SELECT id AS chunk_id, t AS term, count(*) AS tf FROM {tokens('documents', 'doc_id', 'text')} GROUP BY ALL),
dls AS (SELECT chunk_id, sum(tf) AS dl FROM p GROUP BY chunk_id), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(tf) FROM p)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
q AS (SELECT id AS query_id, t AS term, count(*) AS qtf FROM {tokens('benchmark', 'item_id', 'text')} GROUP BY ALL)"""
BM25 = "SELECT query_id, chunk_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN dfs USING (term) JOIN dls USING (chunk_id), st GROUP BY ALL"
VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
SCORE = {
    "cosine": "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))",
    "dot": "list_dot_product(a.e, b.e)",
    "euclidean": "-list_distance(a.e, b.e)",
}
#: Every row whose id is divisible by this is a query, numbered from 0.
EVERY = 50


def vector_scores(metric: str = "cosine") -> str:
    return f"SELECT a.vec_id // {EVERY} AS query_id, b.vec_id AS chunk_id, round({SCORE[metric]}, 6) + 0.0::DOUBLE AS score FROM v a, v b WHERE a.vec_id % {EVERY} = 0"


def lists(k: int = 50) -> str:
    """CTEs s and d: the sparse and the dense list."""
    return f"{POSTINGS}, s AS {top('(' + BM25 + ')', k)}, {VECTORS}, d AS {top('(' + vector_scores() + ')', k)}"


def fused(body: str) -> str:
    """A ranked list from (query_id, chunk_id, part)."""
    return top(f"(SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM ({body}) GROUP BY ALL)")


def min_max(src: str, w: float) -> str:
    return f"SELECT query_id, chunk_id, {w}::DOUBLE * CASE WHEN max(score) OVER z - min(score) OVER z < 1.1920929e-7 THEN 1.0::DOUBLE ELSE (score - min(score) OVER z) / (max(score) OVER z - min(score) OVER z) END AS part FROM {src} WINDOW z AS (PARTITION BY query_id)"
