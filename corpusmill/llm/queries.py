"""Queries of the operators over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import report

    return report(table(spark, sf_dir, "documents"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import report

    return report(table(spark, sf_dir, "pages"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken

    return taken(table(spark, sf_dir, "documents"))


SQL["op4_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
c AS (SELECT *, cap * w_left <= w * (total - before) AS capped FROM o),
r AS (SELECT *, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_open, total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS rest FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (w * rest)::DOUBLE / w_open::DOUBLE END AS target FROM r),
b AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS base FROM t),
g AS (SELECT *, target - base * source_size AS budget FROM b),
j AS (SELECT d.*, g.source_size, g.target, g.base, g.budget, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (SELECT *, upto <= budget AS first, budget - coalesce(max(CASE WHEN upto <= budget THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM j),
k AS (SELECT *, sum(CASE WHEN NOT first AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) AS upto2 FROM f)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (size * (base + CASE WHEN first OR (size <= gap AND upto2 <= gap) THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""


@query
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import report

    return report(table(spark, sf_dir, "documents"))


SQL["op5_substrings"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS x FROM g JOIN m USING (g) WHERE doc_id > low),
a AS (SELECT doc_id, list(x) AS gone FROM c GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS x FROM d JOIN a USING (doc_id)),
k AS (SELECT u.doc_id, string_agg(u.v, ' ' ORDER BY u.x) AS kept FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.x = c.x WHERE c.x IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import melodies, report

    return report(melodies(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import report

    return report(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op9_decontamination"] = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT *, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM n)),
p AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND array_to_string(w[i : i + p.k - 1], ' ') = g.gram),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"))
