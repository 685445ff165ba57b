"""Near duplicates over `documents` and repeated answers over `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import dedup, ranking
from corpusflow.plans import sql as S
from corpusflow.plans.context import RES, results
from corpusflow.plans.registry import register
from corpusflow.session import table

_NORM = S.sub(S.strip("lower(text)"), r"\s+", " ")
GREEDY = f"""
    WITH RECURSIVE nt AS (SELECT doc_id, {_NORM} AS t FROM documents WHERE {S.strip('text')} <> ''),
    rp AS (SELECT min(doc_id) AS id, t, len(t) AS n, list_distinct(string_split(t, ' ')) AS w FROM nt GROUP BY t),
    tk AS (SELECT id, unnest(w) AS x FROM rp),
    sh AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM tk a JOIN tk b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
    pr AS MATERIALIZED (SELECT sh.a, sh.b FROM sh JOIN rp ra ON ra.id = sh.a JOIN rp rb ON rb.id = sh.b
        WHERE abs(ra.n - rb.n) <= greatest(ra.n, rb.n) * (1 - 0.8::DOUBLE) AND c / (len(ra.w) + len(rb.w) - c) >= 0.8),
    nb AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, coalesce(list(a ORDER BY a) FILTER (a IS NOT NULL), []) AS before FROM rp LEFT JOIN pr ON b = id GROUP BY id),
    walk AS (SELECT 1::BIGINT AS i, [(SELECT id FROM nb WHERE i = 1)] AS kept
        UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(nb.before, w.kept) THEN w.kept ELSE list_append(w.kept, nb.id) END FROM walk w JOIN nb ON nb.i = w.i + 1),
    kept AS (SELECT unnest(kept) AS id FROM walk WHERE i = (SELECT max(i) FROM nb))"""


@register("near_duplicate_keepers", GREEDY + """,
    fk AS (SELECT b AS id, min(a) AS keeper FROM pr WHERE a IN (SELECT id FROM kept) AND b NOT IN (SELECT id FROM kept) GROUP BY b)
    SELECT id AS doc_id, keeper FROM nb LEFT JOIN fk USING (id)""")
def near_duplicate_keepers(spark, sf):
    return dedup.near_duplicates(table(spark, sf, "documents"))


@register("near_duplicates_dropped", GREEDY + " SELECT id AS doc_id FROM kept")
def near_duplicates_dropped(spark, sf):
    return dedup.drop_near_duplicates(table(spark, sf, "documents")).select("doc_id")


@register("unique_terms_in_order", f"""SELECT conv_id, turn, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i), ' ') AS terms
    FROM (SELECT conv_id, turn, list_filter({S.words('text')}, lambda t: len(t) > 1) AS w FROM conversations)""")
def unique_terms_in_order(spark, sf):
    from corpusflow.operators import expansion

    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", T.join(expansion.unique_terms(T.split_words(F.col("text"))), " ").alias("terms"))


@register("similar_results_kept", f"""
    WITH RECURSIVE {RES}, rw AS MATERIALIZED (SELECT query_id, rank, doc_id, text, list_distinct({S.words('text')}) AS w, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM res),
    pp AS MATERIALIZED (SELECT b.query_id, b.i, list(a.i) AS before FROM rw a JOIN rw b ON a.query_id = b.query_id AND a.i < b.i
        WHERE a.text = b.text OR CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END > 0.9 GROUP BY ALL),
    walk AS (SELECT query_id, 1::BIGINT AS i, [1::BIGINT] AS kept FROM rw WHERE i = 1
        UNION ALL SELECT w.query_id, w.i + 1, CASE WHEN list_has_any(coalesce(pp.before, []), w.kept) THEN w.kept ELSE list_append(w.kept, w.i + 1) END
        FROM walk w JOIN rw ON rw.query_id = w.query_id AND rw.i = w.i + 1 LEFT JOIN pp ON pp.query_id = w.query_id AND pp.i = w.i + 1)
    SELECT rw.query_id, rank, doc_id FROM rw JOIN (SELECT query_id, arg_max(kept, i) AS kept FROM walk GROUP BY query_id) k ON k.query_id = rw.query_id AND list_contains(k.kept, rw.i)""")
def similar_results_kept(spark, sf):
    kept = ranking.drop_similar_results(results(spark, sf).select("query_id", "rank", "doc_id", "text"))
    return kept.select("query_id", "rank", "doc_id")
