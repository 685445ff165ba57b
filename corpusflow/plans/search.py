"""Search dispatch with fallback, and repeat suppression over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.operators import expansion, inverted, search
from corpusflow.plans import sql as S
from corpusflow.plans.expansion import RELATED, SPECIFIC, SUFFIX, TRIGGERS, ordered_distinct, unique
from corpusflow.plans.registry import register
from corpusflow.plans.retrieval import FEATURES, TFIDF, _postings, _weights, find, index, passages
from corpusflow.session import table
from corpusflow.streaming import suppress

MINIMUM = 0.4


def _found(name: str, queries: str, k: int, minimum: float = MINIMUM) -> str:
    return f"""{_postings(name, 'item_id', queries)}, {_weights(name, 'item_id')},
    {name}_all AS (SELECT item_id AS query_id, doc_id, round(sum(doc_w.w * {name}_w.w), 6) AS similarity FROM doc_w JOIN {name}_w USING (term) GROUP BY ALL),
    {name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM {name}_all) WHERE rank <= {k} AND similarity > {minimum})"""


@register("search_with_fallback", f"""
    WITH {FEATURES}, {_weights('doc', 'doc_id')}, {_found('q', 'benchmark', 12)},
    fbq AS (SELECT item_id, array_to_string((list_filter({S.words('text')}, lambda w: len(w) > 1 AND w NOT IN {S.word_list(V.FALLBACK_STOPWORDS)}))[1:5], ' ') AS text
        FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM q_top)), {_found('f', 'fbq', 5)}
    SELECT query_id, rank, doc_id, similarity, false AS fallback FROM q_top UNION ALL SELECT query_id, rank, doc_id, similarity, true FROM f_top""")
def search_with_fallback(spark, sf):
    return search.with_fallback(find(spark, sf, min_similarity=MINIMUM), passages(spark, sf))


_REWORDED = f"list_concat({S.words('text')}, ({ordered_distinct('ws')})[1:20][1:10])"


@register("rewritten_searched", f"""
    WITH {TFIDF}, {RELATED},
    rq AS (SELECT query_id AS item_id, CASE WHEN {S.contains_any(S.strip('text'), SPECIFIC)} THEN {S.strip('text')} || CASE WHEN {S.contains_any(S.strip('text'), TRIGGERS)} THEN '{SUFFIX}' ELSE '' END
        ELSE array_to_string(({unique(_REWORDED, ())})[1:25], ' ') END AS text FROM al),
    {_found('r', 'rq', 8, V.MIN_SIMILARITY)}
    SELECT query_id, rank, doc_id, similarity, text AS asked FROM r_top JOIN rq ON item_id = query_id""")
def rewritten_searched(spark, sf):
    """Related terms of a first search rewrite the question, which is asked again; no dictionary, so that the corpus speaks."""
    path = index(spark, sf)

    def rewrite(text, related):
        return expansion.rewrite_query(text, related, SPECIFIC, TRIGGERS, SUFFIX, dynamic=False)

    found = search.rewritten(find(spark, sf), lambda ids: inverted.document_vectors(spark, path, ids), passages(spark, sf), rewrite)
    return found.select("query_id", "rank", "doc_id", "similarity", "asked")


def _fresh(keys: str, ttl: int) -> str:
    return f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, {keys}, ts, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT {keys}, i, ts AS last, true AS fresh, event_id FROM e WHERE i = 1
        UNION ALL SELECT {', '.join('e.' + k.strip() for k in keys.split(','))}, e.i, CASE WHEN e.ts >= w.last + INTERVAL {ttl} SECOND THEN e.ts ELSE w.last END, e.ts >= w.last + INTERVAL {ttl} SECOND, e.event_id
        FROM w JOIN e ON e.i = w.i + 1 AND {' AND '.join(f'e.{k.strip()} = w.{k.strip()}' for k in keys.split(','))})
    SELECT event_id, fresh FROM w"""


@register("fresh_events_by_type", _fresh("event_type", 3600))
def fresh_events_by_type(spark, sf):
    return suppress.fresh_events(table(spark, sf, "events"), ["event_type"], ttl_seconds=3600).select("event_id", "fresh")


@register("fresh_events_by_user", _fresh("event_type, user_id", 86400))
def fresh_events_by_user(spark, sf):
    return suppress.fresh_events(
        table(spark, sf, "events"), ["event_type", "user_id"], ttl_seconds=86400, span_seconds=7 * 86400
    ).select("event_id", "fresh")
