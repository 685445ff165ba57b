"""Query expansion over `benchmark` passages with Latin-script dictionaries, given as parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import expansion as X
from corpusflow.operators import inverted
from corpusflow.plans import sql as S
from corpusflow.plans.registry import register
from corpusflow.plans.retrieval import TFIDF, find, index, passages
from corpusflow.session import cut_lineage, table

# dictionaries for the fixture's invented words
SYNONYMS = {"the": ("then", "ther", "thea", "thes"), "tion": ("ation", "ition", "ting", "tive"), "and": ("with", "plus", "also"), "ing": ("ings", "inge", "ent")}
DOMAINS = {"article": ("the", "an", "der", "les"), "link": ("and", "with", "for", "by"), "place": ("in", "on", "at", "from")}
INTENTS = (("what", ("what", "which")), ("how", ("this", "how")), ("where", ("in ", "from")), ("who", ("re", "der")))
INTENT_WORDS = {"what": ("meaning", "content"), "how": ("method", "step"), "where": ("place", "site"), "who": ("person", "owner")}
CONTEXTS = ((("the", "les"), ("text", "page", "part")), (("and", "und"), ("pair", "text", "group")), (("tion",), ("act", "deed")))
STATIC = {"the": "the then article", "ation": "ation action act", "and": "and plus", "is": "is was be"}
SIMPLE = {"the": "the then", "and": "and plus with"}
SPECIFIC, TRIGGERS, SUFFIX = ("and an", "qui "), ("the", "que"), " old pot find"
DICTIONARIES = dict(dictionary=SYNONYMS, domains=DOMAINS, intents=INTENTS, intent_words=INTENT_WORDS, contexts=CONTEXTS)


def _dict(entries) -> str:
    return "[" + ", ".join(f"{{'key': {S.quote(k)}, 'terms': {S.array(v)}}}" for k, v in entries.items()) + "]"


def _flat(expr: str) -> str:
    return f"coalesce(flatten({expr}), [])"


def unique(expr: str, stop=V.QUERY_STOPWORDS) -> str:
    """Distinct in order of first occurrence."""
    kept = f"list_filter({expr}, lambda t: len(t) > 1 AND t NOT IN {S.word_list(stop or ('',))})"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


CORE = (
    f"list_filter({S.words(S.sub('text', r'[^\w\s]', ' '))}, lambda w: len(w) > 1 AND w NOT IN {S.word_list(V.QUERY_STOPWORDS)}"
    f" AND NOT {S.match('w', r'^\d+$')})"
)


def _synonyms(core: str) -> str:
    d = _dict(SYNONYMS)
    exact = _flat(f"list_transform(list_filter({d}, lambda e: e.key = w), lambda e: e.terms)")
    near = _flat(f"list_transform(list_filter({d}, lambda e: e.key <> w AND (contains(e.key, w) OR contains(w, e.key))), lambda e: e.terms[1:3])")
    return _flat(f"list_transform({core}, lambda w: list_concat({exact}, {near}))")


def _intent(text: str = "lower(text)") -> str:
    return "CASE " + " ".join(f"WHEN {S.contains_any(text, w)} THEN '{n}'" for n, w in INTENTS) + " ELSE 'other' END"


INTENT_LIST = f"CASE {_intent()} " + " ".join(f"WHEN '{n}' THEN {S.array(w)}" for n, w in INTENT_WORDS.items()) + " ELSE [] END"
NEIGHBOURS = "list_transform({core}, lambda w: " + _flat(
    f"list_transform({_dict(SYNONYMS)}, lambda e: CASE WHEN e.key = w THEN e.terms[1:5] WHEN contains(e.key, w) THEN e.terms[1:3] WHEN list_contains(e.terms, w) THEN list_concat([e.key], e.terms[1:3]) ELSE [] END)"
).replace("{", "{{").replace("}", "}}") + ")"


def ordered_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda t, i: list_position({expr}, t) = i)"


CONTEXT = "list_concat(" + ", ".join(f"CASE WHEN {S.contains_any('lower(text)', w)} THEN {S.array(t)} ELSE [] END" for w, t in CONTEXTS) + ")"


def _domains(core: str) -> str:
    return _flat(f"list_transform({core}, lambda w: {_flat(f'list_transform(list_filter({_dict(DOMAINS)}, lambda e: list_contains(e.terms, w)), lambda e: list_filter(e.terms, lambda t: t <> w))')})")


SCORE = f"""(CASE WHEN list_contains({S.words('text')}, t) THEN 10 ELSE 0 END + CASE WHEN len(t) BETWEEN 2 AND 8 THEN 3 WHEN len(t) > 8 THEN -2 ELSE 0 END
    + {S.count('t', r'[가-힣]')} / len(t) * 2 - CASE WHEN {S.match('t', r'\d')} THEN 1 ELSE 0 END)"""
BASE = f"""
    q0 AS (SELECT item_id AS query_id, text, {CORE} AS core FROM benchmark),
    q1 AS (SELECT *, {_synonyms('core')} AS syn, {INTENT_LIST} AS ik, {_flat(NEIGHBOURS.format(core='core'))} AS nb, {CONTEXT} AS cx0, {_domains('core')} AS dm0 FROM q0),
    q2 AS (SELECT * EXCLUDE (nb, cx0, dm0), ({ordered_distinct('nb')})[1:10] AS nb, ({ordered_distinct('cx0')})[1:12] AS cx, {ordered_distinct('dm0')} AS dm FROM q1)"""


def _ranked(limit: int) -> str:
    """Terms of `ut` by score, ties in order."""
    return f"""
    u AS (SELECT query_id, text, core, list_concat(core, syn, (list_concat(ik, cx))[1:15], dm) AS al FROM q2),
    ut AS (SELECT query_id, text, core, {unique('al')} AS ts FROM u),
    sc AS (SELECT query_id, i, ts[i] AS t, text FROM ut, range(1, len(ts) + 1) r(i)),
    rk AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY {SCORE} DESC, i) AS rank FROM sc),
    ex AS (SELECT query_id, string_agg(t, ' ' ORDER BY rank) AS terms, count(*) AS n FROM rk WHERE rank <= {limit} GROUP BY query_id)"""


def _terms(name: str, column, expression: str):
    register(name, f"WITH {BASE} SELECT query_id, array_to_string({expression}, ' ') AS terms FROM q2")(
        lambda spark, sf: passages(spark, sf).select("query_id", T.join(column(F.col("text")), " ").alias("terms"))
    )


_terms("core_keywords", X.core_keywords, "core")
_terms("synonym_terms", lambda q: X.synonyms(X.core_keywords(q), SYNONYMS), "syn")
_terms("intent_terms", lambda q: X.intent_keywords(q, INTENTS, INTENT_WORDS), "ik")
_terms("neighbour_terms", lambda q: X.neighbour_terms(X.core_keywords(q), SYNONYMS), "nb")
_terms("contextual_terms", lambda q: X.contextual_keywords(q, CONTEXTS), "cx")
_terms("domain_terms", lambda q: X.domain_terms(X.core_keywords(q), DOMAINS), "dm")
_terms("combined_terms", lambda q: X.unique_terms(F.concat(X.core_keywords(q), X.synonyms(X.core_keywords(q), SYNONYMS)), V.QUERY_STOPWORDS), unique("list_concat(core, syn)"))


@register("expanded_queries", f"WITH {BASE}, {_ranked(25)} SELECT query_id, coalesce(terms, '') AS terms FROM q2 LEFT JOIN ex USING (query_id)")
def expanded_queries(spark, sf):
    return passages(spark, sf).select("query_id", T.join(X.expand_keywords(F.col("text"), **DICTIONARIES), " ").alias("terms"))


@register("expansion_statistics", f"""WITH {BASE}, {_ranked(25)} SELECT query_id, len(core) AS core_keyword_count, coalesce(n, 0) AS expanded_keyword_count,
    round(coalesce(n, 0) / greatest(len(core), 1), 6) AS expansion_ratio, {_intent()} AS query_intent FROM q2 LEFT JOIN ex USING (query_id)""")
def expansion_statistics(spark, sf):
    stats = X.expansion_statistics(F.col("text"), **DICTIONARIES)
    stats["expansion_ratio"] = F.round(stats["expansion_ratio"], 6)
    return passages(spark, sf).select("query_id", *(c.alias(n) for n, c in stats.items()))


_ST = _dict({k: v.split() for k, v in STATIC.items()})
_STATIC_WORDS = _flat(f"""list_transform({S.words('text')}, lambda w: coalesce(list_filter({_ST}, lambda e: e.key = w)[1].terms,
    list_filter({_ST}, lambda e: contains(e.key, w) OR contains(w, e.key))[1].terms, [w]))""")
_STATIC = f"st AS (SELECT item_id AS query_id, text, {_STATIC_WORDS} AS ws FROM benchmark)"


@register("static_expansion", f"WITH {_STATIC} SELECT query_id, array_to_string(({unique('ws', ())})[1:25], ' ') AS terms FROM st")
def static_expansion(spark, sf):
    return passages(spark, sf).select("query_id", X.static_expansion(F.col("text"), STATIC).alias("terms"))


@register("embedding_queries", f"""
    WITH c AS (SELECT item_id AS query_id, trim({S.sub('text', r'[^\w]+', ' ')}) AS c FROM benchmark),
    e AS (SELECT query_id, c, {_flat(f"list_transform({S.words('c')}, lambda w: coalesce(list_filter({_dict({k: v.split() for k, v in SIMPLE.items()})}, lambda e: e.key = w)[1].terms, [w]))")} AS ws FROM c)
    SELECT query_id, CASE WHEN len(c) < 10 THEN '' ELSE array_to_string(({ordered_distinct('ws')})[1:10], ' ') END AS terms FROM e""")
def embedding_queries(spark, sf):
    return passages(spark, sf).select("query_id", X.embedding_query(F.col("text"), SIMPLE).alias("terms"))


@register("fallback_terms", f"""SELECT item_id AS query_id, array_to_string((list_filter({S.words('text')}, lambda w: len(w) > 1
    AND w NOT IN {S.word_list(V.FALLBACK_STOPWORDS)}))[1:5], ' ') AS terms FROM benchmark""")
def fallback_terms(spark, sf):
    return passages(spark, sf).select("query_id", T.join(X.fallback_keywords(F.col("text")), " ").alias("terms"))


@register("compound_terms", f"""
    WITH {BASE}, p AS (SELECT query_id, i, j, o, CASE WHEN o = 1 THEN core[i] || core[j] ELSE core[j] || core[i] END AS c, core[i] || core[j] AS f FROM q0,
        range(1, len(core) + 1) a(i), range(1, len(core) + 1) b(j), range(1, 3) c(o) WHERE i < j),
    r AS (SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY i, j, o) AS n FROM p WHERE len(c) BETWEEN 3 AND 12 AND (o = 1 OR c <> f))
    SELECT query_id, coalesce(string_agg(c, ' ' ORDER BY n) FILTER (n <= 8), '') AS terms FROM q0 LEFT JOIN r USING (query_id) GROUP BY query_id""")
def compound_terms(spark, sf):
    return passages(spark, sf).select("query_id", T.join(X.compound_keywords(X.core_keywords(F.col("text"))), " ").alias("terms"))


@register("rewritten_queries", f"""
    WITH {BASE}, {_ranked(20)}, {_STATIC}
    SELECT q2.query_id, CASE WHEN {S.contains_any(S.strip('q2.text'), SPECIFIC)} THEN {S.strip('q2.text')} || CASE WHEN {S.contains_any('q2.text', TRIGGERS)} THEN '{SUFFIX}' ELSE '' END
        WHEN coalesce(terms, '') NOT IN ('', {S.strip('q2.text')}) THEN terms ELSE array_to_string(({unique('ws', ())})[1:25], ' ') END AS terms
    FROM q2 LEFT JOIN ex USING (query_id) JOIN st USING (query_id)""")
def rewritten_queries(spark, sf):
    rewritten = X.rewrite_query(F.col("text"), None, SPECIFIC, TRIGGERS, SUFFIX, STATIC, **DICTIONARIES)
    return passages(spark, sf).select("query_id", rewritten.alias("terms"))


# --- question terms ----------------------------------------------------------------------------------------------------------------

LATIN_SUFFIXES = ("ing", "ent", "er", "en", "s", "e")


def _bare(word: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({word}, '{s}') AND len({word}) > {len(s)} THEN left({word}, len({word}) - {len(s)})" for s in LATIN_SUFFIXES) + f" ELSE {word} END"


_QT0 = f"list_filter(list_transform({S.words('text')}, lambda w: {_bare('w')}), lambda w: len(w) >= 2 AND w NOT IN {S.word_list(V.QUESTION_STOPWORDS)})"
QTERMS = f"qt0 AS (SELECT item_id AS query_id, text, {_QT0} AS w0 FROM benchmark), qt AS (SELECT query_id, text, ({ordered_distinct('w0')})[1:8] AS ts FROM qt0)"


def _question_terms(question):
    return X.question_terms(question, LATIN_SUFFIXES)


@register("question_terms", f"WITH {QTERMS} SELECT query_id, array_to_string(ts, ' ') AS terms FROM qt")
def question_terms(spark, sf):
    return passages(spark, sf).select("query_id", T.join(_question_terms(F.col("text")), " ").alias("terms"))


@register("terms_highlighted", f"""WITH {QTERMS} SELECT query_id, CASE WHEN len(ts) > 0 THEN regexp_replace(text,
    '(' || array_to_string(list_transform(ts, lambda t: regexp_replace(t, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g')), '|') || ')', '**\\1**', 'g') ELSE text END AS out FROM qt""")
def terms_highlighted(spark, sf):
    return passages(spark, sf).select("query_id", X.highlight(F.col("text"), _question_terms(F.col("text"))).alias("out"))


RELATED = f"""
    hv AS (SELECT query_id, term, w, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(w, 6) DESC, term) AS r FROM tfidf JOIN doc_w USING (doc_id) WHERE rank <= 5),
    cl AS (SELECT item_id AS query_id, text, trim({S.sub('text', r'[^\w]+', ' ')}) AS c FROM benchmark),
    cl2 AS (SELECT query_id, text, lower(array_to_string(list_filter({S.words('c')}, lambda w: len(w) > 1), ' ')) AS c FROM cl),
    fr AS (SELECT cl2.query_id, any_value(text) AS text, list(DISTINCT term ORDER BY term) FILTER (term IS NOT NULL AND len(term) > 1 AND NOT contains(c, term)) AS ts
        FROM cl2 LEFT JOIN (SELECT query_id, term FROM hv WHERE r <= 10 AND round(w, 6) > 0.1) h ON h.query_id = cl2.query_id GROUP BY cl2.query_id),
    al AS (SELECT query_id, text, list_concat(coalesce(ts, []), list_filter({S.words('text')}, lambda w: len(w) > 1)) AS ws FROM fr)"""


@register("corpus_related_terms", f"""
    WITH {TFIDF}, {RELATED}
    SELECT query_id, array_to_string(({ordered_distinct('ws')})[1:20], '|') AS terms FROM al""")
def corpus_related_terms(spark, sf):
    asked, path = passages(spark, sf), index(spark, sf)
    found = cut_lineage(inverted.tfidf_top_k(spark, path, asked, k=12))
    vectors = inverted.document_vectors(spark, path, found.filter(F.col("rank") <= 5))
    rows = X.corpus_terms(found, vectors, asked)
    return rows.select("query_id", T.join("terms", "|").alias("terms"))
