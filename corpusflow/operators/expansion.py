"""Query expansion.  Dictionaries are parameters of bounded size; they enter the plan as literals, so an expansion is a
projection of the query row: no join and no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T


def literal_dictionary(entries: Mapping[str, Iterable[str]]) -> Column:
    """array<struct<key, terms>> in dictionary order."""
    rows = [
        F.struct(F.lit(k).alias("key"), F.array(*(F.lit(t) for t in terms)).alias("terms")) for k, terms in entries.items()
    ]
    return F.array(*rows)


MAX_ENTRIES = 5000


def load_dictionary(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """A dictionary from JSON lines with `key` and `terms`, in the order of the keys' first lines.

    It becomes literals of the plan, so its size is checked; a larger one has to be joined.
    """
    rows = spark.read.schema("key string, terms array<string>").json(path).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the dictionary has more than {MAX_ENTRIES} entries")
    entries: dict[str, tuple[str, ...]] = {}
    for row in rows:
        entries[row["key"]] = entries.get(row["key"], ()) + tuple(row["terms"] or ())
    return entries


def _empty() -> Column:
    return F.array().cast("array<string>")


def unique_terms(terms: Column, stopwords: Iterable[str] = ()) -> Column:
    """Distinct terms of two or more characters in order of first occurrence."""
    kept = F.filter(terms, lambda t: (F.length(t) > 1) & (~t.isin(*stopwords) if stopwords else F.lit(True)))
    return F.array_distinct(kept)


def core_keywords(query: Column, stopwords: Iterable[str] = V.QUERY_STOPWORDS) -> Column:
    words = T.split_words(T.sub(query, r"[^\w\s]", " "))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords) & ~T.matches(w, r"^\d+$"))


def related(key: Column, word: Column) -> Column:
    return (key != word) & (key.contains(word) | word.contains(key))


def synonyms(keywords: Column, dictionary: Mapping[str, Iterable[str]] = V.SYNONYMS) -> Column:
    """All terms of an equal key, then three of every key that contains the keyword or is contained in it."""
    entries = literal_dictionary(dictionary)

    def expand(word: Column) -> Column:
        exact = F.flatten(F.transform(F.filter(entries, lambda d: d["key"] == word), lambda d: d["terms"]))
        near = F.transform(F.filter(entries, lambda d: related(d["key"], word)), lambda d: F.slice(d["terms"], 1, 3))
        return F.concat(exact, F.flatten(near))

    return F.flatten(F.transform(keywords, expand))


def query_intent(query: Column, triggers=V.INTENT_TRIGGERS) -> Column:
    lowered = F.lower(query)
    out = F
    for intent, words in triggers:
        out = out.when(T.contains_any(lowered, words), intent)
    return out.otherwise("other")


def intent_keywords(query: Column, triggers=V.INTENT_TRIGGERS, words: Mapping[str, Iterable[str]] = V.INTENT_KEYWORDS) -> Column:
    intent = query_intent(query, triggers)
    out = F
    for name, terms in words.items():
        out = out.when(intent == name, F.array(*(F.lit(t) for t in terms)))
    return out.otherwise(_empty())


def neighbour_terms(keywords: Column, dictionary: Mapping[str, Iterable[str]] = V.SYNONYMS, cap: int = 10) -> Column:
    """Dictionary neighbours in dictionary order: five terms of an equal key, three of a key that contains the keyword,
    and the key with three terms of an entry that lists it."""
    entries = literal_dictionary(dictionary)

    def expand(word: Column) -> Column:
        def entry(d: Column) -> Column:
            return (
                F.when(d["key"] == word, F.slice(d["terms"], 1, 5))
                .when(d["key"].contains(word), F.slice(d["terms"], 1, 3))
                .when(F.array_contains(d["terms"], word), F.concat(F.array(d["key"]), F.slice(d["terms"], 1, 3)))
                .otherwise(_empty())
            )

        return F.flatten(F.transform(entries, entry))

    return F.slice(F.array_distinct(F.flatten(F.transform(keywords, expand))), 1, cap)


def contextual_keywords(query: Column, triggers=V.CONTEXT_TRIGGERS, cap: int = 12) -> Column:
    lowered = F.lower(query)
    groups = [
        F.when(T.contains_any(lowered, words), F.array(*(F.lit(t) for t in terms))).otherwise(_empty())
        for words, terms in triggers
    ]
    return F.slice(F.array_distinct(F.concat(*groups)), 1, cap)


def domain_terms(keywords: Column, domains: Mapping[str, Iterable[str]] = V.DOMAIN_TERMS) -> Column:
    """The other terms of every domain a keyword belongs to."""
    entries = literal_dictionary(domains)

    def expand(word: Column) -> Column:
        member = F.filter(entries, lambda d: F.array_contains(d["terms"], word))
        return F.flatten(F.transform(member, lambda d: F.filter(d["terms"], lambda t: t != word)))

    return F.array_distinct(F.flatten(F.transform(keywords, expand)))


def rank_terms(terms: Column, query: Column, limit: int = 25) -> Column:
    """Terms by usefulness: in the query, of handy length, Hangul, without digits; ties keep their order."""
    asked = T.split_words(query)

    def score(t: Column) -> Column:
        return (
            F.when(F.array_contains(asked, t), 10).otherwise(0)
            + F.when(F.length(t).between(2, 8), 3).when(F.length(t) > 8, -2).otherwise(0)
            + T.count_matches(t, r"[가-힣]") / F.length(t) * 2
            - F.when(T.matches(t, r"\d"), 1).otherwise(0)
        )

    rows = F.transform(terms, lambda t, i: F.struct((-score(t)).cast("double").alias("s"), i.alias("at"), t.alias("t")))
    return F.transform(F.slice(F.sort_array(rows), 1, limit), lambda r: r["t"])


def expand_keywords(
    query: Column, limit: int = 25, dictionary=V.SYNONYMS, domains=V.DOMAIN_TERMS, stopwords=V.QUERY_STOPWORDS,
    intents=V.INTENT_TRIGGERS, intent_words=V.INTENT_KEYWORDS, contexts=V.CONTEXT_TRIGGERS, embedder: bool = False,
) -> Column:
    """Core keywords, synonyms, at most fifteen semantic terms and domain terms, combined, ranked and cut."""
    core = core_keywords(query, stopwords)
    semantic = F.concat(
        intent_keywords(query, intents, intent_words),
        neighbour_terms(core, dictionary) if embedder else _empty(),
        contextual_keywords(query, contexts),
    )
    joined = F.concat(core, synonyms(core, dictionary), F.slice(semantic, 1, 15), domain_terms(core, domains))
    return rank_terms(unique_terms(joined, stopwords), query, limit)


def static_expansion(query: Column, dictionary: Mapping[str, str] = V.STATIC_EXPANSIONS, limit: int = 25) -> Column:
    """Each word replaced by its dictionary entry: the equal key, else the first related key, else the word itself."""
    entries = literal_dictionary({k: v.split() for k, v in dictionary.items()})

    def expand(word: Column) -> Column:
        exact = F.filter(entries, lambda d: d["key"] == word)
        near = F.filter(entries, lambda d: d["key"].contains(word) | word.contains(d["key"]))
        hit = F.coalesce(F.get(exact, F.lit(0)), F.get(near, F.lit(0)))
        return F.coalesce(hit["terms"], F.array(word))

    words = F.flatten(F.transform(T.split_words(query), expand))
    return T.join(F.slice(unique_terms(words), 1, limit), " ")


def embedding_query(query: Column, dictionary: Mapping[str, str] = V.SIMPLE_EXPANSIONS, limit: int = 10) -> Column:
    """Query text for an embedder: cleaned, simply expanded, distinct, first ten words; empty when too short."""
    entries = literal_dictionary({k: v.split() for k, v in dictionary.items()})

    def expand(word: Column) -> Column:
        return F.coalesce(F.get(F.filter(entries, lambda d: d["key"] == word), F.lit(0))["terms"], F.array(word))

    cleaned = T.clean_for_keywords(query)
    return T.let(
        cleaned,
        lambda c: F.when(F.length(c) < 10, "").otherwise(
            T.join(F.slice(F.array_distinct(F.flatten(F.transform(T.split_words(c), expand))), 1, limit), " ")
        ),
    )


def fallback_keywords(query: Column, stopwords=V.FALLBACK_STOPWORDS, limit: int = 5) -> Column:
    return F.slice(F.filter(T.split_words(query), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords)), 1, limit)


def compound_keywords(keywords: Column, cap: int = 8) -> Column:
    """Concatenations of two keywords in both orders, three to twelve characters long."""

    def pairs(a: Column, i: Column) -> Column:
        rest = F.slice(keywords, i + 2, F.greatest(F.size(keywords) - i - 1, F.lit(0)))
        both = F.flatten(
            F.transform(
                rest,
                lambda b: F.when(F.concat(a, b) == F.concat(b, a), F.array(F.concat(a, b))).otherwise(
                    F.array(F.concat(a, b), F.concat(b, a))
                ),
            )
        )
        return F.filter(both, lambda c: F.length(c).between(3, 12))

    return F.slice(F.flatten(F.transform(keywords, pairs)), 1, cap)


def rewrite_query(
    query: Column, related_terms: Column | None = None, specific=V.SPECIFIC_TERMS, triggers=V.SPECIFIC_TRIGGERS,
    suffix: str = V.SPECIFIC_SUFFIX, static=V.STATIC_EXPANSIONS, dynamic: bool = True, **dictionaries,
) -> Column:
    """Cascade: a specific term gets at most a suffix; else the dynamic expansion, else corpus terms, else the static one.

    `dynamic` switches the dynamic expansion off, for questions whose dictionary is missing.
    """
    bare = T.strip(query)
    asks = T.contains_any(bare, triggers)
    expanded = T.join(expand_keywords(bare, 20, **dictionaries), " ") if dynamic else F.lit("")
    stages = F.when(
        T.contains_any(bare, specific), F.when(asks, F.concat(bare, F.lit(suffix))).otherwise(bare)
    ).when((expanded != "") & (expanded != bare), expanded)
    if related_terms is not None:
        joined = F.slice(unique_terms(F.concat(T.split_words(query), F.slice(related_terms, 1, 10))), 1, 25)
        stages = stages.when(F.size(related_terms) > 0, T.join(joined, " "))
    return stages.otherwise(static_expansion(bare, static))


def expansion_statistics(query: Column, **dictionaries) -> dict[str, Column]:
    core, expanded = core_keywords(query), expand_keywords(query, **dictionaries)
    return {
        "core_keyword_count": F.size(core),
        "expanded_keyword_count": F.size(expanded),
        "expansion_ratio": F.size(expanded) / F.greatest(F.size(core), F.lit(1)),
        "query_intent": query_intent(query, dictionaries.get("intents", V.INTENT_TRIGGERS)),
    }


# --- question terms ------------------------------------------------------------------------------------------------------------


def question_terms(question: Column, suffixes=V.QUESTION_SUFFIXES, stopwords=V.QUESTION_STOPWORDS, limit: int = 8) -> Column:
    """Words with one particle suffix removed (the first of the list that fits), distinct, first eight."""

    def bare(word: Column) -> Column:
        out = F
        for suffix in suffixes:
            out = out.when(word.endswith(suffix) & (F.length(word) > len(suffix)), F.left(word, F.length(word) - len(suffix)))
        return out.otherwise(word)

    words = F.transform(T.split_words(question), bare)
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))), 1, limit)


def highlight(text: Column, terms: Column) -> Column:
    """Every occurrence of a term in bold; the first term that fits at a place wins."""
    quoted = F.transform(terms, lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit("("), T.join(quoted, "|"), F.lit(")"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit("**$1**"))).otherwise(text)


def source_preview(content: Column, question: Column, context: int = 1, separator: str = r"\n\s*\n") -> Column:
    """The paragraph with most question terms, its neighbours, and how many were skipped on either side."""
    from corpusflow.functions import sentences as L

    terms = question_terms(question)

    def occurrences(p: Column) -> Column:
        return F.aggregate(
            terms, F.lit(0), lambda a, t: a + ((F.length(p) - F.length(F.replace(p, t, F.lit("")))) / F.length(t)).cast("int")
        )

    def shown(parts: Column) -> Column:
        best = F.array_min(F.transform(parts, lambda p, i: F.struct((-occurrences(p)).alias("s"), i.alias("i"))))["i"]
        start = F.greatest(F.lit(0), best - context)
        end = F.least(F.size(parts), best + context + 1)
        body = F.transform(F.slice(parts, start + 1, end - start), lambda p: F.concat(highlight(p, terms), F.lit("\n")))
        before = F.when(start > 0, F.array(F.format_string("*… 앞 문단 %d개 생략 …*", start))).otherwise(_empty())
        skipped = F.size(parts) - end
        after = F.when(skipped > 0, F.array(F.format_string("*… 뒤 문단 %d개 생략 …*", skipped))).otherwise(_empty())
        return F.when(F.size(parts) == 0, "- 출처 본문이 비어 있습니다.").otherwise(
            T.strip(T.join(F.concat(before, body, after)))
        )

    return T.let(L.paragraphs(content, separator), shown)


def corpus_terms(
    results: DataFrame, vectors: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "query_id",
    documents: int = 5, per_document: int = 10, minimum: float = 0.1, cap: int = 20,
) -> DataFrame:
    """(query_id, terms): heavy terms of the best documents that the query does not contain, then the query's words.

    `results` is ranked (query_id, rank, key), `vectors` has the term strings and weights per document.  Five documents of
    ten terms bound each query.
    """
    best = results.filter(F.col("rank") <= documents).join(vectors, key)
    heavy = F.transform(
        F.slice(F.sort_array(F.transform(F.arrays_zip("words", "weights"), lambda z: F.struct((-F.round(z["weights"], 6)).alias("w"), z["words"].alias("t")))), 1, per_document),
        lambda r: F.struct(r["w"].alias("w"), r["t"].alias("t")),
    )
    rows = best.select(query_key, F.explode(heavy).alias("h")).filter(F.col("h.w") < -minimum)
    terms = rows.groupBy(query_key).agg(F.min("h.w").alias("_"), F.sort_array(F.collect_set("h.t")).alias("found"))
    joined = queries.join(terms, query_key, "left")
    text = F.lower(T.clean_for_keywords(F.col("text"), remove_stopwords=True))
    fresh = F.filter(F.coalesce("found", _empty()), lambda t: (F.length(t) > 1) & ~text.contains(t))
    words = F.filter(T.split_words(F.col("text")), lambda w: F.length(w) > 1)
    return joined.select(query_key, F.slice(F.array_distinct(F.concat(fresh, words)), 1, cap).alias("terms"))
