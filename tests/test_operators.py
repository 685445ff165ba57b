"""Operators against brute force or literal cases, where SQL has no say."""

import itertools
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import (
    chunking, context, dedup, expansion, inverted, lexical, ranking, reports, scoring, search, structure, summary, vector,
)


# --- chunking ----------------------------------------------------------------------------------------------------------------


def covers(text, chunks):
    """Each chunk starts inside the one before it or right after it (spaces aside), and the last one ends the text."""
    start = end = 0
    for chunk in chunks:
        gap = len(text) - len(text[end:].lstrip()) if text[end:].strip() else len(text)
        found = text.rfind(chunk, start, gap + len(chunk))
        assert found >= 0
        start, end = found, max(end, found + len(chunk))
    assert text[end:].strip() == ""


@pytest.mark.parametrize("separators", [V.DEFAULT_SEPARATORS, V.MARKDOWN_SEPARATORS, V.PLAIN_SEPARATORS])
def test_recursive_chunks(spark, small, separators):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = chunking.recursive_chunks(docs, 150, 50, separators).join(docs.select("doc_id", "text"), "doc_id").collect()
    for row in rows:
        assert all(0 < len(c) <= 150 for c in row["chunks"])
        covers(row["text"], row["chunks"])


def test_splitter_overlap():
    parts = list(chunking.split_recursively("aa bb cc dd ee", 8, 3, (" ", "")))
    assert [p.strip() for p in parts] == ["aa bb cc", "cc dd", "dd ee"]


def test_colophon(column):
    got = column(["ISBN 979-11-86012-88-8", "ISBN이란 국제 표준 도서 번호를 말한다."], chunking.is_colophon)
    assert got == [True, False]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), "other")


def test_short_chunks_fold(spark):
    df = spark.createDataFrame([(1, ["a" * 120, "b" * 60, "c" * 50, "d" * 110])], "doc_id bigint, chunks array<string>")
    row = chunking.merge_short_chunks(df, 150).first()
    assert row["chunks"] == ["a" * 120 + "\n\n" + "b" * 60, "d" * 110] and row["dropped"] == 1


def test_boundary_chunks_keep_tables(spark):
    text = "\n\n".join(["문장이 이렇게 끝난다. " * 5, "경우의", "표 앞 문장이다.", "| a | b |\n|---|---|\n| 1 | 2 |", "마지막 문장이다."])
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    chunks = chunking.boundary_chunks(df, 100, 1000).first()["chunks"]
    assert "\n\n".join(chunks) == text.strip()
    assert not any(c.endswith("경우의") for c in chunks)
    assert sum("| a | b |\n|---|---|\n| 1 | 2 |" in c for c in chunks) == 1


def test_corrections(spark):
    rows = [(1, "[페이지 1]\n본문 내용이다", "[페이지 1]\n본문내용이다"), (2, "본문 내용이다 아주 길다", "요약"), (3, "[페이지 1]\n본문", "본문 페이지 1"), (4, "| a |\n| b |", "| a | | b |")]
    df = spark.createDataFrame(rows, "i int, text string, corrected string")
    assert [r["accepted"] for r in chunking.accept_corrections(df).orderBy("i").collect()] == [True, False, False, False]


def test_folds_of_semantic_chunks_share_workers(spark, small):
    from corpusflow import plans

    plan = plans.queries()["semantic_statistics"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3  # a task has a worker for each


def test_pack_and_merge_is_one_after_the_other(spark):
    from corpusflow.functions import folds

    rows = [([5, 6, 1, 9, 2, 2], [True, False, False, True, True, False], [True, False, False, True, False, False]), ([], [], []), (None, None, None), ([30], [True], [False])]
    df = spark.createDataFrame(rows, "n array<int>, opens array<boolean>, fixed array<boolean>")
    two = df.withColumn("b", folds.pack("n", 11, 1, 0, 0, F.col("opens")))
    sizes = F.transform("b", lambda b: F.aggregate(b, F.lit(-1), lambda a, i: a + 1 + F.get("n", i)))
    two = two.withColumn("m", folds.merge_small(sizes, F.transform("b", lambda b: F.get("fixed", F.get(b, F.lit(0)))), 6))
    both = two.withColumn("own", folds.pack_and_merge(F.col("n"), F.col("opens"), F.col("fixed"), 11, 1, 0, 6)).coalesce(1).collect()
    assert [r["own"] for r in both] == [[[r["b"][i] for i in m] for m in r["m"]] if r["m"] is not None else None for r in both]
    assert both[0]["own"] == [[[0, 1], [2]], [[3], [4, 5]]] and both[1]["own"] == [] and both[2]["own"] is None and both[3]["own"] == [[[0]]]


def test_adjusted_segments_are_those_of_the_revised_boundaries(spark):
    from corpusflow.functions import folds

    rows = [([True, False, False, False], [0.1, 0.1, None, 0.5]), ([True, False, True], [None, 0.9, None]), ([], []), (None, None)]
    df = spark.createDataFrame(rows, "first array<boolean>, near array<double>")
    out = df.select(
        folds.adjusted_segments(F.col("first"), F.col("near"), 0.7, 0.2).alias("own"),
        folds.segments(folds.adjust_boundaries(F.col("first"), F.col("near"), 0.7, 0.2)).alias("two"),
        folds.running_total(F.transform("first", lambda f: f.cast("int"))).alias("total"),
    ).coalesce(1).collect()
    assert [r["own"] for r in out] == [r["two"] for r in out] == [[[0, 1], [2, 3]], [[0, 1, 2]], [], None]
    assert [r["total"] for r in out] == [[1, 1, 1, 1], [1, 1, 2], [], None]


def test_semantic_chunks_cover_the_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = chunking.semantic_chunks(docs, separator="\n").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_no", "text"))).alias("c")
    ).join(docs.select("doc_id", "text"), "doc_id").collect()
    for row in rows:
        assert "".join("".join(c["text"].split()) for c in row["c"]) == "".join(row["text"].split())


# --- near duplicates ------------------------------------------------------------------------------------------------------------


def greedy(texts, threshold=0.8):
    kept = []
    for i, text in enumerate(texts):
        normal = " ".join(text.lower().split())
        words = set(normal.split())
        if not words:
            continue
        for _, other, theirs in kept:
            if normal == other:
                break
            if abs(len(normal) - len(other)) > max(len(normal), len(other)) * (1 - threshold):
                continue
            if len(words & theirs) / len(words | theirs) >= threshold:
                break
        else:
            kept.append((i, normal, words))
    return {i for i, _, _ in kept}


def test_keep_first_decides_chains_and_webs(spark):
    """A chain of 200, a star, and random links, against the plain rule."""
    rng = random.Random(3)
    pairs = {(i + 1, i) for i in range(200)} | {(i, 300) for i in range(301, 340)}
    pairs |= {(b, a) for a, b in (sorted(rng.sample(range(400, 500), 2)) for _ in range(150))}
    ids, keeper = sorted({x for p in pairs for x in p} | {1000}), {}
    for i in ids:
        keeper[i] = min((a for b, a in pairs if b == i and keeper[a] is None), default=None)
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = dedup._keep_first(rows, spark.createDataFrame(sorted(pairs), "id bigint, lead bigint"))
    assert {r["id"]: r["keeper"] for r in got.collect()} == keeper and got.count() == len(ids)


def test_near_duplicates_share_a_word_of_every_document(spark):
    """Every document has the same words in front; each twentieth has a near copy, and those form chains of similar texts."""
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(6)
    texts = []
    for i in range(60):
        own = rng.sample(words, 30)
        texts += [own] if i % 20 else [own[:at] + [f"x{i}{at}"] + own[at + 1 :] for at in range(12)]
    rows = [(i, "every one " + " ".join(t)) for i, t in enumerate(texts)]
    kept, keeper = [], {}
    for i, t in rows:
        own = set(t.split())
        near = [k for k, o, m in kept if abs(m - len(t)) <= max(m, len(t)) * 0.2 and len(own & o) / len(own | o) >= 0.8]
        keeper[i] = min(near, default=None)
        if not near:
            kept.append((i, own, len(t)))
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["keeper"] for r in got.collect()} == keeper and len(kept) < len(rows)


def test_near_duplicates_match_the_loop(spark):
    """A third of the rows are copies of one text with small edits; both the rounds and the pairs way must be exact."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(20)]
    texts = []
    for i in range(90):
        if i % 3 == 0:
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dedup.near_duplicates(df).filter(F.col("keeper").isNull())
    assert {r["doc_id"] for r in got.collect()} == greedy(texts)


def test_near_duplicate_pairs_are_excluded_by_bitmaps(spark):
    """Rows that share one rare word: their words are compared only for the pairs that the bitmaps leave, similar ones among them."""
    rng = random.Random(9)
    texts = [" ".join(["rare", *rng.sample([f"w{i}" for i in range(4000)], size)]) for size in [40] * 8 + [170] * 8 + [700] * 8]
    texts += [t.replace("rare", "else") + " " + " ".join(f"x{i}" for i in range(more)) for t in texts for more in (1, len(t.split()) // 6)]
    words = [set(t.split()) for t in texts]
    pairs = [(b, a) for b in range(len(texts)) for a in range(b) if 0.8 <= len(words[a]) / len(words[b]) <= 1.25]
    alike = {(b, a) for b, a in pairs if len(words[a] & words[b]) / len(words[a] | words[b]) >= 0.8}
    sets = dedup._rare_first(dedup._word_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text"), 0.8)
    left = {(r["id"], r["lead"]) for r in dedup._by_bits(spark.createDataFrame(pairs, "id bigint, lead bigint"), sets, 0.8).collect()}
    assert alike <= left and 24 <= len(alike) and len(left) < len(alike) + (len(pairs) - len(alike)) / 20


def test_similar_sets_share_a_segment():
    """At the edge of the threshold, whatever the sizes and weights; sets that share half of their words seldom share one."""
    rng = np.random.default_rng(8)
    words = np.unique(rng.integers(-(2**63), 2**63 - 1, 3000))
    segments = dedup.Segments(words, rng.integers(0, 100, len(words)), 160, 0.8)
    chance = 0
    for size in [*range(1, 60), 97, 200, 333, 800, 2000]:
        for _ in range(4):
            own = rng.permutation(words)[:size]
            drop = int(rng.integers(0, size // 5 + 1))  # a of the words go, b come: (size - a) / (size + b) >= 0.8
            more = int((size - drop) / 0.8 + 1e-9) - size
            other = np.concatenate([own[drop:], rng.integers(-(2**63), 2**63 - 1, more)])
            assert (size - drop) / (size + more) >= 0.8
            mine = segments.of(rng.permutation(own))
            assert np.isin(mine, segments.of(other)).any() and len(mine) <= 0.5 * size + 3
            half = np.concatenate([own[: size // 2], rng.integers(-(2**63), 2**63 - 1, size - size // 2)])
            chance += size >= 40 and np.isin(mine, segments.of(half)).mean() > 0.25
    assert chance < 4


def test_pairs_are_excluded_where_they_are_made():
    rng = np.random.default_rng(5)
    sets = [rng.integers(-(2**63), 2**63 - 1, size) for size in (3, 40, 40, 300, 300)]
    sets += [np.append(s[1:], 7) for s in sets]
    kinds = np.array(dedup._parities(np.concatenate(sets), np.array([len(s) for s in sets]))).view(np.uint64)
    apart = np.bitwise_count(kinds[:, :, None] ^ kinds[:, None, :]).sum(axis=0)
    assert all(0 < apart[i, i + 5] <= 2 for i in range(5))
    assert apart[1, 2] > (40 + 40) / 9 and apart[3, 4] > (300 + 300) / 9


def test_rows_that_share_words_but_no_segment_do_not_meet(spark):
    """All share a word that is rare in the table; it was a bucket of all rows, and so of pairs of all rows."""
    rng = random.Random(12)
    rows = [(i, "rare " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)] + [(50, " ".join(f"w{i}" for i in range(60)))]
    rows += [(51, rows[-1][1] + " more"), (52, rows[3][1]), (53, rows[3][1].upper() + " "), (54, ""), (55, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    with dedup.scratch(spark) as keep:
        ids, index = dedup._meetings(df, 0.8, "doc_id", "text", keep)
        assert sorted(r["id"] for r in ids.collect()) == [*range(40), 50, 51]
        assert {50, 51} <= {r["id"] for r in index.collect()} and index.select("id").distinct().count() < 15
        assert {r["id"] for r in dedup._sets_of(df, index.select("id").distinct(), "doc_id", "text", keep).collect()} >= {50, 51}
    got = {r["doc_id"]: r["keeper"] for r in dedup.near_duplicates(df).collect()}
    assert got == {**dict.fromkeys([*range(40), 50]), 51: 50}


def test_near_duplicates_order_words_by_frequency(spark):
    """The order knows the frequent words however many rare ones there are: all share `every`, none has it in its prefix."""
    rows = [(i, "every " + " ".join(f"w{i}x{j}" for j in range(20)) + f" pair{i // 2}") for i in range(40)]
    sets = dedup._word_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    first = dedup._rare_first(sets, 0.8)
    assert first.filter(F.array_contains("prefix", F.xxhash64(F.lit("every")))).isEmpty()
    met = dedup._met(dedup._bucketed(first, 0.8))
    assert met.isEmpty()  # words of one row alone make no entries


def test_batch_cleaning_cleans_a_text_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def searched(text):
        seen.add(1)
        return text

    monkeypatch.setattr(dedup.T, "optimize_for_search", searched)
    df = spark.createDataFrame([(1, "one text"), (2, "One text"), (3, "other"), (4, " "), (5, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, dedup.clean_batch(df).collect())) == [(1, "one text"), (3, "other")]
    assert seen.value == 3


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "같다"), (2, " 같다 "), (3, "다르다")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in dedup.drop_exact_duplicates(df).collect()) == [1, 3]


# --- retrieval ---------------------------------------------------------------------------------------------------------------------


def test_grid_equals_broadcast(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = scoring.top_k(rows, queries, scoring.squared_distance, 5, False)
    grid = scoring.top_k(rows, queries, scoring.squared_distance, 5, False, max_queries=10)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, grid.collect()))


def test_lexical_grid_equals_broadcast(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    queries = spark.read.parquet(f"{small}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    terms = lexical.index_terms(F.col("text"))
    feats = lexical.numbered(lexical.features(docs, terms))
    rows = lexical.term_weights(docs, terms, feats).withColumnRenamed("doc_id", "id")
    asked = lexical.term_weights(queries, terms, feats, "query_id")
    near = scoring.top_k(rows, asked, scoring.sparse_product, 5, True)
    grid = scoring.top_k(rows, asked, scoring.sparse_product, 5, True, max_queries=3)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, grid.collect()))


def test_stored_index_of_batches_equals_a_scan(spark, small, monkeypatch, tmp_path):
    """Two batches, small blocks, several groups of questions, a word of every document: the same rows as without an index."""
    monkeypatch.setattr(inverted, "BLOCK", 16)
    monkeypatch.setattr(inverted, "QUERIES_AT_ONCE", 4)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.concat(F.lit("every one "), "text").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "the of"), (10_003, "word")], "doc_id bigint, text string"))
    asked = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.concat(F.lit("every "), "text").alias("text")).limit(12)
    asked = asked.unionByName(spark.createDataFrame([(-1, ""), (-2, "unheardofword")], "query_id bigint, text string"))
    path = str(tmp_path / "index")
    for part in range(2):
        inverted.add(docs.filter(F.col("doc_id") % 2 == part), path, batch=str(part))
    inverted.refresh(spark, path)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(inverted.tfidf_top_k(spark, path, asked)) == rows(lexical.tfidf_top_k(docs, asked))
    assert rows(inverted.bm25_top_k(spark, path, asked)) == rows(lexical.bm25_top_k(docs, asked))
    assert rows(inverted.keyword_hits(spark, path, asked)) == rows(lexical.keyword_hits(docs, asked))
    feats = lexical.features(docs, lexical.index_terms(F.col("text")))
    assert rows(inverted.features(spark, path).drop("term_id")) == rows(feats)
    products = {(r["query_id"], r["doc_id"]): r["product"] for r in inverted.inner_products(spark, path, asked).collect()}
    assert all(products[r["query_id"], r["doc_id"]] == r["similarity"] for r in inverted.tfidf_top_k(spark, path, asked).collect())
    largest = spark.read.parquet(f"{path}/terms").agg(F.max(F.size("docs"))).first()[0]
    assert 1 < largest <= 16
    inverted.add(spark.createDataFrame([(20_000, "unheardofword here")], "doc_id bigint, text string"), path, batch="2")
    assert [r["doc_id"] for r in inverted.bm25_top_k(spark, path, asked).filter("query_id = -2").collect()] == [20_000]  # before any refresh


def test_heavy_terms_are_exact(spark):
    """Terms spread over many local counts, ties at the limit: the same terms as a full count, whatever the counts leave out."""
    rng = random.Random(5)
    rows = [([(f"t{min(int(rng.paretovariate(0.7)), 3000)}", rng.randint(1, 3)) for _ in range(50)] + [("last", 1)],) for _ in range(60)]
    terms = spark.createDataFrame([([t for t in dict(r).items()],) for (r,) in rows], "terms array<struct<item:string,n:int>>").repartition(7)
    flat = terms.select(F.explode("terms").alias("t")).groupBy(F.col("t.item").alias("term")).agg(F.count("*").alias("df"), F.sum("t.n").alias("tf"))
    for k in (1, 10, 5000):
        wanted = [tuple(r) for r in flat.orderBy(F.desc("tf"), "term").limit(k).collect()]
        for most in (1, 20):
            assert [tuple(r) for r in inverted._heavy(terms, k, most).collect()] == wanted


def test_token_counts_are_exact_and_name_only_what_is_sent(spark, monkeypatch):
    """Counts of words and pairs by number: the terms of a full count, with ties at the limit and several local counts."""
    rng = random.Random(7)
    rows = [(" ".join(f"t{min(int(rng.paretovariate(0.7)), 300)}" for _ in range(rng.choice([1, 2, 60]))),) for _ in range(60)]
    tokens = spark.createDataFrame([*rows, (None,), ("single",)], "tokens string").repartition(5)
    flat = tokens.select(F.explode(inverted._of_tokens()).alias("t")).groupBy(F.col("t.item").alias("term")).agg(F.count("*").alias("df"), F.sum("t.n").alias("tf"))
    for k, most in ((1, 1), (10, 1), (10, 20), (5000, 20)):
        wanted = [tuple(r) for r in flat.orderBy(F.desc("tf"), "term").limit(k).collect()]
        assert [tuple(r) for r in inverted._heavy(tokens, k, most).collect()] == wanted
    monkeypatch.setattr(inverted, "MAX_BROADCAST_ROWS", 0)  # all are counted
    assert [tuple(r) for r in inverted._heavy(tokens, 5000, 20).collect()] == wanted


def test_a_part_of_the_index_is_built_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some common words {i} here" if i else None) for i in range(9)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame([(1, "common words 3"), (2, "here")], "query_id bigint, text string")
    terms, words = (inverted.stored(docs, docs, parts=(part,)) for part in inverted.PARTS)
    folders = lambda path: {p.name for p in pathlib.Path(path.removeprefix("file:")).iterdir()}
    assert folders(terms) == {"forward", "features", "terms"} and folders(words) == {"sizes", "words", "word_counts"}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(inverted.keyword_hits(spark, terms, asked, words_path=words)) == rows(lexical.keyword_hits(docs, asked))
    assert dict(spark.read.parquet(f"{terms}/forward").dtypes)["tokens"] == "string"  # no list of pairs


def test_tokens_of_few_documents_stay_in_place(spark, tmp_path):
    """The ids of few documents are sent to the stored tokens, which do not pass through a shuffle."""
    path = str(tmp_path / "index")
    spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, "bb")], "doc_id bigint, tokens string").write.parquet(f"{path}/forward/batch=1")
    spark.createDataFrame([("aa", 0, 3.0), ("aa bb", 1, 4.0), ("bb", 2, 1.0)], "term string, term_id int, idf double").write.parquet(f"{path}/features/version=1")
    ids = spark.createDataFrame([(1,), (2,)], "doc_id bigint").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = inverted.document_vectors(spark, path, ids)
        assert "rightHint=(strategy=broadcast)" in [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "LeftSemi" in line][0]
        (row,) = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    norm = (36 + 16 + 1) ** 0.5
    assert row["doc_id"] == 1 and dict(zip(row["words"], row["weights"])) == pytest.approx({"aa": 6 / norm, "aa bb": 4 / norm, "bb": 1 / norm})


def test_texts_of_few_results_stay_in_place(spark, tmp_path, monkeypatch):
    """The ranks of relevant results: the few results are sent to the documents, whose texts do not pass through a shuffle."""
    from corpusflow.plans import retrieval

    spark.createDataFrame([(i, f"some words {i} here") for i in range(9)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "words 3"), (2, "none")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 1, 8)], "query_id bigint, rank int, doc_id bigint")
    monkeypatch.setattr(retrieval, "find", lambda spark, sf: lambda asked, k: found)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranks = retrieval._best_ranks(spark, str(tmp_path))
        assert any("Join Inner, (doc_id" in line and "strategy=broadcast" in line for line in ranks._jdf.queryExecution().optimizedPlan().toString().split("\n"))
        assert {tuple(r) for r in ranks.collect()} == {(1, 2), (2, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_index_is_built_without_shuffled_postings(spark, tmp_path):
    """Every writing task holds all buckets of its own documents, so building does not pass through BUCKETS tasks."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some common words"), F.col("id").cast("string")).alias("text")).repartition(20)
    path = str(tmp_path / "index")
    inverted.add(docs, path)
    inverted.refresh(spark, path)
    one = spark.read.parquet(f"{path}/words").filter("term = 'common'").select(F.input_file_name().alias("f")).distinct().count()
    assert one > 4  # rows of a bucket came from at most four tasks


def test_topics_have_only_their_own_terms_and_means_round_as_sql(spark):
    texts = ["aa aa"] * 3 + ["bb cc"] * 3
    rows = [(1, i + 1, t, 0.654624 if i % 2 else 0.654625) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id bigint, rank int, text string, score double")
    got = {tuple(r["topic_terms"]) for r in context.split_results(df, "topic", 29).collect()}
    assert got == {("aa", "aa aa"), ("bb", "bb cc", "cc")}
    pairs = {q: (1 - round(0.1 + q * 0.001003, 6), 1 - round(0.100001 + q * 0.001003, 6)) for q in range(600)}
    df = spark.createDataFrame([(q, r + 1, "x", s[r]) for q, s in pairs.items() for r in (0, 1)], "query_id bigint, rank int, text string, score double")
    products = {q: (a + b) / 2 * 1e6 for q, (a, b) in pairs.items()}
    wanted = {q: (int(p) + (p - int(p) >= 0.5)) / 1e6 for q, p in products.items()}
    for strategy in ("size", "topic"):
        assert {r["query_id"]: r["relevance_score"] for r in context.split_results(df, strategy, 100).collect()} == wanted


def test_key_sentences_do_not_shuffle(spark, small):
    """Everything that a document's sentences need is in its row, so no posting and no text leaves it."""
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("title", F.substring_index("text", "\n", 1))
    for df in (summary.key_sentences(docs), summary.key_sentences(docs, query="title"), summary.summaries(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_arrow_words_are_those_of_the_columns(spark):
    import pyarrow as pa

    from corpusflow.functions import arrow_text

    texts = [None, "", " \u3000 ", "a b\u00a0c\u2028d\x1ce\x85f g\tH", "Ünïcode_1 가나다 라, x²½ 漢字仮名 don't e\u0301a ①②", "이다 있다 word the 10.5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    rows = df.select(T.split_words(F.col("text")).alias("w"), F.filter(T.tokens(F.col("text")), lambda w: ~w.isin(*V.CLEAN_STOPWORDS)).alias("t")).collect()
    assert arrow_text.words(pa.array(texts)).to_pylist() == [r["w"] or [] for r in rows]
    lowered = pa.array([t and t.lower() for t in texts])
    assert arrow_text.tokens(lowered, V.CLEAN_STOPWORDS).to_pylist() == [r["t"] or [] for r in rows]


def test_stored_index_follows_its_files(spark, tmp_path):
    folder = str(tmp_path / "docs")
    spark.createDataFrame([(1, "some words here"), (2, "other words there")], "doc_id bigint, text string").write.parquet(folder)
    read = lambda: spark.read.parquet(folder)
    first = inverted.stored(read(), read())
    assert inverted.stored(read(), read()) == first
    spark.createDataFrame([(3, "more words")], "doc_id bigint, text string").write.mode("append").parquet(folder)
    assert inverted.stored(read(), read()) != first


def test_mmr_is_greedy(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    queries = vector.centroids(vectors)
    got = vector.mmr(vectors, queries, 6).collect()
    data = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in vectors.collect()}
    near = {}
    for r in vector.vector_top_k(vectors, queries, 12).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for q in queries.collect():
        qv, pool, chosen = np.array(q["qvec"]), [v for _, v in sorted(near[q["query_id"]])], []
        while len(chosen) < 6:
            best = max((v for v in pool if v not in chosen), key=lambda v: 0.7 * cos(qv, data[v]) - 0.3 * max((cos(data[v], data[c]) for c in chosen), default=0.0))
            chosen.append(best)
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q["query_id"]), key=lambda r: r["rank"])] == chosen


def test_cell_recall_grows(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    queries = vector.centroids(vectors)
    exact = {(r["query_id"], r["vec_id"]) for r in vector.vector_top_k(vectors, queries, 10).collect()}
    celled, centres = vector.assign_cells(vectors, 8)
    celled = celled.persist()
    recall = [
        len(exact & {(r["query_id"], r["vec_id"]) for r in vector.cell_top_k(celled, centres, queries, 10, p).collect()}) for p in (1, 3, 8)
    ]
    celled.unpersist()
    assert recall[0] <= recall[1] <= recall[2] == len(exact)


def test_cells_are_pruned_and_split(spark, small, monkeypatch, tmp_path):
    """One question reads the files of its cells alone; small blocks of rows and questions give the same rows."""
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    queries = vectors.filter("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    centres = np.array([r["qvec"] for r in vector.centroids(vectors).orderBy("query_id").collect()])
    vector.store_cells(vectors, centres, str(tmp_path / "cells"))
    celled = spark.read.parquet(str(tmp_path / "cells"))
    assert celled.count() == vectors.count()
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(vector.cell_top_k(celled, centres, queries, 5, 2))
    monkeypatch.setattr(scoring, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(scoring, "QUERIES_PER_BLOCK", 4)
    assert rows(vector.cell_top_k(celled, centres, queries, 5, 2)) == whole
    plan = vector.cell_top_k(celled, centres, queries.limit(1), 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell_id" in plan
    found = vector.recall(vector.cell_top_k(celled, centres, queries, 5, len(centres)), vector.vector_top_k(vectors, queries, 5))
    assert {r["recall"] for r in found.collect()} == {1.0}


def test_scores(spark):
    row = spark.range(1).select(
        ranking.relevance(F.lit(0.0)).alias("a"), ranking.relevance(F.lit(2.0)).alias("b"),
        ranking.relevance(F.lit(0.95), True).alias("c"), ranking.relevance(F.lit(1.5), True).alias("d"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 0.95, 1.0)


def test_metrics(spark):
    ranks = spark.createDataFrame([(1,), (3,), (7,), (None,)], "best_rank int")
    assert ranking.retrieval_metrics(ranks).first()["hit_at_k"] == 0.5
    assert ranking.retrieval_metrics(spark.createDataFrame([(1,), (2,), (None,)], "best_rank int")).first()["mrr"] == 0.5
    empty = ranking.retrieval_metrics(ranks.filter("best_rank > 99")).first()
    assert (empty["cases"], empty["hit_at_k"], empty["mrr"]) == (0, 0.0, 0.0)


def test_best_rank(spark):
    results = spark.createDataFrame([(1, 1, "a.pdf"), (1, 2, "/data/몽촌토성4+상.pdf"), (1, 3, "b.pdf"), (2, 1, "a.pdf")], "query_id bigint, rank int, source string")
    golden = spark.createDataFrame([(1, ["몽촌토성4+상.pdf"]), (2, ["missing"])], "query_id bigint, expected array<string>")
    assert {r["query_id"]: r["best_rank"] for r in ranking.best_relevant_rank(results, golden, "source").collect()} == {1: 2, 2: None}


def test_dispatch(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    queries = spark.read.parquet(f"{small}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    asked = vectors.join(queries.select(F.col("query_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    for method in ("mmr", "vector", "hybrid"):
        counts = search.dispatch(docs, queries, vectors, asked, method, 5).groupBy("query_id").count().collect()
        assert len(counts) == 40 and all(0 < r["count"] <= 5 for r in counts)
    with pytest.raises(ValueError):
        search.dispatch(docs, queries, method="other")


# --- packing and answers --------------------------------------------------------------------------------------------------------------


def packed(spark, sizes, scores, strategy, limit=100):
    rows = [(1, i + 1, "x" * n, float(s)) for i, (n, s) in enumerate(zip(sizes, scores))]
    df = spark.createDataFrame(rows, "query_id bigint, rank int, text string, score double")
    return [(r["chunk_id"], r["total_length"], r["ranks"]) for r in context.pack_results(df, strategy, limit).orderBy("chunk_no").collect()]


def test_packing(spark):
    assert [n for _, n, _ in packed(spark, [60, 60, 60], [1, 1, 1], "size")] == [60, 60, 60]
    large = packed(spark, [20, 300, 20], [1, 1, 1], "size")
    assert large[1] == ("large_doc_chunk_1", 300, "2")
    assert packed(spark, [60, 60], [0.3, 0.9], "relevance")[0][2] == "2"
    assert packed(spark, [10, 20], [0.3, 0.9], "relevance") == [("single_chunk", 30, "2,1")]
    with pytest.raises(ValueError):
        packed(spark, [1], [1], "other")


def test_images_in_place(spark):
    """Images at the markers of their pages, in their order; what is left over under a heading; texts without images as they are."""
    rows = [(1, "<!-- 페이지 1 시작 -->\n one \n<!-- 페이지 2 시작 -->\n\ntwo\n<!-- 페이지 x 시작 -->"), (2, "plain\n<!-- 페이지 7 시작 -->\ntext"), (3, None), (4, "  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    images = spark.createDataFrame([(1, 1, 0, "![a]"), (1, 2, 1, "![c]"), (1, 2, 0, "![b]"), (1, 3, 0, "![d]"), (3, 1, 0, "![e]")], "doc_id bigint, page int, seq int, reference string")
    got = {r["doc_id"]: r["out"] for r in structure.place_images(docs, images).collect()}
    assert got == {1: "\n![a]\n\none\n\n![b]\n\n\n![c]\n\n\ntwo\n\n\n## 추가 이미지\n\n![d]", 2: "plain\ntext"}
    assert structure.place_images(docs.limit(0), images).count() == 0


def test_topic_packing_per_question(spark):
    """Two subjects apart, oversize topics by size, few results by relevance, small contexts as one chunk."""
    cats, cars = "cat purr whisker kitten meow", "engine wheel brake gear motor"
    rows = [(1, i + 1, f"{cats if i % 2 else cars} " * 2 + str(i), 1.0 - i / 10) for i in range(6)]
    rows += [(2, 1, "a" * 300, 0.2), (2, 2, "b" * 300, 0.9), (3, 1, "short", 0.5), (4, 1, None, 0.5), (4, 2, "", 0.4)]
    df = spark.createDataFrame(rows, "query_id bigint, rank int, text string, score double")
    got = {}
    for r in context.split_results(df, "topic", 200).orderBy("query_id", "chunk_no").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["ranks"], sorted(r["topic_terms"])))
    assert [(n, r) for n, r, _ in got[1]] == [("topic_chunk_0", "1,3,5"), ("topic_chunk_1", "2,4,6")]
    assert set(got[1][0][2]) <= {t for a in cars.split() for t in (a, *(f"{a} {b}" for b in cars.split()))} and len(got[1][0][2]) == 5
    assert got[2] == [("relevance_chunk_0", "2", []), ("relevance_chunk_1", "1", [])] and got[3] == [("single_chunk", "1", [])] and got[4][0][0] == "single_chunk"
    large = context.split_results(df.filter("query_id = 1"), "topic", 100).orderBy("chunk_no").collect()
    assert [r["chunk_id"] for r in large] == ["size_chunk_0", "size_chunk_1", "size_chunk_2"] * 2 and all(r["topic_terms"] == [] for r in large)
    hybrid = context.split_results(df.filter("query_id = 1"), "hybrid", 200).orderBy("chunk_no").collect()
    assert [r["chunk_id"] for r in hybrid] == ["relevance_chunk_0"] * 2 and [r["ranks"] for r in hybrid] == ["1,3,5", "2,4,6"]
    summary = context.packing_summary(context.split_results(df, "topic", 200)).filter("query_id = 1").first()
    assert [len(c["topics"]) for c in summary["chunk_distribution"]] == [3, 3]
    with pytest.raises(ValueError):
        context.split_results(df, "other", 10)


def test_answer_formatting(spark):
    rows = [(1, "핵심 요약\n하나\n상세 설명\n1. 둘\n참고 자료\n셋"), (2, "첫 문단\n\n둘째 문단"), (3, "오류가 났습니다.")]
    df = spark.createDataFrame(rows, "query_id bigint, text string")
    refs = spark.createDataFrame([(2, "- [출처 1] a.pdf")], "query_id bigint, references string")
    got = {r["query_id"]: r["out"] for r in structure.format_answers(df, refs).collect()}
    assert got[1] == "### 핵심 요약\n하나\n\n### 상세 설명\n- 둘\n\n### 참고 자료\n셋"
    assert got[2] == "### 핵심 요약\n첫 문단\n\n### 상세 설명\n둘째 문단\n\n### 참고 자료\n- [출처 1] a.pdf"
    assert got[3] == "오류가 났습니다."


def test_model_hook(spark):
    df = spark.createDataFrame([(1, "질문"), (2, "둘")], "query_id bigint, prompt string")
    good = context.answer_prompts(df, lambda prompts: [p + "!" for p in prompts]).orderBy("query_id").collect()
    assert [r["result"] for r in good] == ["질문!", "둘!"] and all(r["success"] for r in good)

    def broken(prompts):
        raise RuntimeError("down")

    assert not any(r["success"] for r in context.answer_prompts(df, broken).collect())


# --- summaries --------------------------------------------------------------------------------------------------------------------------


def test_summaries(spark):
    docs = spark.createDataFrame([(1, "하나. 둘. 셋."), (2, "")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in summary.summaries(docs).collect()}
    assert rows[1]["sentences"] == ["하나.", "둘.", "셋."] and rows[1]["summary"] == "하나. 둘. 셋."
    assert rows[2]["importance_score"] == 0.0 and rows[2]["summary"] == ""
    three = spark.createDataFrame([(["가" * 40 + " " + "나" * 39] * 3,)], "s array<string>")
    assert len(three.select(summary.extractive_summary(F.col("s"), 100).alias("x")).first()["x"]) <= 110


def test_importance_likes_facts(column):
    plain, facts = column(["평범한 문장이다", "1998년 3월 2일 30% 5개 2명"], summary.importance)
    assert facts > plain


def test_summary_length(spark):
    df = spark.createDataFrame([(0,), (10,), (300,), (9000,)], "n int")
    assert [r[0] for r in df.select(summary.summary_length(F.col("n"))).collect()] == [500, 150, 300, 500]


def test_levels_shrink(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["level"]: r for r in summary.level_statistics(summary.multi_level(docs)).collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0]["total_summary_length"] >= rows[1]["total_summary_length"] >= rows[2]["total_summary_length"]
    assert rows[1]["total_original_length"] == rows[0]["total_summary_length"]


# --- expansion ------------------------------------------------------------------------------------------------------------------------------


def test_question_terms(column):
    got = column(["몽촌토성에서 발굴조사로 확인된 토기편은 무엇인가요?", "a " * 20 + " ".join(f"단어{i}" for i in range(12))], expansion.question_terms)
    assert {"몽촌토성", "발굴조사", "토기편"} <= set(got[0])
    assert len(got[1]) == 8 == len(set(got[1]))


def test_highlight(column):
    assert column(["몽촌토성은 백제의 토성이다."], lambda c: expansion.highlight(c, F.array(F.lit("몽촌토성")))) == ["**몽촌토성**은 백제의 토성이다."]


def test_source_preview(column):
    text = "\n\n".join(["하나", "토기편 토기편", "셋", "넷", "다섯"])
    out = column([text], lambda c: expansion.source_preview(c, F.lit("토기편은")))[0]
    assert "**토기편** **토기편**" in out and "뒤 문단 2개 생략" in out and "앞 문단" not in out
    assert column([""], lambda c: expansion.source_preview(c, F.lit("토기편"))) == ["- 출처 본문이 비어 있습니다."]


def test_expansion_of_hangul(column):
    got = column(["정보시스템 구축 방법은?"], expansion.expand_keywords)[0]
    assert got[:2] == ["정보시스템", "구축"] and "전산시스템" in got and len(got) <= 25
    assert column(["몽촌토성 고배는 뭐야"], expansion.rewrite_query) == ["몽촌토성 고배는 뭐야 백제 토기 유물"]
    assert column(["북문 조사"], expansion.static_expansion) == ["북문 북문지 북쪽문 북측 조사"]


# --- reports ------------------------------------------------------------------------------------------------------------------------------------


def test_numbering_over_ranges(spark):
    rows = [(k, t) for k, n in (("hot", 500), ("cold", 7)) for t in range(0, n * 3, 3)]
    df = spark.createDataFrame(rows, "k string, t bigint")
    got = reports.numbered(df, "t", ("k",)).collect()
    assert all(r["position"] == r["t"] // 3 for r in got)


def test_numbering_of_sparse_ids(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    got = [r["position"] for r in reports.numbered(df, "h").orderBy("h").collect()]
    assert got == list(range(3000))


def test_layout_pages(spark):
    rows = [(1, 0, 1, 0, "header", "머리"), (1, 0, 1, 1, "paragraph", "1쪽 본문"), (1, 0, 2, 2, "table", "| 표 |"), (1, 0, 2, 3, "footer", "꼬리"), (1, 2, 1, 4, "paragraph", "3쪽 본문")]
    df = spark.createDataFrame(rows, "doc_id bigint, batch_start int, page int, seq int, category string, markdown string")
    assert [(r["page"], r["text"]) for r in structure.assemble_pages(df).orderBy("page").collect()] == [(1, "1쪽 본문"), (2, "| 표 |"), (3, "3쪽 본문")]


def test_sections(spark):
    df = spark.createDataFrame([(1, "머리말\n### 핵심 요약\n하나\n## 상세 설명:\n둘"), (2, "제목 없음")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["section_no"], r["kind"], r["body"]) for r in structure.answer_sections(df).collect())
    assert got[0] == (1, 0, "summary", "머리말\n\n하나") and got[-1] == (2, 0, "other", "제목 없음")


def test_dictionary_from_a_file(spark, tmp_path):
    path = tmp_path / "terms.json"
    path.write_text('{"key": "a", "terms": ["b", "c"]}\n{"key": "d", "terms": ["e"]}\n{"key": "a", "terms": ["f"]}\n', encoding="utf-8")
    entries = expansion.load_dictionary(spark, str(path))
    assert entries == {"a": ("b", "c", "f"), "d": ("e",)}
    df = spark.createDataFrame([(["d"],)], "k array<string>")
    assert df.select(expansion.synonyms(F.col("k"), entries).alias("s")).first()["s"] == ["e"]
