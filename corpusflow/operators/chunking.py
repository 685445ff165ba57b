"""Cutting documents into chunks.  One document is one row throughout, so nothing here shuffles except statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import folds
from corpusflow.functions import sentences as L
from corpusflow.functions import text as T


def sliding_chunks(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, text): windows of `size` characters every `size - overlap`."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    return docs.filter(F.length("text") > 0).select(
        key, F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(size)))).alias("chunk_index", "text")
    )


# --- recursive splitter ----------------------------------------------------------------------------------------------------------


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, keeping it at the head of the piece it opens."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _windows(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces up to `size`; each window starts with the last pieces of the one before, up to `overlap`."""
    held: list[str] = []
    used = 0
    for piece in pieces:
        if held and used + len(piece) > size:
            yield "".join(held)
            drop = 0
            while used > overlap or (used and used + len(piece) > size):
                used -= len(held[drop])
                drop += 1
            held = held[drop:]
        held.append(piece)
        used += len(piece)
    if held:
        yield "".join(held)


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Pieces at the first separator that occurs; pieces still too long are cut by the separators after it."""
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    run: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            run.append(piece)
            continue
        yield from _windows(run, size, overlap)
        run = []
        if level + 1 < len(separators):
            yield from split_recursively(piece, size, overlap, separators[level + 1 :])
        else:
            yield piece
    yield from _windows(run, size, overlap)


def recursive_chunks(
    docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP,
    separators: tuple[str, ...] = V.DEFAULT_SEPARATORS, key: str = "doc_id",
) -> DataFrame:
    """(key, chunks): stripped chunks of each document, in order.  A map over Arrow batches of whole documents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [
                [c for c in (p.strip() for p in split_recursively(t, size, overlap, separators)) if c] if t else []
                for t in batch["text"]
            ]
            yield pd.DataFrame({key: batch[key], "chunks": parts})

    return docs.select(key, "text").mapInPandas(cut, f"{key} bigint, chunks array<string>")


def merge_short_chunks(
    chunked: DataFrame, size: int = V.CHUNK_SIZE, short: int = 500, ratio: float = 1.5, keep: int = 100, key: str = "doc_id"
) -> DataFrame:
    """(key, chunks, dropped): short chunks merged into the one before; `dropped` counts the ones too short to stay."""
    sizes = F.transform("chunks", lambda c: F.length(T.strip(c)))
    raw = F.transform("chunks", F.length)
    grouped = chunked.withColumn("g", folds.merge_short(sizes, raw, short, size * ratio, keep))

    def merged(g: Column) -> Column:
        first = F.get("chunks", F.get(g, F.lit(0)))
        rest = F.transform(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), lambda i: T.strip(F.get("chunks", i)))
        return T.join(F.concat(F.array(first), rest), "\n\n")

    return grouped.select(
        key, F.transform("g", merged).alias("chunks"), (F.size("chunks") - F.size(F.flatten("g"))).alias("dropped")
    )


def default_chunks(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    return merge_short_chunks(recursive_chunks(docs, size, overlap, V.DEFAULT_SEPARATORS, key), size, key=key)


def markdown_chunks(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    return merge_short_chunks(
        recursive_chunks(docs, size, overlap, V.MARKDOWN_SEPARATORS, key), size, 200, 1.3, 50, key
    )


def chunk_documents(docs: DataFrame, kind: str = "default", size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, total_chunks, text, chunk_size, processing_method) by strategy; colophon chunks are left out."""
    builders = {
        "md": (markdown_chunks, "markdown_optimized"),
        "semantic": (semantic_chunk_lists, "semantic"),
        "default": (default_chunks, "enhanced_default"),
    }
    if kind not in builders:
        raise ValueError(f"unknown chunking strategy: {kind}")
    build, method = builders[kind]
    listed = build(docs, key=key) if kind == "semantic" else build(docs, size, overlap, key)
    return number_chunks(listed.select(key, F.filter("chunks", lambda c: ~is_colophon(c)).alias("chunks")), method, key)


def is_colophon(text: Column) -> Column:
    return T.matches(text, V.COLOPHON)


def number_chunks(listed: DataFrame, method: str, key: str = "doc_id") -> DataFrame:
    """Chunk rows with id, index, total and size; the total is known inside the row."""
    rows = listed.select(key, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text"))
    return rows.select(
        F.format_string("%s_%04d", F.col(key).cast("string"), "chunk_index").alias("chunk_id"), key, "chunk_index",
        "total_chunks", "text", F.length("text").alias("chunk_size"), F.lit(method).alias("processing_method"),
    )


# --- paragraph packing -----------------------------------------------------------------------------------------------------------


def packed_paragraphs(
    docs: DataFrame, limit: int = 1200, minimum: int = 300, separator: str = "\n\n", key: str = "doc_id"
) -> DataFrame:
    """(key, chunks): stripped paragraphs packed up to `limit`; a chunk closes only once it has `minimum` characters."""
    listed = docs.select(key, L.paragraphs(F.col("text"), separator).alias("p"))
    grouped = listed.withColumn("g", folds.pack(F.transform("p", F.length), limit, 2, minimum))
    return grouped.select(key, folds.assemble(F.col("p"), F.col("g"), "\n\n").alias("chunks"))


def boundary_chunks(
    docs: DataFrame, target: int = V.CLEANUP_TARGET, maximum: int = V.CLEANUP_MAX, separator: str = r"\n\s*\n", key: str = "doc_id"
) -> DataFrame:
    """(key, chunks): about `target` characters, cut only after a paragraph whose last line ends a sentence."""
    listed = docs.select(key, F.split(T.strip(F.col("text")), T.java(separator)).alias("p"))

    def safe(paragraph: Column) -> Column:
        rows = F.filter(T.lines(paragraph), lambda line: T.strip(line) != "")
        return F.coalesce(~L.ends_mid_sentence(F.get(rows, F.size(rows) - 1)), F.lit(False))

    cuts = folds.cut_at_boundaries(F.transform("p", F.length), F.transform("p", safe), target, maximum)
    return listed.withColumn("g", cuts).select(key, folds.assemble(F.col("p"), F.col("g"), "\n\n").alias("chunks"))


def blocks(docs: DataFrame, limit: int = 3000, separator: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """(key, chunks): paragraphs packed up to `limit`; a text within the limit stays as it is."""
    listed = docs.select(key, "text", F.split("text", T.java(separator)).alias("p"))
    grouped = listed.withColumn("g", folds.pack(F.transform("p", F.length), limit, 2))
    cut = F.filter(folds.assemble(F.col("p"), F.col("g"), "\n\n"), lambda c: c != "")
    return grouped.select(key, F.when(F.length("text") <= limit, F.array("text")).otherwise(cut).alias("chunks"))


# --- semantic chunking --------------------------------------------------------------------------------------------------------------

WORDS = r"[가-힣]{2,}|[A-Za-z]{3,}|\d+"
NEAR, APART = 0.7, 0.2  # keyword overlaps of neighbours beyond which a boundary goes or comes


def refined_paragraphs(text: Column, limit: int = V.SEMANTIC_MAX, separator: str = "\n\n") -> Column:
    """Items and their break flags: whole paragraphs, or the sentences of one that is too long."""

    def item(words: Column, first: Column) -> Column:
        return F.struct(words.alias("t"), first.alias("first"))

    def expand(p: Column) -> Column:
        cut = F.transform(L.split_sentences(p), lambda s, i: item(s, i == 0))
        return F.when(F.length(p) > limit, cut).otherwise(F.array(item(p, F.lit(True))))

    return F.flatten(F.transform(L.paragraphs(text, separator), expand))


def paragraph_lists(docs: DataFrame, limit: int = V.SEMANTIC_MAX, separator: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """(key, p): paragraphs, the over-long ones re-packed by sentence."""
    listed = docs.select(key, refined_paragraphs(F.col("text"), limit, separator).alias("i"))
    texts = F.transform("i", lambda x: x["t"])
    flags = F.transform("i", lambda x: x["first"])
    groups = folds.pack(F.transform(texts, F.length), limit, 1, 0, 0, flags)
    grouped = listed.withColumn("g", groups)
    # bound once: inside assemble the texts would be made again for every position
    return grouped.select(key, T.let(texts, lambda t: folds.assemble(t, F.col("g"), " ")).alias("p"))


def keywords(text: Column, domain=V.DOMAIN_KEYWORDS, top: int = 20) -> Column:
    """array<struct<score, term>> of the best keywords: relative frequency, doubled for domain terms, less for long or
    numeric ones; ties keep the order of first occurrence."""

    def scored(words: Column) -> Column:
        def weight(term: Column) -> Column:
            return (
                F.when(term.isin(*domain), 2.0).otherwise(1.0)
                * F.when(F.length(term) > 10, 0.8).otherwise(1.0)
                * F.when(T.matches(term, r"^\d+$"), 0.7).otherwise(1.0)
            )

        rows = F.transform(
            T.first_seen_counts(words),
            lambda r: F.struct(
                (-(r["n"] / F.size(words)) * weight(r["item"])).alias("s"),
                r["first"].alias("at"),
                r["item"].alias("term"),
            ),
        )
        return F.transform(
            F.slice(F.sort_array(rows), 1, top), lambda r: F.struct((-r["s"]).alias("score"), r["term"].alias("term"))
        )

    return T.let(F.regexp_extract_all(text, F.lit(T.java(WORDS)), F.lit(0)), scored)


def transition_score(paragraph: Column, current: Column, previous: Column, similarity: float = V.SEMANTIC_SIMILARITY) -> Column:
    """How strongly a paragraph starts a new topic, from its words and its keyword overlap with the one before."""
    cues = sum(
        (F.when(T.contains_any(paragraph, words), V.TRANSITION_WEIGHTS[kind]).otherwise(0.0) for kind, words in V.TRANSITION_KEYWORDS.items()),
        F.lit(0.0),
    )
    near = keyword_overlap(current, previous)
    change = F.when(near < similarity, (1.0 - near) * 2.0).otherwise(0.0)
    return cues + change + F.when(T.matches_any(paragraph, V.TRANSITION_STRUCTURES), 3.0).otherwise(0.0)


def keyword_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two term arrays, null when either is empty."""
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def topic_boundaries(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, p, kw, first, final): paragraph lists with first and adjusted boundary flags."""
    listed = paragraphs.withColumn("kw", F.transform("p", lambda p: keywords(p)))
    terms = listed.withColumn("terms", F.transform("kw", lambda k: F.transform(k, lambda x: x["term"])))
    score = F.transform(
        "p",
        lambda p, i: F.when(i == 0, 0.0).otherwise(
            transition_score(p, F.get("terms", i), F.get("terms", F.greatest(i - 1, F.lit(0))))
        ),
    )
    near = F.transform("terms", lambda t, i: keyword_overlap(t, F.coalesce(F.get("terms", i + 1), F.array().cast("array<string>"))))
    marked = terms.withColumn("score", score).withColumn("near", near)
    marked = marked.withColumn("first", F.transform("score", lambda s: s >= 2.0))
    return marked.withColumn("final", folds.adjust_boundaries(F.col("first"), F.col("near"), NEAR, APART))


def merge_keywords(entries: Column) -> Column:
    """Scores summed per term, best first; ties keep the order of first occurrence.

    Entries are sorted by term and place; every run of a term is summed once, so the cost follows the number of entries.
    """

    def summed(rows: Column) -> Column:
        count = F.size(rows)
        first = F.filter(F.sequence(F.lit(0), count - 1), lambda i: (i == 0) | (F.get(rows, i)["term"] != F.get(rows, i - 1)["term"]))

        def runs(starts: Column) -> Column:
            return F.transform(starts, lambda low, j: F.struct(
                (-F.aggregate(F.slice(rows, low + 1, F.coalesce(F.get(starts, j + 1), count) - low), F.lit(0.0), lambda a, e: a + e["score"])).alias("s"),
                F.get(rows, low)["at"].alias("at"), F.get(rows, low)["term"].alias("term"),
            ))

        return F.transform(F.sort_array(T.let(first, runs)), lambda r: F.struct((-r["s"]).alias("score"), r["term"].alias("term")))

    ordered = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["term"].alias("term"), i.alias("at"), e["score"].alias("score"))))
    none = F.array().cast("array<struct<score:double,term:string>>")
    return T.let(ordered, lambda rows: F.when(F.size(rows) > 0, summed(rows)).otherwise(none))


def semantic_chunks(
    docs: DataFrame, minimum: int = V.SEMANTIC_MIN, maximum: int = V.SEMANTIC_MAX, separator: str = "\n\n", key: str = "doc_id"
) -> DataFrame:
    """(key, chunk_no, text, kw): segments between topic boundaries, small ones merged, large ones re-cut by sentence."""
    marked = topic_boundaries(paragraph_lists(docs, maximum, separator, key), key)
    cut = marked.withColumn("g", folds.adjusted_segments(F.col("first"), F.col("near"), NEAR, APART))

    def unit(words: Column, opens: Column, piece: Column, kw: Column) -> Column:
        return F.struct(words.alias("t"), opens.alias("first"), piece.alias("piece"), kw.alias("kw"))

    none = F.slice(F.get("kw", F.lit(0)), 1, 0)

    def expand(g: Column) -> Column:
        joined = F.array_join(F.transform(g, lambda i: F.get("p", i)), "\n\n")
        merged = merge_keywords(F.flatten(F.transform(g, lambda i: F.get("kw", i))))
        return T.let(
            joined,
            lambda t: F.when(
                F.length(t) > maximum,
                F.transform(L.split_sentences(t), lambda s, i: unit(s, i == 0, F.lit(True), none)),
            ).otherwise(F.array(unit(t, F.lit(True), F.lit(False), merged))),
        )

    items = cut.select(key, F.flatten(F.transform("g", expand)).alias("i"))
    sizes, opens, pieces = F.transform("i", lambda x: F.length(x["t"])), F.transform("i", lambda x: x["first"]), F.transform("i", lambda x: x["piece"])
    packed = items.withColumn("m", folds.pack_and_merge(sizes, opens, pieces, maximum, 1, 0, minimum))

    def rebuilt(b: Column) -> Column:
        head = F.get("i", F.get(b, F.lit(0)))
        t = T.strip(F.array_join(F.transform(b, lambda i: F.get("i", i)["t"]), " "))
        return F.struct(
            t.alias("t"), head["piece"].alias("piece"), F.when(head["piece"], keywords(t)).otherwise(head["kw"]).alias("kw")
        )

    def chunk(units: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(units, lambda u: u["t"]), "\n\n").alias("text"),
            merge_keywords(F.flatten(F.transform(units, lambda u: u["kw"]))).alias("kw"),
        )

    chunks = F.transform("m", lambda bins: T.let(F.transform(bins, rebuilt), chunk))
    return packed.select(key, F.posexplode(chunks)).select(key, F.col("pos").alias("chunk_no"), "col.text", "col.kw")


def chunk_topics(chunks: DataFrame, domain=V.DOMAIN_KEYWORDS) -> DataFrame:
    """Chunks with coherence 1 / (1 + std of the ten best scores) and the share of domain keywords."""
    scores = F.transform(F.slice("kw", 1, 10), lambda k: k["score"])

    def spread(s: Column) -> Column:
        mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
        return F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(s))

    total = F.aggregate("kw", F.lit(0.0), lambda a, k: a + k["score"])
    domain_total = F.aggregate(F.filter("kw", lambda k: k["term"].isin(*domain)), F.lit(0.0), lambda a, k: a + k["score"])
    coherence = (
        F.when(F.size("kw") == 0, 0.0).when(F.size(scores) < 2, 0.5).otherwise(F.least(F.lit(1.0), 1.0 / (1.0 + T.let(scores, spread))))
    )
    return chunks.select(
        "*", coherence.alias("topic_coherence"),
        F.when(total > 0, F.least(F.lit(1.0), domain_total / total)).otherwise(0.0).alias("domain_relevance"),
    )


def semantic_chunk_lists(docs: DataFrame, key: str = "doc_id", separator: str = "\n\n", maximum: int = V.SEMANTIC_MAX) -> DataFrame:
    rows = semantic_chunks(docs, maximum=maximum, separator=separator, key=key)
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))).alias("c")).select(
        key, F.transform("c", lambda c: c["text"]).alias("chunks")
    )


# --- chunk rows -----------------------------------------------------------------------------------------------------------------------


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    size = F.length("text")
    return chunks.agg(
        F.count("*").alias("chunks"), F.round(F.avg(size), 6).alias("avg_size"), F.min(size).alias("min_size"),
        F.max(size).alias("max_size"), F.sum(size).alias("total_chars"),
    )


def neighbour_context(listed: DataFrame, chars: int = V.CLEANUP_CONTEXT, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, before, text, after): the end of the previous chunk and the start of the next, markers dropped."""

    def row(c: Column, i: Column) -> Column:
        before = T.drop_page_markers(F.right(F.get("chunks", i - 1), F.lit(chars)))
        after = T.drop_page_markers(F.left(F.get("chunks", i + 1), F.lit(chars)))
        return F.struct(
            F.when(i == 0, "(문서 시작)").otherwise(before).alias("before"), c.alias("text"),
            F.when(i + 1 >= F.size("chunks"), "(문서 끝)").otherwise(after).alias("after"),
        )

    return listed.select(key, F.posexplode(F.transform("chunks", row))).select(
        key, F.col("pos").alias("chunk_no"), "col.before", "col.text", "col.after"
    )


def accept_corrections(
    chunks: DataFrame, original: str = "text", corrected: str = "corrected", ratio: tuple[float, float] = V.CLEANUP_RATIO
) -> DataFrame:
    """Corrected text where it keeps the visible length, the page markers and the table rows; else the original."""

    def visible(c: str) -> Column:
        return F.length(T.sub(F.col(c), r"\s"))

    def markers(c: str) -> Column:
        return F.regexp_extract_all(c, F.lit(T.java(V.PAGE_MARKER, "m")), F.lit(0))

    share = visible(corrected) / F.greatest(visible(original), F.lit(1))
    same = (markers(original) == markers(corrected)) & (
        T.count_matches(F.col(original), r"^\|", "m") == T.count_matches(F.col(corrected), r"^\|", "m")
    )
    faithful = F.coalesce(share.between(*ratio) & same, F.lit(False))
    return chunks.withColumn("accepted", faithful).withColumn(
        "result", F.when(faithful, F.col(corrected)).otherwise(F.col(original))
    )


def attach_images(chunks: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document-level image metadata on every chunk of the document: one row per document, so the join cannot fan out."""
    per_document = images.groupBy(key).agg(F.count("*").alias("image_count"))
    return chunks.join(per_document, key, "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))
