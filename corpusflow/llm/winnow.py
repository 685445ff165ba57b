"""Benchmark passages in documents: winnowed fingerprints find the documents, exact windows mark the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import ascii_lower, text_of
from corpusflow.llm.spans import let
from corpusflow.session import MAX_BROADCAST_ROWS, cut_lineage, within

WINDOW, GRAM = 10, 5  # every shared span of WINDOW words has a shared fingerprint
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lowered


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NO_WORD), "")


def _grams(of: Column, k: int) -> Column:
    """Hashes of all k consecutive words, in order; none if there are fewer words."""
    count = F.size(of) - k
    hashes = F.transform(F.sequence(F.lit(0), count), lambda i: F.xxhash64(F.lit(k), *[F.get(of, i + j) for j in range(k)]))
    return F.when(count >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def fingerprints(of: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The least hash of every `window - gram + 1` consecutive grams, each once: what two texts that share `window` words share."""
    span = window - gram + 1

    def least(grams: Column) -> Column:
        count = F.size(grams) - span
        lows = F.transform(F.sequence(F.lit(0), count), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))
        return F.when(count >= 0, F.array_distinct(lows)).otherwise(F.array().cast("array<bigint>"))

    return let(_grams(of, gram), least)


def _windows(of: Column, length: int) -> Column:
    """(start, window): all `length` consecutive words as one text, with where they start."""
    count = F.size(of) - length
    made = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(of, i + 1, length), " ").alias("window")))
    return F.when(count >= 0, made).otherwise(F.array().cast("array<struct<start:int,window:string>>"))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint where a count proves the side small; else the join shuffles."""
    return F.broadcast(df) if within(df, MAX_BROADCAST_ROWS) else df


def _covered(spans: Column) -> Column:
    """Number of words under spans (start, length)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(F.lit(0), end - F.greatest(state["end"], span["start"]))).alias("n"))

    return F.aggregate(F.sort_array(spans), start, step, lambda s: s["n"])


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, hash of the text and text: rows with equal keys and texts have equal results."""
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_of(text)).alias("body_hash"), text_of(text).alias("body"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, body_hash, n_hit, items) of the documents in which some window of an item occurs; items sorted as strings.

    1. An item's windows are its `window` consecutive words; an item of fewer words is one window of its length.
    2. Documents and items are winnowed; fingerprints (and, for the short lengths that items have, plain grams) are joined.
       Any shared window has a shared fingerprint, so no hit is lost; what is left are a few documents.
    3. In those, all windows are joined with the items' windows as texts, and the words under the hits are counted.

    Null texts have no words. An item without an id marks words but is not listed. Items and documents may repeat: a
    document's row is given once for each distinct (doc_id, text). Empty tables give no rows.
    """
    rows = _keyed(docs, key, text)
    items = benchmark.select(F.col(item_key).alias("item_id"), words(text_of(item_text)).alias("w")).filter(F.size("w") > 0)
    items = cut_lineage(items.withColumn("length", F.least(F.size("w"), F.lit(window))))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # 1 to window
    short = [n for n in lengths if n < window]

    def prints(w: Column) -> Column:
        return F.concat(fingerprints(w, window, gram), *[F.array_distinct(_grams(w, n)) for n in short])

    item_prints = F.when(F.col("length") == window, fingerprints(F.col("w"), window, gram))
    for n in short:
        item_prints = item_prints.when(F.col("length") == n, _grams(F.col("w"), n))
    wanted = cut_lineage(items.select(F.explode(item_prints).alias("print")).distinct())
    probed = rows.select("doc_id", "body_hash", F.explode(let(words(F.col("body")), prints)).alias("print"))
    hit = cut_lineage(probed.join(_small(wanted), "print", "left_semi").select("doc_id", "body_hash").distinct())

    def both(w: Column) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("length"), _windows(w, n).alias("at")) for n in lengths or [window]])

    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("body_hash") == F.col("hit_hash"))
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("body_hash").alias("hit_hash"))
    found = rows.join(_small(hit), same, "left_semi").select("doc_id", "body_hash", F.explode(let(words(F.col("body")), both)).alias("l"))
    found = found.select("doc_id", "body_hash", "l.length", F.explode("l.at").alias("a")).select("doc_id", "body_hash", "length", "a.*")
    item_windows = items.select("item_id", F.explode(let(F.col("w"), both)).alias("l"), F.col("length").alias("own")).filter(F.col("l.length") == F.col("own"))
    item_windows = item_windows.select("item_id", "l.length", F.explode("l.at.window").alias("window")).distinct()
    hits = found.join(_small(item_windows), ["length", "window"])
    return cut_lineage(hits.groupBy("doc_id", "body_hash").agg(
        _covered(F.collect_set(F.struct("start", "length"))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    ))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document; repeated rows stay."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    hits = _small(contamination(docs, benchmark, **options).withColumnRenamed("doc_id", "hit_id").withColumnRenamed("body_hash", "hit_hash"))
    rows = _keyed(docs, key, text).select("doc_id", "body_hash", F.regexp_count("body", F.lit(WORD)).cast("long").alias("n_words"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("body_hash") == F.col("hit_hash")), "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns, whatever their names.

    A null or empty text holds no window, so it stays; repeated rows stay or go together; null keys are keys. An empty
    benchmark drops nothing, an empty table gives no rows.
    """
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    hits = contamination(docs, benchmark, **options).select(F.col("doc_id").alias("hit_id"), F.col("body_hash").alias("hit_hash"))
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no helper name can be among these
    own, body = (F.col(f"c{docs.columns.index(c)}") for c in (key, text))
    same = own.eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("hit_hash"))
    return numbered.join(_small(hits), same, "left_anti").toDF(*docs.columns)
