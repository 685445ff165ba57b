"""Mixing sources to target weights: a low-discrepancy schedule of slots joined with blocks of shuffled documents.

A source's documents are shuffled and laid on a line of words, again and again, which is cut into blocks of equal numbers of
words. Slot t belongs to the source in whose share of the unit interval the point t * golden ratio (mod 1) falls; the slots
of a source, ranked, take its blocks in turn. Of N such points no gap is longer than 1.9 / N, so twice as many points as
slots are needed give every source all of its slots; a source's points after its last block stay empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import SPACE_WORDS, text_of
from corpusflow.operators.reports import numbered
from corpusflow.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0  # of all words, of a source's words
BLOCK = 4096  # words
CIRCLE = 1 << 62  # the unit interval in integers, exact for any number of slots
GOLDEN = 2850178704830799621  # the odd number next to CIRCLE / golden ratio
SALTS, ROWS_AT_ONCE, SLOTS_AT_ONCE = 64, 50_000, 1 << 16


@dataclass
class Mix:
    """`documents`: every row with its place on its source's line; `pieces`: what the slots take of them."""

    documents: DataFrame
    pieces: DataFrame


def before(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before, within the keys and in the order of (chunk, order).

    Chunks are summed, their sums run up within the keys, and each chunk adds its own running sums: the rows of one key
    are spread over its chunks.
    """
    valued = rows.withColumn(name, value)
    sums = valued.groupBy(*keys, chunk).agg(F.sum(name).alias("all"))
    left = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*keys, chunk, F.coalesce(F.sum("all").over(left), F.lit(0)).alias("shift"))
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return valued.join(shift, [*keys, chunk]).withColumn(name, F.col("shift") + F.coalesce(F.sum(name).over(within), F.lit(0))).drop("shift")


def _rows(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """(src, doc_id, size, digest, salt, place, copies): equal rows of a salt are one.

    `src` is the source with a sign in front, so that a null one can be joined and stands last.
    """
    body = text_of(text)
    known = F.col(source).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), known), F.lit("-")).alias("src"),
        F.col(key).alias("doc_id"), F.regexp_count(body, F.lit(SPACE_WORDS)).cast("long").alias("size"), F.md5(body).alias("digest"),
        (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt"),
    )
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.groupBy("src", "doc_id", "size", "digest", "salt").agg(F.count(F.lit(1)).alias("copies")).withColumn("place", place)


def targets(rows: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(src, rank, source_size, documents, target) of every source.

    Targets share `share` of all words by weight; those above `most` times their source's words stop there and the rest is
    shared again, until none is above. A round is one aggregate over the table of sources.
    """
    sources = rows.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("documents"))
    ranked = numbered(sources, "src", name="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", weight))
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    open_weight, spent, level, above = None, 0.0, 0.0, F.lit(False)
    while True:
        state = ranked.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, most * F.col("source_size")))).first()
        if state[0] == open_weight or not state[0]:  # as before, or all stop
            break
        open_weight, spent = state[0], state[1] or 0.0
        level = (share * words - spent) / open_weight
        above = F.col("weight") * F.lit(level) > most * F.col("source_size")
    return ranked.withColumn("target", F.when(above, most * F.col("source_size")).otherwise(F.col("weight") * F.lit(level))).drop("weight")


def slots(sources: DataFrame, block: int) -> DataFrame:
    """(slot, src, block): the schedule, from (src, rank, goal); slot numbers rise, those of sources at their end are missing."""
    spark = sources.sparkSession
    counted = sources.filter("goal > 0").select("src", "rank", F.ceil(F.col("goal") / block).cast("long").alias("n_slots"), F.floor(F.col("rank") / 4096).alias("chunk"))
    counted = cut_lineage(before(counted, (), "chunk", ("rank",), F.col("n_slots"), "low"))
    total, n_sources = counted.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(12, (4 * n_sources).bit_length())  # the interval's parts, so that a part meets few sources
    share = f"cast(cast(%s as decimal(19,0)) * cast({CIRCLE} as decimal(19,0)) div cast({max(total, 1)} as decimal(19,0)) as bigint)"
    arcs = counted.select("src", "n_slots", F.expr(share % "low").alias("low"), F.expr(share % "low + n_slots").alias("high"))
    arcs = arcs.withColumn("part", F.explode(F.sequence(F.shiftright("low", 62 - bits), F.shiftright(F.col("high") - 1, 62 - bits))))
    point = F.expr(f"cast(cast(id as decimal(19,0)) * cast({GOLDEN} as decimal(19,0)) % cast({CIRCLE} as decimal(19,0)) as bigint)")
    points = spark.range(2 * total).select(F.col("id").alias("slot"), point.alias("point")).withColumn("part", F.shiftright("point", 62 - bits))
    owned = points.join(arcs, "part").filter((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high")))
    owned = cut_lineage(owned.select("slot", "src", "n_slots", F.floor(F.col("slot") / SLOTS_AT_ONCE).alias("chunk")))
    return before(owned, ("src",), "chunk", ("slot",), F.lit(1), "block").filter(F.col("block") < F.col("n_slots")).select("slot", "src", "block")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> Mix:
    """The mix of the documents' sources: weights by the sources' order (code points, null last), repeating.

    `documents`: (doc_id, source, size, digest, source_size, target, start, salt, copy) of every row; `start` is its place
    on its source's line. `pieces`: (slot, block, doc_id, source, digest, start, salt, copy, first_word, n_words): slot after
    slot, and by `block` and place inside it, the words to take. A source gives exactly its rounded target; a document is
    taken at most ceil(most) times, each word of it as often as the line passes it.

    A null text has no words, a null source is a source of its own, null keys are keys; repeated rows each have their place.
    Equal input gives equal results in every run: rows that share key, size and text are the only ones that may change
    places. An empty table gives empty tables. No source, key or text is one task's work: rows are shuffled by pieces of
    the line. Only the named columns are read.
    """
    rows = cut_lineage(_rows(docs, key, source, text, seed))
    sources = targets(rows, weights, share, most).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    sources = cut_lineage(sources)
    largest = sources.agg(F.max("documents")).first()[0] or 0
    parts = 1 + largest // ROWS_AT_ONCE
    first = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    cut = rows.withColumn("chunk", F.floor(first * parts / (1 << 32)).cast("long"))
    # sources are named by (source, chunk), as a source alone may hold most rows
    lines = cut.select("src", "chunk").distinct().join(sources.select("src", "source_size", "target", "goal"), "src")
    placed = before(cut, ("src",), "chunk", ("place", "size", "digest", "salt"), F.col("size") * F.col("copies"), "start").join(lines, ["src", "chunk"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    name = F.when(F.col("src") != "-", F.substring("src", 2, 2**31 - 1)).alias("source")
    row = ["doc_id", "digest", "start", "salt", "copy"]
    placed = cut_lineage(placed.select("src", *row, "size", "source_size", "target", "goal"))

    passes = F.when((F.col("goal") > 0) & (F.col("size") > 0), F.sequence(F.lit(0), F.expr("cast((goal - 1) div source_size as int)"))).otherwise(F.array().cast("array<int>"))
    taken = placed.withColumn("pass", F.explode(passes)).withColumn("low", F.col("pass") * F.col("source_size") + F.col("start"))
    taken = taken.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("goal"))).filter("low < high")
    taken = taken.withColumn("block", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")))
    left, right = F.greatest("low", F.col("block") * block), F.least("high", (F.col("block") + 1) * block)
    taken = taken.select("src", "block", *row, (left - F.col("low")).alias("first_word"), (right - left).alias("n_words"), left.alias("at"))
    joined = taken.join(slots(sources.select("src", "rank", "goal"), block), ["src", "block"])
    return Mix(placed.select("doc_id", name, "size", "digest", "source_size", "target", "start", "salt", "copy"), joined.select("slot", "block", name, *row, "first_word", "n_words", "at"))


def taken_words(mixed: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row: the words that the slots take of it."""
    row = ["source", "doc_id", "digest", "start", "salt", "copy"]
    took = mixed.pieces.select(*row, F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "n_words")
    every = mixed.documents.select(*row, "size", "source_size", "target", F.lit(0).cast("long").alias("n_words"))
    summed = every.unionByName(took).groupBy(*row).agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target")], F.sum("n_words").alias("taken"))
    return summed.select("doc_id", "size", "source_size", "target", "taken", "source")


def texts(mixed: Mix, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(slot, at, source, doc_id, text): the mix itself, its words joined by spaces, in the order of slot and `at`."""
    body = docs.select(F.col(key).alias("doc_id"), F.md5(text_of(text)).alias("digest"), text_of(text).alias("text")).dropDuplicates(["doc_id", "digest"])
    found = mixed.pieces.withColumnRenamed("doc_id", "of").withColumnRenamed("digest", "with_digest")
    joined = found.join(body, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("with_digest") == F.col("digest")))
    words = F.slice(F.regexp_extract_all("text", F.lit(SPACE_WORDS), F.lit(0)), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    return joined.select("slot", "at", "source", "doc_id", F.array_join(words, " ").alias("text"))
