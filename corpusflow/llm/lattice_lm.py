"""Marginal likelihood of texts under a subword lattice: all segmentations into pieces of an existing vocabulary count.

A token (a word, or the end of a text) is a space and its bytes; its probability is the sum over all ways to cut that into
pieces, by a forward recursion in log space. The vocabulary and its first scores are given, never trained; the scores are
then re-estimated from all training documents by expectation maximisation over the same lattice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import remainder, scratch, text_of
from corpusflow.llm.shingles import BYTE_CODES, STEP, mixed
from corpusflow.session import cut_lineage

ROUNDS = 2  # further ones change the held-out likelihood by less than a hundredth
HOT = 250_000  # most frequent words, which every task knows; the others are joined
FLUSH = 1_000_000  # distinct words that a task holds
END = b""  # the token that ends a text
WORDS_AT_ONCE = 50_000
SMOOTHING = 0.01


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, lower case, a space for the word mark, and their first log weights from the vocabulary's own order.

    Every byte is a piece of its own, so any text has a segmentation. Control pieces and those that no lower-case word can
    hold are left out.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece == piece.lower() and b" " not in piece[1:]:
            pieces[piece] = 1 / (50 + max(0.0, -model.get_score(i)))  # the scores are ranks: a weight by rank
    weights = np.array(list(pieces.values()))
    return list(pieces), np.log(weights / weights.sum())


class Lattice:
    """Pieces found by 64-bit hashes of byte runs, and the recursions over words of equal length."""

    def __init__(self, pieces: list[bytes]):
        with np.errstate(over="ignore"):
            codes = BYTE_CODES.copy()
            codes[65:91] = mixed(np.arange(65, 91, dtype=np.uint64))  # words come in lower case; keep A-Z apart all the same
            self.codes, self.inverse = codes, np.uint64(pow(int(STEP), -1, 1 << 64))
            keys = np.array([self._key(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(mixed(keys) >> np.uint64(42)).astype(np.int64)] = True
        self.lengths = sorted({len(p) for p in pieces})

    def _key(self, piece: bytes) -> np.uint64:
        data = np.frombuffer(piece, np.uint8)
        return (self.codes[data] * self._powers(STEP, len(data))).sum(dtype=np.uint64)

    @staticmethod
    def _powers(base: np.uint64, n: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        return np.multiply.accumulate(p)

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces) of words given as rows of bytes; ordered by `from`."""
        n, length = words.shape
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(self.codes[words] * self._powers(STEP, length), axis=1, out=sums[:, 1:])
        back = self._powers(self.inverse, length)
        for low in range(length):
            for size in self.lengths:
                if low + size > length:
                    break
                keys = (sums[:, low + size] - sums[:, low]) * back[low]
                rows = np.flatnonzero(self.bits[(mixed(keys) >> np.uint64(42)).astype(np.int64)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
                    good = self.keys[at] == keys[rows]
                    if good.any():
                        yield low, low + size, rows[good], self.ids[at[good]]

    def forward(self, words: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Log probability of every word."""
        alpha = np.full((words.shape[0], words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        with np.errstate(over="ignore"):
            for low, high, rows, ids in self.edges(words):
                alpha[rows, high] = np.logaddexp(alpha[rows, high], alpha[rows, low] + scores[ids])
        return alpha[:, -1]

    def expected(self, words: np.ndarray, counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over all segmentations of the words, each counted so often."""
        with np.errstate(over="ignore"):
            edges = list(self.edges(words))
        alpha = np.full((words.shape[0], words.shape[1] + 1), -np.inf)
        beta = alpha.copy()
        alpha[:, 0] = beta[:, -1] = 0
        for low, high, rows, ids in edges:
            alpha[rows, high] = np.logaddexp(alpha[rows, high], alpha[rows, low] + scores[ids])
        for low, high, rows, ids in reversed(edges):
            beta[rows, low] = np.logaddexp(beta[rows, low], beta[rows, high] + scores[ids])
        uses = np.zeros(len(scores))
        for low, high, rows, ids in edges:
            uses += np.bincount(ids, counts[rows] * np.exp(alpha[rows, low] + scores[ids] + beta[rows, high] - alpha[rows, -1]), minlength=len(scores))
        return uses


LATTICE: dict[tuple, Lattice] = {}  # one per Python worker


def _lattice(pieces: list[bytes]) -> Lattice:
    key = (len(pieces), pieces[-1])
    if key not in LATTICE:
        with np.errstate(over="ignore"):
            LATTICE[key] = Lattice(pieces)
    return LATTICE[key]


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows of bytes) of words of equal length, each with the space before it."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join(b" " + words[i] for i in at), np.uint8).reshape(len(at), n + 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to WORDS_AT_ONCE rows: the recursions take many words at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


# --- counts ------------------------------------------------------------------------------------------------------------------


def _tokens(body: pa.Scalar) -> list[bytes]:
    return body.as_py().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, trained): how often each token occurs in all documents and in those for training; docs(body, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            kept, held = ([part.get(w, 0) for w in words] for part in seen)
            out = [pa.array(words, pa.binary()), pa.array([a + b for a, b in zip(kept, held)], pa.int64()), pa.array(kept, pa.int64())]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n", "trained"])

        for batch in batches:
            for body, held in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                part = seen[1 if held else 0]
                part.update(_tokens(body))
                part[END] += 1
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        yield flush()

    counted = docs.mapInArrow(run, "word binary, n bigint, trained bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def estimate(words: DataFrame, pieces: list[bytes], scores: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end token, by expectation maximisation over all training tokens.

    A round is one pass over the distinct words; one row per piece and task is summed, and one row per piece comes back.
    """
    trained = words.filter(F.col("trained") > 0)
    ends = trained.filter(F.col("word") == F.lit(END)).agg(F.sum("trained")).first()[0] or 0
    scores = np.append(scores, np.log(1e-3))
    for _ in range(rounds):
        now = scores

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(len(now))
            for block in _blocks(batches):
                body, counts = block.column("word").to_pylist(), block.column("trained").to_numpy()
                for at, rows in _by_length(body):
                    if rows.shape[1] > 1:
                        uses += _lattice(pieces).expected(rows, counts[at], now)
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(uses[used])], ["piece", "uses"])

        sums = trained.select("word", "trained").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(len(scores), SMOOTHING)
        uses[sums["piece"].to_numpy(np.int64)] += sums["uses"].to_numpy(np.float64)
        uses[-1] += ends
        scores = np.log(uses / uses.sum())
    return scores


def word_scores(words: DataFrame, pieces: list[bytes], scores: np.ndarray) -> DataFrame:
    """(word, n, trained, log10p): the words with their marginal log10 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            body = block.column("word").to_pylist()
            out = np.empty(len(body))
            for at, rows in _by_length(body):
                out[at] = scores[-1] if rows.shape[1] == 1 else _lattice(pieces).forward(rows, scores)
            columns = [pa.array(body, pa.binary()), block.column("n").combine_chunks(), block.column("trained").combine_chunks(), pa.array(out / np.log(10))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "trained", "log10p"])

    return words.select("word", "n", "trained").mapInArrow(run, "word binary, n bigint, trained bigint, log10p double")


def _document_sums(hot: tuple[dict[bytes, int], np.ndarray]) -> Callable:
    """Rows of documents, with sums over their hot tokens (word null), and of the other tokens (word, times)."""
    index, values = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]
        for batch in batches:
            sums, rows, words, often = [], [], [], []
            for row, body in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary())):
                counts = Counter(_tokens(body))
                counts[END] += 1
                at, times = [], []
                for word, n in counts.items():
                    place = index.get(word)
                    if place is None:
                        words.append(word), often.append(n)
                    else:
                        at.append(place), times.append(n)
                rows.extend([row] * (len(counts) - len(at)))
                sums.append((sum(counts.values()), *(values[at].T @ np.array(times, float) if at else (0.0, 0.0, 0.0))))
            kinds = [pa.int64(), batch.schema.field(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
            totals = np.array(sums).T
            have = [batch.column(0), batch.column(1), batch.column(3), pa.array(totals[0].astype(np.int64)), pa.array(totals[1].astype(np.int64)), pa.array(totals[2]), pa.array(totals[3])]
            yield pa.RecordBatch.from_arrays(have + [pa.nulls(len(batch), k) for k in kinds[7:]], names)
            rest = [pa.array(rows, kinds[0])] + [pa.nulls(len(rows), k) for k in kinds[1:7]] + [pa.array(words, kinds[7]), pa.array(often, kinds[8])]
            yield pa.RecordBatch.from_arrays(rest, names)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10.

    Counts cover all documents: held-out ones (the key's remainder is `held`) only say which words need a score. The most
    frequent HOT words go to every task; the other words of a document are joined with the table of words, and their sums
    are added. Any word is scored the same way on both paths.

    A null text counts as empty: one end token. Repeated rows keep their rows. An empty table gives no rows; without
    training documents the base is that of no counts and the pieces keep smoothed weights.
    """
    spark = docs.sparkSession
    pieces, first = vocabulary(path)
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("body"), (remainder(key, modulus) == held).alias("held_out"))
    with scratch(spark) as keep:
        counted = keep(word_counts(rows.select("body", "held_out")))
        total, distinct = counted.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count_if(F.col("trained") > 0)).first()
        scored = word_scores(counted, pieces, estimate(counted, pieces, first, rounds))
        base = F.log10((F.col("trained") + 1) / F.lit(float(total + distinct + 1)))
        scored = keep(scored.select("word", "n", (F.col("trained") > 0).cast("double").alias("known"), base.alias("base"), "log10p"))
        top = scored.orderBy(F.desc("n"), "word").limit(HOT).toArrow()
        hot = ({w.as_py(): i for i, w in enumerate(top["word"])}, np.stack([top[c].to_numpy() for c in ("known", "base", "log10p")], axis=1))
        del top
        fields = f"row bigint, doc_id {dict(docs.dtypes)[key]}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word binary, times bigint"
        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body", "held_out")
        made = keep(numbered.mapInArrow(_document_sums(hot), fields))
        rare = made.filter(F.col("word").isNotNull()).select("row", "word", "times").join(scored, "word")
        sums = rare.groupBy("row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"more_{c}") for c in ("known", "base", "log10p")])
        result = made.filter(F.col("word").isNull()).drop("word", "times").join(sums, "row", "left")
        zero = F.lit(0.0)
        return cut_lineage(result.select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more_log10p", zero)).alias("score"),
        ))
