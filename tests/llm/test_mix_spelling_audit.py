"""Mixing, spelling variants and the filter audit against plain versions, and on tables with every kind of bad row."""

import pathlib
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))
import plain  # noqa: E402

from corpusflow.llm import filter_audit, mixing, spelling  # noqa: E402

# names that the operators use inside themselves
CLASHES = "src string, size bigint, digest string, salt int, place string, chunk bigint, block bigint, part string, body string, words array<string>, mask int, good int, run string, hash bigint, word string, n bigint"
CLASH = ("s", 1, "d", 2, "p", 3, 4, "q", "b", ["w"], 5, 6, "r", 7, "o", 8)
SYLLABLES = "ta re mi no la si du ke éa öb".split()


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 6))).capitalize() if rng.random() < 0.2 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5))) for _ in range(n))


LONG = words(30_000, 1)
ROWS = [
    (1, "a", None), (2, "a", ""), (3, "a", " \t\n "), (4, "b", "One"), (5, "b", "One"), (5, "b", "One"), (6, None, words(60, 2)), (7, None, words(60, 2)),
    (8, "", words(70, 3)), (9, "b", LONG), (10, "a", LONG), (None, "a", words(60, 2)), (None, "a", words(60, 2)), (None, None, None), (11, "é", "x" * 5000),
    (12, "Z", "AB CD # " * 40), (13, "b", words(200, 4)), (13, "a", words(200, 4)), (13, "a", words(100, 5)), (-1, "a", "One"),
]
LABELS = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (9, 1, None), (12, None, 1), (12, None, 1), (None, 1, 1), (13, 1, 0), (99, 1, 1)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], f"doc_id bigint, source string, text string, {CLASHES}")


# --- 11 mixing


def targets(sizes):
    """Targets by plain rounds of sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        more = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def checked(mixed, rows, block):
    sizes, of = Counter(), Counter()
    for key, source, text in rows:
        n = len((text or "").split()) if text != " \t\n " else 0
        sizes[source] += n
        of[key, source, n] += 1
    want = targets(sizes)
    got = mixing.taken_words(mixed).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == of
    took = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - want[s]) <= 0.5 for s in want)
    pieces = sorted((r.asDict() for r in mixed.pieces.collect()), key=lambda r: (r["slot"], r["at"]))
    filled = defaultdict(int)
    for p in pieces:  # the pieces of a slot fill it without gaps
        assert p["at"] == p["block"] * block + filled[p["slot"]]
        filled[p["slot"]] += p["n_words"]
    ends = {s: max((p["block"] for p in pieces if p["source"] == s), default=0) for s in sizes}
    assert all(filled[p["slot"]] == block for p in pieces if p["block"] < ends[p["source"]])
    return pieces


@pytest.mark.parametrize("block", [7, 4096])
def test_mix_of_bad_rows(messy, block):
    pieces = checked(mixing.mix(messy, block=block), ROWS, block)
    assert pieces
    assert mixing.mix(messy.limit(0)).documents.count() == mixing.taken_words(mixing.mix(messy.limit(0))).count() == 0


def test_schedule_is_even_and_reruns_agree(spark):
    rows = [(i, f"s{i % 4}" if i % 2 else "s1", words(3 + i % 40, i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    mixed = mixing.mix(docs, block=20)
    pieces = checked(mixed, rows, 20)
    again = mixing.mix(docs.repartition(7), block=20)
    assert Counter(map(tuple, mixing.taken_words(mixed).collect())) == Counter(map(tuple, mixing.taken_words(again).collect()))
    order = [p["source"] for i, p in enumerate(pieces) if not i or pieces[i - 1]["slot"] != p["slot"]]
    share = Counter(order)
    for s, n in share.items():  # up to a source's last slot, every prefix holds nearly its share
        last = len(order) - order[::-1].index(s)
        held = np.cumsum([o == s for o in order[: min(last, len(order) // 2)]])
        assert np.abs(held - n / len(order) * np.arange(1, len(held) + 1)).max() <= 6
    texts = {(r["slot"], r["at"]): r["text"] for r in mixing.texts(mixed, docs).collect()}
    body = {k: t.split() for k, _, t in rows}
    assert all(texts[p["slot"], p["at"]] == " ".join(body[p["doc_id"]][p["first_word"] : p["first_word"] + p["n_words"]]) for p in pieces) and len(texts) == len(pieces)


def test_mix_with_one_source_of_most_rows_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(mixing, "SLOTS_AT_ONCE", 64)
    rows = [(i % 500, "hot" if i % 3 else None, "word " * (i % 9)) for i in range(1500)] + [(None, "hot", "w")] * 100
    checked(mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), block=50), rows, 50)


# --- 12 spelling


def spelling_rows(n=400):
    rng = random.Random(5)
    base = sorted(set(words(n, 9).split() + ["ABÇDÉFGHI", "abçdéfghi"]))
    out = [(i, " ".join([w] * rng.choice([1, 2, 3, 30, 400]))) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        at, letter = rng.randrange(len(w)), rng.choice("abzéß×Þ")
        out.append((None if i % 5 == 0 else 1000 + i, "\n".join(3 * [w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :], w[:at] + w[at + 1 :]])))
    chain = [(5000 + i, " ".join(["a" * n] * count)) for n, count in ((9, 3), (8, 50), (7, 900)) for i in range(2 * n, 2 * n + 2)]
    return out + chain + [(k, t) for k, _, t in ROWS]


@pytest.mark.parametrize("block", [spelling.BLOCK, 12])
def test_variants(spark, block):
    rows = spelling_rows()
    docs = spark.createDataFrame([(k, t, *CLASH) for k, t in rows], f"doc_id bigint, text string, {CLASHES}")
    got = spelling.variants(docs, block=block).select("word", "n", "n_near", "form", "form_n", "root")
    want = Counter(plain.spelled(rows))
    assert any(w[3] and w[5] != w[3] for w in want)  # chains of forms
    assert Counter(tuple(r) for r in got.collect()) == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_one_edit_of_every_kind():
    import pyarrow as pa

    pairs = {"abcdefg": 1, "abcdefgh": 1, "xabcdefg": 1, "abcdefx": 1, "abcxdefg": 1, "abdcefg": 0, "gfedcba": 0, "bcdefga": 0, "abcdefghi": 0}
    every = sorted(pairs)
    found = spelling._near(pa.array(every), np.arange(1, len(every) + 1), np.zeros(len(every), int), False, [], np.minimum(np.arange(256), spelling.COLUMNS - 1))
    near = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    assert near["abcdefg"] == 4 and near["abcdefgh"] == 2 and near["abcdefghi"] == 1 and "gfedcba" not in near


# --- 13 filters


def test_audit(spark, messy):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(messy, labels)
    assert Counter(map(tuple, got.collect())) == Counter(plain.filtered(ROWS, LABELS))
    assert filter_audit.audit(messy.limit(0), labels).count() == 0
    assert filter_audit.audit(messy, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_walk_over_subsets():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 9, (5, 32, 3))
    states = filter_audit.survivors(cells)
    for subset in range(32):
        assert (states[subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()
