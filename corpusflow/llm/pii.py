"""Personal data by weak supervision: labelers vote on candidate spans, expectation maximisation weighs them, a classifier decides."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import text_of
from corpusflow.llm.spans import counted, digits_of, joined, let, luhn, matches
from corpusflow.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# The base patterns. A run is entered at its start only (or right after a match), which finds the same
# matches as the plain form in linear time.
RUN = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
EMAIL = RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Looser forms that only the vote can turn into spans.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]?(?:dot|DOT|\.)[\])]?\x20?[A-Za-z]{2,12})+"
LOOSE_PHONE = r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9.-])"
# Gazetteers and cue words of the labelers.
DOMAINS = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu|us"
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|36|38|6)"
CALLING_CODES = r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_NETS = r"^(0|127|169\.254|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {
    "email": "mail|contact|write to|e-mail|correo|kontakt|courriel",
    "ip": r"\bip\b|address|host|server|client|login from",
    "card": "card|visa|credit|debit|mastercard|karte|carte|tarjeta",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|fax|cell|telefon",
}
COUNTER_CUES = r"version|release|order|invoice|isbn|serial|section|figure|page|item"

CANDIDATE = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,features:array<string>>>"


def _vote(positive: Column, negative: Column) -> Column:
    return F.when(positive, 1).when(negative, -1).otherwise(0)


def _candidate(kind: str, span: Column, base: Column, loose: bool) -> Column:
    """Candidate of a match: the votes of the regex, gazetteer and context labelers, and the features of the classifier."""
    match, digits, before = span["match"], digits_of(span["match"]), F.lower(span["before"])
    regex = F.lit(0) if loose else F.when(base, 1).otherwise(-1)
    gazetteer = {
        "email": _vote(match.rlike(f"(?i)({DOMAINS})$"), F.lit(False)),
        "ip": _vote(~match.rlike(RESERVED_NETS), match.rlike(RESERVED_NETS)),
        "card": _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": _vote(match.rlike(CALLING_CODES), match.startswith("+") & ~match.rlike(CALLING_CODES)),
    }[kind]
    context = _vote(before.rlike(CUES[kind]), before.rlike(COUNTER_CUES))
    separators = F.char_length(match) - F.char_length(digits)
    features = F.array(
        F.lit(kind),
        F.lit("loose" if loose else "strict"),
        F.concat(F.lit(f"{kind} digits "), F.least(F.char_length(digits), F.lit(20)).cast("string")),
        F.concat(F.lit(f"{kind} others "), F.least(separators, F.lit(6)).cast("string")),
        F.concat(F.lit("checked "), base.cast("string")),
        F.concat(F.lit("gazetteer "), gazetteer.cast("string")),
        F.concat(F.lit("context "), context.cast("string")),
    )
    return F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), (base & F.lit(not loose)).alias("base"),
        F.array(regex, gazetteer, context).alias("votes"), features.alias("features"),
    )


def _checked(kind: str, match: Column) -> Column:
    """The base rule of a kind on one match."""
    digits = digits_of(match)
    if kind == "ip":
        return match.rlike(f"^{OCTET}([.]{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def candidates(body: Column) -> Column:
    """All candidate spans of a text with their votes and features."""
    digit = body.rlike("[0-9]")
    sources = [
        ("email", EMAIL, F.contains(body, F.lit("@")), False), ("ip", IP, digit, False), ("card", CARD, digit, False),
        ("phone", PHONE, F.contains(body, F.lit("+")), False), ("email", LOOSE_EMAIL, F.contains(body, F.lit("[")) | F.contains(body, F.lit("(")), True),
        ("phone", LOOSE_PHONE, digit, True),
    ]

    def of(kind: str, pattern: str, hint: Column, loose: bool) -> Column:
        return F.transform(matches(body, pattern, hint), lambda s: _candidate(kind, s, _checked(kind, s["match"]), loose)).cast(CANDIDATE)

    return F.concat(*[of(*source) for source in sources])


# --- reliabilities and the classifier -----------------------------------------------------------------------------------------


def vote_counts(found: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[str, ...], int]]:
    """How often each (kind, votes, features) occurs among all candidates; the combinations are bounded by the categories."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    return [(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in rows.collect()]


def reliabilities(counts: list, rounds: int = 30) -> dict:
    """Expectation maximisation over votes: for each kind the prior of true spans and, for each labeler, P(vote | true or false).

    Starts from labelers that are right in four of five votes. Returns the posterior of every (kind, votes).
    """
    posterior = {}
    for kind in {c[0] for c in counts}:
        votes: dict[tuple[int, ...], float] = {}
        for k, v, _, n in counts:
            if k == kind:
                votes[v] = votes.get(v, 0) + n
        labelers = len(next(iter(votes)))
        prior = 0.5
        p = [{(v, t): 0.4 if v == 0 else 0.48 if (v > 0) == t else 0.12 for v in (-1, 0, 1) for t in (True, False)} for _ in range(labelers)]
        for _ in range(rounds):
            post = {}
            for v in votes:
                yes = math.log(prior) + sum(math.log(p[i][x, True]) for i, x in enumerate(v))
                no = math.log(1 - prior) + sum(math.log(p[i][x, False]) for i, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(min(700.0, no - yes)))
            total = sum(votes.values())
            true = sum(n * post[v] for v, n in votes.items())
            prior = (true + 1) / (total + 2)
            for i in range(labelers):
                for x in (-1, 0, 1):
                    have = [(n, post[v]) for v, n in votes.items() if v[i] == x]
                    p[i][x, True] = (sum(n * q for n, q in have) + 1) / (true + 3)
                    p[i][x, False] = (sum(n * (1 - q) for n, q in have) + 1) / (total - true + 3)
        posterior |= {(kind, v): q for v, q in post.items()}
    return posterior


def span_classifier(counts: list, posterior: dict, rounds: int = 300, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic regression on the features, trained on the posteriors; "" is the intercept."""
    names = sorted({f for c in counts for f in c[2]})
    if not names:
        return {"": -20.0}
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(counts), len(names) + 1))
    x[:, -1] = 1
    for i, c in enumerate(counts):
        x[i, [place[f] for f in c[2]]] = 1
    n = np.array([c[3] for c in counts], float)
    y, n = np.array([posterior[c[0], c[1]] for c in counts]), n / n.sum()
    w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        g = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return dict(zip(names, map(float, w[:-1]))) | {"": float(w[-1])}


def _accepted(all_spans: Column, weights: dict[str, float], threshold: float) -> Column:
    """Base spans, and other candidates that the classifier accepts and that touch no base span."""
    table = F.create_map(*[F.lit(v) for item in weights.items() for v in item])
    base = F.filter(all_spans, lambda c: c["base"])
    logit = math.log(threshold / (1 - threshold))

    def added(others: Column, bases: Column) -> Column:
        return F.filter(
            others,
            lambda c: (F.aggregate(c["features"], F.lit(weights[""]), lambda s, f: s + F.coalesce(F.element_at(table, f), F.lit(0.0))) >= logit)
            & ~F.exists(bases, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
        )

    return let(base, lambda b: F.concat(b, added(F.filter(all_spans, lambda c: ~c["base"]), b)))


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))


def fit(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from a table with a column of candidates.

    What leaves the executors is a table of counts by votes and features, bounded by their categories.
    """
    counts = vote_counts(found)
    return span_classifier(counts, reliabilities(counts))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """(doc_id, spans): personal data in every whole text, spans (kind, start, end, base) in code points.

    Candidates of all texts are found once and kept; labelers (regex with its check, gazetteer, context) have voted on
    each. From the counts of votes the labelers' reliabilities and the classifier are fitted. Base spans (those whose check
    holds) always stay.

    A null text counts as empty and has no spans. Repeated rows each keep their row. An empty table gives no rows.
    """
    found = cut_lineage(docs.select(F.col(key).alias("doc_id"), candidates(text_of(text)).alias("candidates")))
    return found.select("doc_id", _slim(_accepted(F.col("candidates"), fit(found), threshold)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap, one mark stays for all."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] < state["at"], state["parts"]).otherwise(F.concat(state["parts"], F.array(gap, mark))).alias("parts"),
        )

    rest = F.char_length(text)
    whole = F.aggregate(ordered, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, rest)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """The rows with the personal data in their texts replaced; columns stay, a null text stays null.

    The texts are read twice, once to fit the classifier and once to replace, so that no text is stored in between.
    """
    weights = fit(docs.select(candidates(text_of(text)).alias("candidates")))
    body = F.col(text)
    replaced = let(candidates(text_of(text)), lambda found: let(_accepted(found, weights, threshold), lambda spans: redacted(body, spans)))
    return docs.withColumn(text, F.when(body.isNotNull(), replaced))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[counted(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
    )
