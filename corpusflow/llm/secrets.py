"""Secrets in texts; weak parts of a credential count only beside the parts that complete it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import text_of
from corpusflow.llm.spans import counted, joined, matches
from corpusflow.session import cut_lineage

BASE = ("assign", "access", "hex")
WEAK = ("identifier", "opaque", "endpoint")
KINDS = BASE + WEAK

# The base patterns and what their matches must hold.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
# Weak parts. A run is entered at its start only.
IDENTIFIER = r"""(?i:user(?:name)?|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
ENDPOINT = r"""(?i:https?|ftps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x00-\x20"'<>]+"""

#: What a weak kind needs within its scope: one part of each listed group.
ROLES = {"access": "name", "identifier": "name", "assign": "value", "hex": "value", "opaque": "value", "endpoint": "place"}
NEEDS = {"identifier": (("value",),), "opaque": (("name", "place"),), "endpoint": (("name",), ("value",))}

PART = "array<struct<kind:string,start:int,end:int>>"


def _spans(body: Column, kind: str, pattern: str, keep=None, hint: Column | None = None) -> Column:
    found = matches(body, pattern, hint)
    found = found if keep is None else F.filter(found, keep)
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(PART)


def parts(body: Column) -> Column:
    """Base spans and weak parts of a text; a weak part that touches a base span is none."""
    base = F.concat(
        _spans(body, "assign", ASSIGN, lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 8, body.rlike("[:=]")),
        _spans(body, "access", ACCESS, lambda s: F.char_length(s["match"]) >= 16, F.contains(body, F.lit("AKIA"))),
        _spans(body, "hex", HEX),
    )
    weak = F.concat(
        _spans(body, "identifier", IDENTIFIER, hint=body.rlike("[:=]")), _spans(body, "opaque", OPAQUE, hint=body.rlike("[0-9]")),
        _spans(body, "endpoint", ENDPOINT, hint=F.contains(body, F.lit("://"))),
    )
    return F.struct(base.alias("base"), weak.alias("weak"))


def _buckets(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width).cast("int"), F.floor(high / width).cast("int")))


def linked(rows: DataFrame, scope: int) -> DataFrame:
    """(row, kind, start, end): the weak parts of rows (row, base, weak) that have what completes them within `scope` code points.

    An interval join: scopes and parts are cut into buckets of `scope` code points and meet by (row, bucket). A bucket is
    so short that it holds few parts, whatever the length of the text. The join asks for existence and makes no pairs.
    """
    everything = rows.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    role = F.create_map(*[F.lit(v) for item in ROLES.items() for v in item])
    offered = everything.select(
        F.col("row").alias("part_row"), F.element_at(role, F.col("kind")).alias("role"), F.col("start").alias("part_start"), F.col("end").alias("part_end"),
        _buckets(F.col("start"), F.col("end"), scope).alias("part_bucket"),
    )
    weak = rows.select("row", F.explode("weak").alias("p"), "base").filter(
        ~F.exists("base", lambda b: (b["start"] < F.col("p")["end"]) & (F.col("p")["start"] < b["end"]))
    ).select("row", "p.*")
    result = None
    for kind, groups in NEEDS.items():
        left = weak.filter(F.col("kind") == kind)
        for group in groups:
            scoped = left.withColumn("bucket", _buckets(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope, scope))
            near = (
                (F.col("row") == F.col("part_row")) & (F.col("bucket") == F.col("part_bucket")) & F.col("role").isin(*group)
                & (F.col("part_start") < F.col("end") + scope) & (F.col("start") < F.col("part_end") + scope)
                & ~((F.col("part_start") < F.col("end")) & (F.col("start") < F.col("part_end")))
            )
            left = scoped.join(offered, near, "left_semi").drop("bucket").distinct()
        result = left if result is None else result.unionByName(left)
    return result


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = 256) -> DataFrame:
    """(doc_id, base, added): secrets in every whole text as spans (kind, start, end) in code points.

    `base` holds the matches that stand for themselves; `added` the weak parts (an account name, an opaque string, an
    endpoint) that `linked` completes. A null text counts as empty. Repeated rows each keep their row, as rows have numbers
    of their own. An empty table gives no rows.
    """
    found = docs.select(F.col(key).alias("doc_id"), parts(text_of(text)).alias("p")).select("doc_id", "p.base", "p.weak")
    rows = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    extra = linked(rows.filter(F.size("weak") > 0), scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return rows.join(extra, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(PART)).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and digest of the base spans, and all spans as text."""
    return found.select(
        "doc_id",
        *[counted(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS).alias("spans"),
    )
