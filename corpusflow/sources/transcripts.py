"""Conversation transcripts and per-document Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import reports


def transcript_entries(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, entry_no, entry): numbered Markdown entries; a conversation of any length is numbered in ranges."""
    placed = reports.numbered(messages, order, (key,), name="_p")
    role = F.when(F.col("role") == "user", "사용자").otherwise("어시스턴트")
    number = (F.col("_p") + 1).cast("int")
    entry = F.concat(F.lit("## "), number.cast("string"), F.lit(". "), role, F.lit("\n"), "text", F.lit("\n\n---\n"))
    return placed.select(key, number.alias("entry_no"), entry.alias("entry"))


def write_transcripts(messages: DataFrame, path: str, key: str = "conv_id", order: str = "turn") -> None:
    """Entries as text, in order: sorted ranges instead of one task per conversation."""
    entries = transcript_entries(messages, key, order)
    entries.repartitionByRange(key, "entry_no").sortWithinPartitions(key, "entry_no").select("entry").write.mode("overwrite").text(path)


def markdown_file(name: Column, source: Column, converted_at: Column, method: Column, images: Column, body: Column) -> Column:
    """A document under its header block; the time is a parameter, so the output is reproducible."""
    return F.concat(
        F.lit("# "), name, F.lit("\n\n**원본 파일**: "), source, F.lit("\n**변환 시간**: "), converted_at, F.lit("\n**처리 방법**: "), method,
        F.lit("\n**추출된 이미지**: "), images.cast("string"), F.lit("개\n\n---\n\n"), body,
    )


def write_markdown(docs: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """One folder per document name, its text inside."""
    docs.select(F.col(name).alias("name"), F.col(content).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
