"""Files as rows: listing, admission, decoding.  A bad file is a row with an error, never a failed job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import fixed_values as V

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
DECODED = "path string, file_name string, extension string, original_size bigint, modified timestamp, text string, encoding string, error string"
# fixed values: decoding order per kind of file
ENCODINGS = {"md": ("utf-8", "utf-8-sig", "cp949", "euc-kr"), "txt": ("utf-8", "cp949", "euc-kr", "utf-8-sig")}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, path: str, types: Iterable[str] = ("txt", "md")) -> DataFrame:
    """Every file of the wanted types under a folder.  Contents are read only by plans that use them."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(types) + "}")
        .load(path)
    )


def file_info(files: DataFrame) -> DataFrame:
    """Name, extension, size, size in MB and modification time; the content column is pruned from the scan."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("file_name"), extension(name).alias("extension"), F.col("length").alias("size"),
        F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.col("modificationTime").alias("modified"),
    )


def select_files(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Visible files in path order, or those whose names are in `wanted(file_name)`."""
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    visible = named.filter(~F.col("file_name").startswith("."))
    return visible if wanted is None else visible.join(wanted, "file_name", "left_semi")


def admission(name: Column, size: Column) -> Column:
    """Null for an admissible file, else why it is refused."""
    kind = extension(name)
    return (
        F.when(
            size > V.MAX_FILE_BYTES,
            F.format_string("파일 크기가 너무 큽니다. (최대 100MB, 현재: %.1fMB)", size / 1048576),
        )
        .when(F.coalesce(name, F.lit("")) == "", "유효하지 않은 파일명입니다.")
        .when(~kind.isin(*V.FILE_TYPES), F.concat(F.lit("지원하지 않는 파일 형식입니다. (."), kind, F.lit(")")))
    )


def decode(files: DataFrame) -> DataFrame:
    """Text of every file by the first encoding that fits its kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, modified, size, content in zip(batch["path"], batch["modificationTime"], batch["length"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower()
                text = encoding = error = None
                for candidate in ENCODINGS.get(kind, ENCODINGS["txt"]):
                    try:
                        text, encoding = bytes(content).decode(candidate), candidate
                        break
                    except UnicodeDecodeError:
                        continue
                if text is None:
                    error = "no encoding fits"
                rows.append((path, name, kind, size, modified, text, encoding, error))
            yield pd.DataFrame(rows, columns=["path", "file_name", "extension", "original_size", "modified", "text", "encoding", "error"])

    return files.select("path", "modificationTime", "length", "content").mapInPandas(run, DECODED)


def load_folder(spark: SparkSession, path: str, types: Iterable[str] = ("txt", "md")) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a folder."""
    files = read_files(spark, path, types)
    checked = files.withColumn("refused", admission(F.element_at(F.split("path", "/"), -1), F.col("length")))
    decoded = decode(checked.filter(F.col("refused").isNull()))
    rejects = checked.filter(F.col("refused").isNotNull()).select("path", F.col("refused").alias("error")).unionByName(
        decoded.filter(F.col("error").isNotNull()).select("path", "error")
    )
    return decoded.filter(F.col("error").isNull()), rejects


def sanitized_name(name: Column) -> Column:
    """File name in composed Unicode form, without control characters or path separators."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def composed(names: pd.Series) -> pd.Series:
        return names.str.normalize("NFC")

    from corpusflow.functions import text as T

    out = T.sub(composed(name), r"[\x00-\x1F\x7F]")
    return T.strip(T.sub(T.sub(out, r'[\\/:*?"<>|]', "_"), r"\s+", " "))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, expected) from a JSON file of cases with a question and its expected sources."""
    raw = spark.read.schema(
        "description string, cases array<struct<question string, expected_sources array<string>>>"
    ).option("multiLine", True).json(path)
    return raw.select(F.posexplode("cases")).select(
        F.col("pos").cast("bigint").alias("query_id"), F.col("col.question").alias("text"), F.col("col.expected_sources").alias("expected")
    )
