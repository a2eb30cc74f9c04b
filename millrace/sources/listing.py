"""Directory listings: what the files are and whether a folder can be run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a suffix is treated.
TABLE_SUFFIXES = ["", "csv", "tsv", "txt"]
UNSUPPORTED_SUFFIXES = [
    "png",
    "jpg",
    "jpeg",
    "gif",
    "webp",
    "mp3",
    "wav",
    "mp4",
    "parquet",
    "pkl",
    "pickle",
    "h5",
    "hdf5",
]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, size_bytes, modified_at)`` of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def file_kind(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))
    return (
        F.when(suffix.isin(UNSUPPORTED_SUFFIXES), "unsupported")
        .when(suffix.isin(TABLE_SUFFIXES), "csv")
        .otherwise("document")
    )


def inspect_folder(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """Whether each group of files can be run, and why not. Hidden files do not count."""
    visible = files.where(~F.regexp_extract("name", r"([^/]+)$", 1).startswith("."))
    kind = file_kind(F.col("name"))
    facts = visible.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(kind == "csv").alias("n_tables"),
        F.count_if(kind == "unsupported").alias("n_unsupported"),
    )
    reason = (
        F.when((F.col("n_unsupported") > 0) & (F.col("n_tables") == 0), "not_tabular")
        .when(F.col("n_unsupported") > 0, "some_not_tabular")
        .when(F.col("n_files") == 0, "no_files")
        .when(F.col("n_tables") == 0, "documents_only")
    )
    return facts.select(*by, "n_files", "n_tables", reason.isNull().alias("runnable"), reason.alias("reason"))


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.md", deep: bool = False) -> DataFrame:
    """``(name, text, path)`` of whole text files, one row per file; ``deep`` looks into folders, too."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).text(path)
    place = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(place, r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"), place.alias("path"))
