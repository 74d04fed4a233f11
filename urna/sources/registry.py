"""College registries and scanned word tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REGISTRY = (
    "map_version string, geography string, college int, municipality string, entry_type string, "
    "entry_text string, source_page int, ocr_text string, match_score double"
)
_WORDS = (
    "level int, page_num int, block_num int, par_num int, line_num int, word_num int, `left` int, "
    "top int, width int, height int, conf double, text string"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows; a quote inside a field is doubled, as CSV writers do."""
    return spark.read.csv(path, header=True, schema=_REGISTRY, escape='"')


def read_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Words of scanned pages (tab-separated recogniser output), page from the file name.

    Also (path, line) of the lines that are no words.
    """
    schema = f"{_WORDS}, malformed string"
    # Every column is parsed whatever is asked for, or a bad line might pass for a good one.
    table = spark.read.option("columnPruning", False).csv(
        path, sep="\t", header=True, schema=schema, quote="", mode="PERMISSIVE", columnNameOfCorruptRecord="malformed"
    ).withColumn("path", F.input_file_name())
    page = F.regexp_extract("path", r"(\d+)\.tsv$", 1).cast("int")
    read = table.where(F.col("malformed").isNull()).withColumn("page", page).drop("malformed", "path")
    return words(read), table.where(F.col("malformed").isNotNull()).select("path", F.coalesce("malformed", "text").alias("line"))


def words(table: DataFrame) -> DataFrame:
    """Keep recognised words: level 5 with text."""
    return table.where((F.col("level") == 5) & (F.trim(F.col("text")) != ""))
