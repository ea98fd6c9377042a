"""Sources: dictionaries from delimited and JSON files, documents from binary files, with their kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNRANKED = 999999


def ranked_terms(spark: SparkSession, path: str, keep: str = "ACTIVE", search: tuple[str, ...] = ("component", "shortname")) -> DataFrame:
    """A CSV of terms with a header: active rows, rank with a default for blank or bad ones, lower-cased search columns."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.lower() for c in rows.columns]).where(F.col("status") == keep)
    rows = rows.withColumn("rank", F.coalesce(F.col("rank").try_cast("int"), F.lit(UNRANKED)))
    return rows.withColumns({f"{c}_lower": F.lower(c) for c in search if c in rows.columns})


def piped_names(spark: SparkSession, path: str, names: list[str], language: str = "ENG", kinds: tuple[str, ...] = ("IN", "BN", "SCD", "SBD", "GPCK", "BPCK", "PIN", "MIN")) -> DataFrame:
    """A pipe-delimited file without a header: rows of a language and of certain term kinds that are not suppressed."""
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.option("sep", "|").schema(schema).csv(path)
    return rows.where((F.col("lat") == language) & (F.coalesce("suppress", F.lit("")) != "Y") & F.col("tty").isin(*kinds)).withColumn("name_lower", F.lower("name"))


def json_dictionary(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file; files that do not parse are left out."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def binary_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, sha256, kind of each file; the content stays a column for readers that need it."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), file_kind(F.col("content")).alias("kind"), "content")


def file_kind(content: Column) -> Column:
    """pdf, png, jpeg, gif, tiff, webp or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    marks = [("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff")]
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for m, k in marks:
        out = out.when(head.startswith(m), k)
    return out


def source_type(path: Column, text_chars: Column) -> Column:
    """digital_pdf, scanned_pdf, image or unknown, by name and how much text a page gave."""
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), F.when(text_chars >= 50, "digital_pdf").otherwise("scanned_pdf")).when(low.rlike(r"\.(png|jpe?g|tiff?|bmp|gif|webp|heic)$"), "image").otherwise("unknown")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
