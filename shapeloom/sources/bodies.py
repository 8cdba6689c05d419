"""Request bodies from files: one a file, or one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = " \t\r\0\x0b"


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, request): each file is one request."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("request"))


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(file, request): a request a line; blank lines are skipped. Lines end at line feeds alone, files stay splittable."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(BLANK)).alias("request")).filter("request <> ''")


def of_text(df: DataFrame, text: str, to: str = "request") -> DataFrame:
    """A row for each request in a column of NDJSON text, beside the other columns."""
    each = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    return df.withColumn(to, F.explode(each)).drop(*({text} - {to}))
