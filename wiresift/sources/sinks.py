"""Writing findings, captured values and decoded tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables

TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def one_line(value):
    """A value as one line of text: backslashes and line breaks are escaped."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def value_lines(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull()).select(one_line(F.col("value")).alias("value"))


def write_values(df: DataFrame, path: str) -> None:
    """Text files with one value a line; appended."""
    value_lines(df).write.mode("append").text(path)


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.date_format("ts", TIMESTAMP).alias("timestamp"), *columns)


def write_csv(df: DataFrame, path: str, *columns: str) -> None:
    """CSV with a header, a timestamp column first, and doubled quotes inside quoted fields."""
    stamped(df, *columns).write.mode("append").option("header", True).option("escape", '"').csv(path)


def issues(findings: DataFrame) -> DataFrame:
    return findings.select("url", "title", "confidence", F.lit("Information").alias("severity"), "detail", "kind")


def write_findings(findings: DataFrame, path: str) -> None:
    issues(findings).write.mode("append").partitionBy("kind").parquet(path)


EXPORT_ORDER = ("exchange_id", "origin", "token", "decoded")


def export(decoded: DataFrame) -> DataFrame:
    """Decoded rows of a report, numbered in their order from 1; rows without text are left out.  Any number of them.

    The rows are sorted by ranges and written; a row's number is its place in its range
    and the count of the ranges before, of which there is a row for each.
    """
    rows = decoded.where(F.col("decoded") != "")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *EXPORT_ORDER).sortWithinPartitions(*EXPORT_ORDER)
    # The upper bits of this number are the range, the lower ones the place in it.
    placed = tables.written(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))  # a row for each range
    number = (F.col("_before") + place + 1).alias("row")
    return placed.withColumn("_part", part).join(starts, "_part").select(number, "ts", "host", "port", "origin", "token_len", "decoded", "token")


def write_decoded(decoded: DataFrame, path: str) -> None:
    decoded.where(F.col("decoded") != "").write.mode("append").partitionBy("direction").parquet(path)
