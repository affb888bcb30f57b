"""Small things that the operators share: shared folders, sizes and column handling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors reach.

    Where the session has none (tests on one machine), one is set once for
    the whole session below the warehouse.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/wiresift-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables from written() whose readers have all been written themselves."""
    for df in tables:
        path = df.__dict__.pop("_written_to", None)
        if path is not None:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(column):
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, spread) -> DataFrame:
    """`rows` left-joined with `table` (key, weight, ...) on `key`, which is unique there; `weight` is left out.

    `weight` is how many rows will ask for a key.  Keys that a thousandth of all weights
    or more asks for are fewer than 1001, so they are broadcast; the rest are joined by
    shuffle, where no key is that heavy.  `spread` is a column of `rows` of the key's
    type that deals out the rows that are already answered.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * 1000 >= max(1, total)
    rest = [c for c in table.columns if c not in (key, weight)]

    def part(which, mark: str) -> DataFrame:
        return table.where(which).select(F.col(key).alias(f"_{mark}_key"), F.struct(F.lit(1), *rest).alias(f"_{mark}"))

    out = rows.join(F.broadcast(part(heavy, "hot")), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_key", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(F.concat(F.col(key), spread)))
    out = out.join(part(~heavy, "cold"), F.col("_key") == F.col("_cold_key"), "left")
    found = [F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in rest]
    return out.select(*rows.columns, *found)
