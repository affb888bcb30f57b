"""The jobs over exchanges as they arrive: the batch transforms over a stream.

Detection and decoding keep no state.  De-duplication keeps a key until the
watermark has passed it, so its memory is bounded by time and not by a count.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import gates
from ..operators import capture, decode, detect, surfaces
from ..options import CaptureOptions, DecodeOptions, DetectOptions
from ..sources import sinks
from . import memory


def live_findings(stream: DataFrame, options: DetectOptions = DetectOptions()) -> DataFrame:
    return detect.findings(surfaces.detection(stream, options), options)


def live_tokens(stream: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """The first accepted token of every surface."""
    return decode.first_hits(surfaces.decoding(stream, options), options)


def distinct_values(found: DataFrame, late: str = "1 hour") -> DataFrame:
    """(ts, value) with each value once within the watermark's reach."""
    return found.select("ts", "value").withWatermark("ts", late).dropDuplicatesWithinWatermark(["value"])


def write_live_findings(stream: DataFrame, out: str, checkpoint: str, options: DetectOptions = DetectOptions()) -> StreamingQuery:
    rows = sinks.issues(live_findings(stream, options))
    writer = rows.writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(out)


def write_live_tokens(stream: DataFrame, out: str, checkpoint: str, options: DecodeOptions = DecodeOptions()) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        decode.records(df, options).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    writer = live_tokens(stream, options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


# --- capture ---------------------------------------------------------------


def live_captures(stream: DataFrame, options: DetectOptions = DetectOptions(), keep: CaptureOptions = CaptureOptions()) -> DataFrame:
    """What exchanges with a finding expose, repeats included: what (hash, input), exchange_id, ts, url, name, value and the finding's parts.

    Worked out in the exchange's own row, so the stream needs no join.
    """
    rows = capture.captured(stream, options)
    none = F.lit(None).cast("string")

    def found(f):
        return F.struct(F.lit("hash").alias("what"), none.alias("name"), f["value"].alias("value"), *[f[c].alias(c) for c in FOUND])

    def given(p):
        return F.struct(F.lit("input").alias("what"), F.coalesce(p["name"], F.lit("")).alias("name"), p["value"].alias("value"), *[none.alias(c) for c in FOUND])

    fits = F.filter("params", lambda p: gates.input_fits(p["value"], keep.min_input, keep.max_input))
    parts = F.explode(F.concat(F.transform("found", found), F.transform(fits, given))).alias("p")
    return rows.select("exchange_id", "ts", "url", parts).select("exchange_id", "ts", "url", "p.*")


FOUND = ("location", "kind", "label", "confidence")


def commit(rows: DataFrame, number: int, out: str) -> None:
    """Writes a micro-batch's findings, hashes and inputs, and then its commit.

    Each goes to a folder of its own number, so a repeated batch replaces itself.
    """
    rows = rows.persist()
    fresh = rows.where("fresh") if "fresh" in rows.columns else rows
    hashes = fresh.where("what = 'hash'").select("ts", "value")
    inputs = fresh.where("what = 'input'").select("ts", "name", "value")
    parts = {
        "findings": detect.described(rows.where("what = 'hash'")),
        "hashes": capture.distinct_hashes(hashes),
        "inputs": capture.distinct_inputs(inputs),
    }
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    rows.unpersist()
    rows.sparkSession.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/batch={number}")


def write_live_captures(
    stream: DataFrame, out: str, checkpoint: str, options: DetectOptions = DetectOptions(), keep: CaptureOptions = CaptureOptions(),
    ttl: timedelta | None = None, clear: DataFrame | None = None,
) -> StreamingQuery:
    """Findings, hashes and inputs as exchanges arrive, each micro-batch in one commit.

    With `ttl`, a hash or an input that was written less than that before is not written
    again, unless a row of the stream `clear` came in between; without, each batch's are distinct.
    """
    rows = live_captures(stream, options, keep)
    if ttl is not None:
        rows = memory.first_sightings(rows, ttl, clear)
    writer = rows.writeStream.foreachBatch(lambda df, number: commit(df, number, out)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Findings, hashes or inputs of the batches that were committed."""
    done = spark.read.parquet(f"{out}/commits").select("batch").distinct()
    return spark.read.parquet(f"{out}/{name}").join(done, "batch", "left_semi").drop("batch")


def committed_hashes(spark: SparkSession, out: str) -> DataFrame:
    """(ts, value): over all batches, as the batch job gives them."""
    return capture.distinct_hashes(committed(spark, out, "hashes"))


def committed_inputs(spark: SparkSession, out: str) -> DataFrame:
    """(ts, param_name, value): over all batches, as the batch job gives them."""
    return capture.distinct_inputs(committed(spark, out, "inputs").withColumnRenamed("param_name", "name"))
