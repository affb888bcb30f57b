"""The three jobs over a table of stored exchanges.

    python -m wiresift.jobs.audit detect|capture|decode IN OUT [parquet|json]

Damaged records go to OUT/damaged as they are stored.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from ..operators import capture, decode, detect, surfaces
from ..options import CaptureOptions, DecodeOptions, DetectOptions
from ..sources import exchanges as source
from ..sources import sinks


def detect_job(exchanges: DataFrame, options: DetectOptions = DetectOptions()) -> DataFrame:
    """Distinct findings."""
    return detect.distinct_findings(detect.findings(surfaces.detection(exchanges, options), options))


def capture_job(
    exchanges: DataFrame, options: DetectOptions = DetectOptions(), keep: CaptureOptions = CaptureOptions()
) -> tuple[DataFrame, DataFrame]:
    """(captured hashes, captured inputs)."""
    rows = capture.captured(exchanges, options)
    return capture.hashes_of(rows, keep), capture.inputs_of(rows, keep)


def decode_job(exchanges: DataFrame, options: DecodeOptions = DecodeOptions(), scope: DataFrame | None = None) -> DataFrame:
    rows = exchanges if scope is None or not options.scope_only else decode.in_scope(exchanges, scope)
    return decode.records(decode.first_hits(surfaces.decoding(rows, options), options), options)


def main(job: str, source_path: str, out: str, kind: str = "parquet") -> None:
    spark = SparkSession.builder.getOrCreate()
    source.damaged(spark, source_path, kind).write.mode("append").text(f"{out}/damaged")
    rows = source.read(spark, source_path, kind)
    if job == "detect":
        sinks.write_findings(detect_job(rows), f"{out}/findings")
    elif job == "capture":
        found = capture.captured(rows).persist()  # bodies are read once
        for name, part, columns in (("hashes", capture.hashes_of(found), ("value",)), ("inputs", capture.inputs_of(found), ("param_name", "value"))):
            part = part.persist()  # each goes to two sinks
            sinks.write_values(part, f"{out}/{name}")
            sinks.write_csv(part, f"{out}/{name}_csv", *columns)
            part.unpersist()
        found.unpersist()
    else:
        sinks.write_decoded(decode_job(rows), f"{out}/decoded")


if __name__ == "__main__":
    main(*sys.argv[1:5])
