"""One-pass matching and capture against the separate operators."""

import random

import pytest
from pyspark.sql import functions as F

from wiresift import queries
from wiresift.functions import digests
from wiresift.jobs import audit
from wiresift.operators import capture, detect, surfaces
from wiresift.options import CaptureOptions, DetectOptions

SF = "/root/testdata/sf0.001"


def made_texts():
    rng = random.Random(4)
    parts = ["md5", "MD5", "sha3-224", "sha256", "ripemd160", "blake2b", ":", "=", " ", "\n", "-", "_", "x", "a1b2c3d4", "deadbeefdeadbeef" * 3, "f" * 300, "é", "12345678", "$1$abc", "sha1"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["md5:" + "ab" * 200 + " sha1 = " + "0" * 8, "", None]


@pytest.mark.parametrize("least", [1, 5, 8, 12])
def test_one_pass_finds_what_separate_passes_find(spark, least):
    rows = spark.createDataFrame([(t,) for t in made_texts()], "t string")
    t = F.col("t")
    got = rows.select("t", digests.labelled_runs(t, least).alias("one"), digests.labelled(t).alias("labelled"), digests.hex_runs(t, least).alias("runs")).collect()
    for r in got:
        if r["t"] is None:
            continue
        plain = [x["value"] for x in r["one"] if len(x["value"]) >= least and (least > digests.LABEL_RUN or x["label"] is None)]
        assert plain == r["runs"], r["t"]
        named = [(x["label"], x["value"][:256]) for x in r["one"] if x["label"] and len(x["value"]) >= 8]
        assert named == [tuple(x) for x in r["labelled"]], r["t"]


@pytest.mark.parametrize("options", [DetectOptions(), DetectOptions(strict=True, require_context=True, scan_headers=True, min_hex_len=4)])
def test_capture_in_the_row_equals_the_joined_way(spark, options):
    rows = queries.ex(spark, SF)
    found = detect.findings(surfaces.detection(rows, options), options)
    got = capture.captured(rows, options)
    assert sorted(map(str, capture.findings_of(got).collect())) == sorted(map(str, found.collect()))
    for keep in (CaptureOptions(), CaptureOptions(distinct_hashes=False, distinct_inputs=False, max_input=20))[options.strict :]:
        hashes, inputs = audit.capture_job(rows, options, keep)
        want = capture.distinct_hashes(found) if keep.distinct_hashes else found.select("ts", "value")
        assert sorted(map(str, hashes.collect())) == sorted(map(str, want.collect()))
        params = capture.inputs_of_findings(capture.inputs(rows), found, keep)
        want = capture.distinct_inputs(params) if keep.distinct_inputs else params.selectExpr("ts", "name AS param_name", "value")
        assert sorted(map(str, inputs.collect())) == sorted(map(str, want.collect()))


def test_capture_scans_once_and_joins_nothing(spark):
    _, inputs = audit.capture_job(queries.ex(spark, SF))
    plan = inputs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_context_relabels_and_vowels_reject(spark):
    digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0bcd15d6c15b0f00a08aa1"
    rows = spark.createDataFrame([(1, "hash of it " + digest), (2, "nothing near " + digest)], "exchange_id long, text string").withColumn("location", F.lit("x"))
    got = detect.findings(rows, DetectOptions(require_context=True)).collect()
    assert {(r["exchange_id"], r["confidence"]) for r in got} == {(1, "Firm"), (2, "Tentative")}
    assert {r["confidence"] for r in detect.findings(rows).collect()} == {"Firm"}

    words = ["the quick brown fox jumps over it", "th qck brwn fx jmps vr t bcd fgh jk", "aaa eee iii ooo uuu aaa eee iii o"]
    pairs = digests.byte_pairs(F.hex(F.col("t").cast("binary")))
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(digests.looks_like_english(pairs).alias("new"), digests.looks_like_english(pairs, True).alias("old"))
    assert [tuple(r) for r in rows.collect()] == [(True, True), (True, False), (True, False)]
