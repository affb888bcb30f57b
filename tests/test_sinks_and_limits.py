"""Reading with damage, sinks, the numbered export, the bit table of matching, and the command line."""

import gzip
import hashlib
import json

import pyarrow as pa
from pyspark.sql import functions as F

from wiresift import queries, schema
from wiresift.jobs import audit
from wiresift.functions import codecs
from wiresift.operators import capture
from wiresift.sources import exchanges, sinks

SF = "/root/testdata/sf0.001"


def test_export_numbers_any_number_of_rows(spark):
    words = F.concat(F.lit("w"), (F.col("id") * 7919 % 300_007).cast("string"))
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 1000).alias("exchange_id"), F.lit(None).cast("timestamp").alias("ts"), F.lit("h").alias("host"),
        F.lit(-1).alias("port"), F.lit("o").alias("origin"), F.lit(9).alias("token_len"), words.alias("token"), F.when(F.col("id") < 299_990, words).otherwise("").alias("decoded"),
    )
    got = sinks.export(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]  # the one window is over the ranges' counts
    numbered = got.orderBy("row").select("row", "token", "decoded").toPandas()
    assert numbered["row"].tolist() == list(range(1, 299_991))
    want = rows.where("decoded <> ''").orderBy(*sinks.EXPORT_ORDER).select("token").toPandas()
    assert numbered["token"].tolist() == want["token"].tolist()
    assert sinks.export(rows.where("false")).count() == 0


def test_bit_table_loses_no_match(spark):
    values = spark.range(3000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    data = F.col("value").cast("binary")
    hashes = values.where("substr(value, -1) = '7'").select(F.upper(F.md5(data)).alias("value"))
    hashes = hashes.unionByName(values.where("substr(value, -2) = '13'").select(F.sha2(data, 384).alias("value"))).unionByName(values.select(F.sha1(F.concat(data, data)).alias("value")))
    got = capture.matched(hashes, values)
    made = capture.digested(values)
    want = hashes.select(F.col("value").alias("hash"), F.lower("value").alias("digest")).distinct().join(made, "digest").select("hash", "algorithm", F.col("value").alias("plain"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 330
    words = capture.bit_words(made.where("algorithm = 'md5'"), 1 << 12)
    assert words.count() <= (1 << 12) // 64
    assert capture.matched(hashes.where("false"), values).count() == 0


def test_damaged_records_go_aside(spark, tmp_path):
    rows = queries.ex(spark, SF)
    top = str(tmp_path)
    exchanges.write(rows, f"{top}/j", "json")
    bad = ['{"exchange_id": 1, "url": "cut', "not json", '{"url": "no id"}', '{"exchange_id": "text"}', '{"exchange_id": 5, "req_headers": "no list"}']
    spark.createDataFrame([(b,) for b in [*bad, "", "   "]], "value string").write.mode("append").text(f"{top}/j")
    assert sorted(map(str, exchanges.read(spark, f"{top}/j", "json").collect())) == sorted(map(str, rows.collect()))
    assert sorted(r["raw"] for r in exchanges.damaged(spark, f"{top}/j", "json").collect()) == sorted(bad)

    none = rows.limit(1).withColumn("exchange_id", F.lit(None).cast("long"))
    exchanges.write(rows.unionByName(none), f"{top}/p")
    assert exchanges.read(spark, f"{top}/p").count() == rows.count()
    assert [json.loads(r["raw"])["url"] for r in exchanges.damaged(spark, f"{top}/p").collect()] == [none.first()["url"]]
    exchanges.write(rows.where("false"), f"{top}/e")
    assert exchanges.read(spark, f"{top}/e").count() == 0


def test_large_and_many_member_bodies_are_searched(spark):
    deep, second = (hashlib.sha256(x).hexdigest() for x in (b"deep", b"second"))
    filler = b"<p>some words of a page</p>\n" * 1_000_000
    head = ["Content-Type: text/html", "Content-Encoding: gzip"]
    bodies = [gzip.compress(filler + b" " + deep.encode() + b" </p>"), gzip.compress(b"first part ") + gzip.compress(b"x " + second.encode() + b" y")]
    rows = [(i, None, "t", "GET", f"https://a.example/{i}", [], None, head, b) for i, b in enumerate(bodies)]
    found = audit.detect_job(spark.createDataFrame(rows, schema.EXCHANGES)).collect()
    assert {(r["exchange_id"], r["value"]) for r in found} == {(0, deep), (1, second)}


def test_command_line(spark, tmp_path):
    rows, top = queries.ex(spark, SF), str(tmp_path)
    exchanges.write(rows, f"{top}/in", "json")
    spark.createDataFrame([("broken",)], "value string").write.mode("append").text(f"{top}/in")
    for job in ("detect", "capture", "decode"):
        audit.main(job, f"{top}/in", f"{top}/{job}", "json")
        assert [r["value"] for r in spark.read.text(f"{top}/{job}/damaged").collect()] == ["broken"]
    found = spark.read.parquet(f"{top}/detect/findings")
    assert {r["kind"] for r in found.select("kind").distinct().collect()} == {"hex", "label", "mcf"}
    want = sinks.issues(audit.detect_job(rows))
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))
    hashes, inputs = audit.capture_job(rows)
    assert spark.read.text(f"{top}/capture/hashes").count() == hashes.count()
    assert spark.read.option("header", True).csv(f"{top}/capture/inputs_csv").columns == ["timestamp", "param_name", "value"]
    assert spark.read.text(f"{top}/capture/inputs").count() == inputs.count()
    decoded = spark.read.parquet(f"{top}/decode/decoded")
    want = audit.decode_job(rows)
    assert sorted(map(str, decoded.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_large_batches_are_worked_on_in_slices(spark):
    """A batch's bytes, not its number of rows, bound what stands in memory."""
    rows = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))

    def run(b):
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = codecs.in_slices(rows, run, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) < 2 * codecs.SLICE
