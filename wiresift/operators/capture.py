"""Captured hashes and inputs of exchanges with findings, and their match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, gates, http
from ..options import CaptureOptions, DetectOptions
from ..sources import tables
from . import detect, surfaces


def distinct_hashes(found: DataFrame) -> DataFrame:
    """(ts, value): each value once, case-sensitive, at its first sighting.

    The minimum is formed in the map tasks, so a value in every exchange is no hot key.
    """
    return found.groupBy("value").agg(F.min("ts").alias("ts")).select("ts", "value")


def inputs(exchanges: DataFrame) -> DataFrame:
    """(exchange_id, ts, ptype, name, value): request parameters, cookies left out, empty values dropped."""
    params = codecs.parameters_udf()(*surfaces.json_and_xml(F.col("req_headers"), F.col("req_body")))
    rows = exchanges.select("exchange_id", "ts", F.explode(input_list(params)).alias("p"))
    return rows.select("exchange_id", "ts", "p.ptype", "p.name", "p.value")


def input_list(params: Column) -> Column:
    """[(ptype, name, value)]: an exchange's parameters in the url, in forms, and `params`, those of JSON and XML; empty values are dropped."""

    def given(p: Column) -> Column:
        return F.struct(F.lit("url").alias("ptype"), http.form_decoded(p["name"]).alias("name"), http.form_decoded(p["value"]).alias("value"))

    url = F.transform(http.pairs(F.coalesce(http.query(F.col("url")), F.lit("")), "&"), given)
    body = surfaces.body_parameters(F.col("req_headers"), F.col("req_body"), params)
    return F.filter(F.concat(url, body), lambda p: F.coalesce(p["value"] != "", F.lit(False)))


def captured(exchanges: DataFrame, options: DetectOptions = DetectOptions()) -> DataFrame:
    """(exchange_id, ts, url, found, params) of the exchanges with a finding: their findings and their inputs.

    All of it is worked out in the exchange's own row, so bodies are read once and nothing is joined.
    """
    rows, parts = surfaces.detection_parts(exchanges, options)
    some = F.filter(F.concat(*parts), lambda s: F.coalesce(F.length(s["text"]) > 0, F.lit(False)))
    one = F.array(F.struct(detect.gated_matches(some, options).alias("found"), input_list(F.col("made.params")).alias("params")))
    # Exploded, as a filter on the findings would work them out twice.
    hit = F.explode(F.filter(one, lambda x: F.size(x["found"]) > 0)).alias("x")
    return rows.select("exchange_id", "ts", "url", hit).select("exchange_id", "ts", "url", "x.found", "x.params")


def findings_of(rows: DataFrame) -> DataFrame:
    """Findings (FINDINGS) of captured()."""
    return detect.described(rows.select("exchange_id", "ts", "url", F.explode("found").alias("f")).select("exchange_id", "ts", "url", "f.*"))


def hashes_of(rows: DataFrame, options: CaptureOptions = CaptureOptions()) -> DataFrame:
    """(ts, value) of captured()."""
    found = rows.select("ts", F.explode("found").alias("f")).select("ts", "f.value")
    return distinct_hashes(found) if options.distinct_hashes else found


def inputs_of(rows: DataFrame, options: CaptureOptions = CaptureOptions()) -> DataFrame:
    """(ts, param_name, value) of captured(), within bounds; once for each finding if repeats are kept."""
    times = F.lit(1) if options.distinct_inputs else F.size("found")
    params = rows.select("ts", F.explode(F.flatten(F.array_repeat(F.col("params"), times))).alias("p")).select("ts", "p.name", "p.value")
    params = params.where(gates.input_fits(F.col("value"), options.min_input, options.max_input))
    return distinct_inputs(params) if options.distinct_inputs else params.selectExpr("ts", "name AS param_name", "value")


def inputs_of_findings(params: DataFrame, found: DataFrame, options: CaptureOptions = CaptureOptions()) -> DataFrame:
    """Inputs within bounds of every exchange that has a finding; once for each finding if repeats are kept."""
    fits = gates.input_fits(F.col("value"), options.min_input, options.max_input)
    hits = found.select("exchange_id")
    if options.distinct_inputs:
        return params.where(fits).join(hits.distinct(), "exchange_id", "left_semi")
    return params.where(fits).join(hits, "exchange_id")


def distinct_inputs(params: DataFrame) -> DataFrame:
    """(ts, param_name, value): each `name=value` text once, the earliest; a null name counts as empty."""
    key = F.concat_ws("=", F.coalesce("name", F.lit("")), "value")
    first = F.min(F.struct("ts", F.coalesce("name", F.lit("")).alias("name"), "value"))
    rows = params.groupBy(key.alias("key")).agg(first.alias("f"))
    return rows.select("f.ts", F.col("f.name").alias("param_name"), "f.value")


DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")


def digested(values: DataFrame) -> DataFrame:
    """(value, algorithm, digest) of distinct inputs."""
    data = F.col("value").cast("binary")
    made = [F.md5(data), F.sha1(data), *[F.sha2(data, n) for n in (224, 256, 384, 512)]]
    pairs = F.array(*[F.struct(F.lit(a).alias("algorithm"), d.alias("digest")) for a, d in zip(DIGESTS, made)])
    return values.select("value").distinct().select("value", F.explode(pairs).alias("d")).select("value", "d.*")


#: Bits of the table that sorts out digests nobody captured: so many for each hash, up to a bound (16 MB of bits, 2^21 words).
BITS_A_HASH, MOST_BITS = 64, 1 << 27


def bit_words(digests: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the words of the bit table in which digests have a bit; at most bits / 64."""
    at = bit_place("digest", bits)
    return digests.select(word_of(at).alias("word"), bit_of(at).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def bit_place(digest: str, bits: int) -> Column:
    return F.xxhash64(digest).bitwiseAND(bits - 1)


def word_of(at: Column) -> Column:
    return F.shiftright(at, 6).cast("int")


def bit_of(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))


def matched(hashes: DataFrame, values: DataFrame) -> DataFrame:
    """(hash, algorithm, plain): captured hashes that are the digest of a captured input.

    A table of bits, sized to the hashes and of bounded size, goes to all tasks, so of the six
    digests of an input only those are shuffled that may have been captured.
    """
    left = tables.written(hashes.select(F.col("value").alias("hash"), F.lower("value").alias("digest")).distinct())
    bits = min(MOST_BITS, 1 << max(12, (BITS_A_HASH * left.count()).bit_length()))
    made = digested(values)
    at = bit_place("digest", bits)
    words = F.broadcast(bit_words(left, bits))
    some = made.withColumn("_word", word_of(at)).join(words, F.col("_word") == F.col("word"))
    some = some.where(F.col("mask").bitwiseAND(bit_of(at)) != 0).select(*made.columns)
    return left.join(some, "digest").select("hash", "algorithm", F.col("value").alias("plain"))
