"""Findings: digests and password-hash strings in text surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..options import DetectOptions


def _find(kind: str, value: Column, label: Column | None = None, around: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        value.alias("value"),
        (none if label is None else label).alias("label"),
        (none if around is None else around).alias("around"),
    )


def raw_matches(text: Column, options: DetectOptions = DetectOptions()) -> Column:
    """[(kind, value, label, around)]: every raw match in a text, before the gates."""
    found = []
    if options.mcf:
        some = F.when(F.contains(text, F.lit("$")), digests.mcf_strings(text)).otherwise(F.array().cast("array<string>"))
        found.append(F.transform(some, lambda v: _find("mcf", v)))
    if options.strict and options.strict_local_context:
        found.append(F.transform(digests.labelled(text), lambda p: _find("label", p["value"], label=p["label"])))
        runs = digests.runs_with_context(text, options.min_hex_len)
        found.append(F.transform(runs, lambda r: _find("hex", r["value"], around=r["around"])))
    else:
        runs = digests.labelled_runs(text, options.min_hex_len)
        label = F.filter(runs, lambda r: r["label"].isNotNull() & (F.length(r["value"]) >= digests.LEAST_LABELLED))
        found.append(F.transform(label, lambda r: _find("label", F.left(r["value"], F.lit(digests.MOST_LABELLED)), label=r["label"])))
        runs = F.filter(runs, lambda r: F.length(r["value"]) >= max(1, options.min_hex_len))
        found.append(F.transform(runs, lambda r: _find("hex", r["value"])))
    return F.concat(*found)


def may_match(text: Column, options: DetectOptions) -> Column:
    """A text without a run of the least length and without a `$` sign can't match anything."""
    least = max(1, min(options.min_hex_len, digests.LEAST_LABELLED))
    return F.coalesce(text.rlike(f"[0-9A-Fa-f]{{{least}}}") | F.contains(text, F.lit("$")), F.lit(False))


def matches(surfaces: DataFrame, options: DetectOptions = DetectOptions()) -> DataFrame:
    """`surfaces` and kind, value, label, around: every raw match, before the gates."""
    text = F.col("text")
    rows = surfaces.where(may_match(text, options)).withColumn("m", F.explode(raw_matches(text, options)))
    return rows.select(*surfaces.columns, "m.kind", "m.value", "m.label", "m.around")


def gate(options: DetectOptions, kind: Column, value: Column, around: Column, location: Column) -> Column:
    """Which matches are findings."""
    o = options
    hexed = ~digests.is_skipped(value, o.min_hex_len) & digests.likely_digest(value, o)
    plain = F.length(value) <= o.max_hex_len
    if o.strict:
        if o.strict_exact_lengths:
            plain = plain & digests.is_exact_length(value)
        plain = plain & (digests.digit_share(value) >= 0.10)
        if o.strict_local_context:
            exempt = F.lit(False)
            for x in digests.EXEMPT_LOCATIONS:
                exempt = exempt | location.startswith(x)
            near = F.coalesce(around.rlike("|".join(digests.LOCAL_KEYWORDS)), F.lit(False))
            plain = plain & (digests.is_exact_length(value) | near | exempt)
    return (kind == "mcf") | (((kind == "label") | plain) & hexed)


def gated_matches(surfaces: Column, options: DetectOptions = DetectOptions()) -> Column:
    """[(location, kind, value, label)] of the findings in an array of surfaces (location, text)."""

    def each(s: Column) -> Column:
        some = F.when(may_match(s["text"], options), raw_matches(s["text"], options))
        kept = F.filter(some, lambda m: gate(options, m["kind"], m["value"], m["around"], s["location"]))
        kept = F.transform(kept, lambda m: F.struct(s["location"].alias("location"), m["kind"].alias("kind"), m["value"].alias("value"), m["label"].alias("label"), sure(m["kind"], s["text"], options).alias("confidence")))
        return F.coalesce(kept, F.array().cast("array<struct<location:string,kind:string,value:string,label:string,confidence:string>>"))

    return F.flatten(F.transform(surfaces, each))


def sure(kind: Column, text: Column, options: DetectOptions) -> Column:
    if not options.require_context:
        return F.lit("Firm")
    return F.when((kind != "hex") | digests.has_keyword(text), "Firm").otherwise("Tentative")


def findings(surfaces: DataFrame, options: DetectOptions = DetectOptions()) -> DataFrame:
    """One row for each finding (FINDINGS), repeats included."""
    passed = gate(options, F.col("kind"), F.col("value"), F.col("around"), F.col("location"))
    rows = matches(surfaces, options).where(passed)
    return described(rows.withColumn("confidence", sure(F.col("kind"), F.col("text"), options)))


def described(rows: DataFrame) -> DataFrame:
    """Findings (FINDINGS) from location, kind, value, label, confidence."""
    kind, value, place = F.col("kind"), F.col("value"), F.col("location")
    title = F.when(kind == "mcf", "Hash/token (MCF)").when(
        kind == "label", F.concat(F.lit("Hash/token (label:"), F.col("label"), F.lit(")"))
    ).otherwise("Hash/token (hex)")
    names = F.when(kind == "hex", digests.candidates(value))
    length = F.when(kind != "mcf", F.length(value))
    start = F.concat(F.lit("Location: "), place, F.lit("<br>Value: <b>"), value, F.lit("</b><br>"))
    detail = F.when(kind == "mcf", F.concat(start, F.lit("Type: MCF"))).when(
        kind == "label", F.concat(start, F.lit("Label: "), F.col("label"))
    ).otherwise(F.concat(start, F.lit("Len: "), length.cast("string"), F.lit("<br>Candidates: "), F.concat_ws(", ", names)))
    keep = [c for c in ("exchange_id", "ts", "url", "location") if c in rows.columns]
    return rows.select(
        *keep, "kind", title.alias("title"), "confidence", "value",
        length.alias("hex_len"), "label", names.alias("candidates"), detail.alias("detail"),
    )


def distinct_findings(found: DataFrame) -> DataFrame:
    """One row for each (url, title, detail)."""
    return found.dropDuplicates(["url", "title", "detail"])


def by_algorithm(found: DataFrame) -> DataFrame:
    """One row for each finding and algorithm that it may be of; null where none is named."""
    return found.withColumn("algorithm", F.explode_outer("candidates"))
