"""URL filter: host rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host.  Rates are shrunk down a
hierarchy of beta-binomial priors: all pages, the suffix, the registered
domain, the host.  How strong each level's prior is comes from the data, by
the method of moments on how much the rates of a level differ beyond what
chance explains.  A url is blocked when even the lower bound of its host's
posterior rate of bad pages is above a threshold; hosts without labels take
their domain's (suffix's, global) rate with that prior's spread.

Every level is a table of its own and meets the pages by a join, so nothing
grows on the driver.  Null urls and urls without `://` have an empty host and
path and the global posterior.  Null labels count for nothing; a page with
several labels counts each.  Repeated page rows are judged each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Suffixes of two labels: one of these before a two-letter country label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without a `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(shared.lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (`host/path prefix`) that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, _, prefix = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """A host less user and port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    last, before = F.substring_index(host, ".", -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    two = (F.length(last) == 2) & before.isin(*SECOND_LEVEL) & (F.instr(host, ".") > 0)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(last)


def domain_of(host: Column) -> Column:
    two = F.instr(suffix_of(host), ".") > 0
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(children: DataFrame, name: str) -> DataFrame:
    """One row: how many pages the prior of these children (n, bad, rate of the parent) is worth.

    The spread of the children's rates about their parent's, beyond binomial
    chance, gives the intra-class correlation; it is held within bounds.
    """
    n, off = F.col("n"), F.col("bad") / F.col("n") - F.col("rate")
    chance = F.col("rate") * (1 - F.col("rate"))
    sums = children.where(chance > 0).agg(
        F.sum(n * off * off / chance).alias("s"),
        F.count("*").alias("m"),
        F.sum(n).alias("total"),
        F.sum(n * n).alias("squares"),
    )
    room = F.col("total") - F.col("m")
    rho = F.when(room > 0, (F.col("s") - F.col("m")) / room)
    held = F.least(F.lit(0.5), F.greatest(F.lit(0.001), F.coalesce(rho, F.lit(0.05))))
    return sums.select(F.round((1 - held) / held, 6).alias(name))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior (alpha, beta) of the bad rate by name, domain and suffix, and a row of what holds for all.

    outcomes: (name, bad 0/1); aggregation by name comes first, so one hot
    host is one row after each task's own sums.
    """
    by_name = outcomes.groupBy("name").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    by_name = shared.written(by_name.select("name", domain_of(F.col("name")).alias("domain"), "n", "bad"))
    by_domain = by_name.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_domain = shared.written(by_domain.select("domain", suffix_of(F.col("domain")).alias("suffix"), "n", "bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # One pseudo-page each way keeps the global rate inside (0, 1), and defined without labels.
    everything = by_suffix.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    everything = everything.select(((F.col("bad") + 1) / (F.col("n") + 2)).alias("rate"))

    def shrunk(level: DataFrame, key: str, strength: str) -> tuple[DataFrame, DataFrame]:
        """level: key, n, bad, rate (its parent's)."""
        s = shared.written(_strength(level, strength))
        joined = level.crossJoin(F.broadcast(s))  # one row
        alpha = F.col(strength) * F.col("rate") + F.col("bad")
        beta = F.col(strength) * (1 - F.col("rate")) + F.col("n") - F.col("bad")
        return shared.written(joined.select(key, alpha.alias("alpha"), beta.alias("beta"))), s

    rate = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    suffixes, of_suffixes = shrunk(by_suffix.crossJoin(F.broadcast(everything)), "suffix", "suffix_strength")
    parents = suffixes.select("suffix", rate.alias("rate"))
    domains, of_domains = shrunk(by_domain.join(parents, "suffix"), "domain", "domain_strength")
    parents = domains.select("domain", rate.alias("rate"))
    names, of_names = shrunk(by_name.join(parents, "domain"), "name", "name_strength")
    for one in (of_suffixes, of_domains, of_names):
        everything = everything.crossJoin(F.broadcast(one))  # single rows
    return names, domains, suffixes, shared.written(everything)


def _spread(rate: Column, *strengths: Column) -> Column:
    """(alpha, beta) of a rate below levels of such strengths: each leaves s / (s + 1) of rate * (1 - rate) to those below."""
    left = F.lit(1.0)
    for s in strengths:
        left = left * s / (s + 1)
    return F.struct((left / (1 - left) * rate).alias("alpha"), (left / (1 - left) * (1 - rate)).alias("beta"))


#: places at which a beta distribution is summed up
GRID = 512


def _given(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def beta_quantile(a: Column, b: Column, share: float) -> Column:
    """The value that a beta variable is below with probability `share`.

    The density over the log-odds has no poles; it is summed up on a grid around its peak.
    """
    peak, wide = F.ln(a / b), F.sqrt(1 / a + 1 / b)
    low = peak - 9 / a - 8 * wide
    step = (9 / b + 9 / a + 16 * wide) / (GRID - 1)

    def log_density(y: Column) -> Column:
        return a * F.least(y, F.lit(0.0)) + b * F.least(-y, F.lit(0.0)) - (a + b) * F.ln(1 + F.exp(-F.abs(y)))

    def weighed(g: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(GRID - 1))
        weights = F.transform(places, lambda i: F.exp(log_density(g["low"] + g["step"] * i) - g["top"]))
        return _given(weights, lambda w: _given(F.aggregate(w, F.lit(0.0), lambda t, x: t + x) * share, lambda wanted: walked(g, w, wanted)))

    def walked(g: Column, weights: Column, wanted: Column) -> Column:
        def walk(t: Column, w: Column) -> Column:
            """`place`: grid steps until the sum is as wanted, the last one in part."""
            part = F.when(t["sum"] + w <= wanted, 1.0).when(t["sum"] < wanted, (wanted - t["sum"]) / w).otherwise(0.0)
            return F.struct((t["sum"] + w).alias("sum"), (t["place"] + part).alias("place"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("place"))
        place = F.aggregate(weights, start, walk)["place"]
        return g["low"] + g["step"] * (place - 0.5)  # a weight stands for half a step on either side

    grid = F.struct(low.alias("low"), step.alias("step"), log_density(peak).alias("top"))
    return _given(_given(grid, weighed), lambda y: F.exp(F.least(y, F.lit(0.0))) / (1 + F.exp(-F.abs(y))))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    threshold: float = 0.5,
    share: float = 0.05,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_rate, bad_lower.

    pages (page_id, url); outcomes (url, bad).  A host's rate of bad pages is
    below `bad_lower` with probability `share`.
    """
    name = name_of(parts(F.col("url"))[0])
    labelled = outcomes.where(F.col("bad").isNotNull()).select(name.alias("name"), F.col("bad").cast("long"))
    names, domains, suffixes, everything = reputation(labelled.where(F.col("name") != ""))
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    # Hosts are many and pages skewed: reputation is worked out per distinct host, then joined once.
    seen = out.select("host").distinct().withColumn("name", name_of(F.col("host")))
    seen = seen.withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("name")))
    for table, key in ((names, "name"), (domains, "domain"), (suffixes, "suffix")):
        seen = seen.join(table.select(key, F.struct("alpha", "beta").alias(f"{key}_post")), key, "left")
    seen = seen.crossJoin(F.broadcast(everything))  # one row
    by_name, by_domain, by_suffix = (F.col(f"{k}_strength") for k in ("name", "domain", "suffix"))

    def pages_of(post: str) -> Column:
        return F.col(f"{post}.alpha") + F.col(f"{post}.beta")

    post = (
        F.when(F.col("name_post").isNotNull(), F.col("name_post"))
        .when(F.col("domain_post").isNotNull(), _spread(F.col("domain_post.alpha") / pages_of("domain_post"), pages_of("domain_post"), by_name))
        .when(F.col("suffix_post").isNotNull(), _spread(F.col("suffix_post.alpha") / pages_of("suffix_post"), pages_of("suffix_post"), by_domain, by_name))
        .otherwise(_spread(F.col("rate"), by_suffix, by_domain, by_name))
    )
    seen = seen.select("host", post.alias("post")).select("host", "post.alpha", "post.beta")
    a, b = F.col("alpha"), F.col("beta")
    scores = seen.select("host", F.round(a / (a + b), 6).alias("bad_rate"), F.round(beta_quantile(a, b, share), 6).alias("bad_lower"))
    out = out.join(shared.written(scores), "host", "left")
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_lower") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "bad_rate", "bad_lower")
