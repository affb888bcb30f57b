"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, jaccard_join, language_id, license_scan, line_dedup, packing, perplexity, prefix_trie, shared, substring_dedup, token_output,
    url_filter, warc, whitening,
)

END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed values of the URL query: rule (host/path prefix) and its verdict.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its own number: bad if toxic or of low quality."""
    pages = shared.read(spark, sf_dir, "pages").select("page_id", "url")
    labels = shared.read(spark, sf_dir, "labels")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    outcomes = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", bad.alias("bad"))
    return url_filter.judge(pages, outcomes, URL_RULES)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(shared.read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.read(spark, sf_dir, "documents"), tokenizer_path(), END_ID, 1024)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(shared.read(spark, sf_dir, "documents"), with_text=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(shared.read(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.shared_folder(spark)
    index = token_output.write(shared.read(spark, sf_dir, "documents"), folder, tokenizer_path(), END_ID)
    return token_output.read_back(index, folder)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a null id is not held out
    docs = docs.withColumn("held_out", held_out)
    learn = docs.where(~F.col("held_out")).select("text", "lang")
    langs, table = language_id.train(learn)
    judged = language_id.predict(docs.select("doc_id", "text", "held_out"), langs, table)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "unknown_share", "lang_shares")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(shared.read(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(shared.read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(shared.read(spark, sf_dir, "embeddings"), most=8)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.build(shared.read(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.shared_folder(spark)
    made = warc.write(shared.read(spark, sf_dir, "pages"), folder)
    files = warc.archives(spark, folder) if made.head(1) else made.select("path", "bytes")
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_output": op7_token_output,
    "op8_line_dedup": op8_line_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc": op13_warc,
}


def _rules_sql() -> str:
    """The longest rule that fits, as nested CASE branches."""
    branches = []
    for text, _ in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0])):
        name, _, prefix = text.partition("/")
        branches.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}') THEN '{text}'")
    return f"CASE {' '.join(branches)} END"


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
_TWO = ", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)


def _two(host: str) -> str:
    return f"(length(split_part({host}, '.', -1)) = 2 AND split_part({host}, '.', -2) IN ({_TWO}) AND instr({host}, '.') > 0)"


def _last(host: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -{n}, -1), '.')"


def _strength_sql(level: str, name: str) -> str:
    return f"""{name} AS (SELECT round((1 - h) / h, 6) AS s FROM (SELECT least(0.5, greatest(0.001, coalesce(CASE WHEN total - m > 0 THEN (q - m) / (total - m) END, 0.05))) AS h
  FROM (SELECT sum(n * (bad / n - rate) * (bad / n - rate) / (rate * (1 - rate))) AS q, count(*) AS m, sum(n) AS total FROM {level} WHERE rate * (1 - rate) > 0)))"""


def _domain_sql(name: str) -> str:
    return f"CASE WHEN {_two(name)} THEN {_last(name, 3)} ELSE {_last(name, 2)} END"


def _suffix_sql(name: str) -> str:
    return f"CASE WHEN {_two(name)} THEN {_last(name, 2)} ELSE split_part({name}, '.', -1) END"


_NAME = "regexp_replace(split_part(host, '@', -1), ':[0-9]*$', '')"
_DENSITY = "alpha * least({0}, 0) + beta * least(-({0}), 0) - (alpha + beta) * ln(1 + exp(-abs({0})))"

OP1_SQL = f"""WITH judged AS (SELECT page_id, url, coalesce({_LOW.format(f"regexp_extract({_REST}, '^([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract({_REST}, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM pages),
outcomes AS (SELECT {_NAME} AS name, CAST(toxic = 1 OR quality = 0 AS BIGINT) AS bad FROM judged JOIN labels ON page_id = doc_id WHERE {_NAME} <> ''),
h0 AS (SELECT name, count(*) AS n, sum(bad) AS bad, {_domain_sql('name')} AS domain FROM outcomes WHERE bad IS NOT NULL GROUP BY name),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, {_suffix_sql('domain')} AS suffix FROM h0 GROUP BY domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
g AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS rate FROM s0),
s1 AS (SELECT s0.*, rate FROM s0, g), {_strength_sql('s1', 'ss')},
s2 AS (SELECT suffix, s * rate + bad AS alpha, s * (1 - rate) + n - bad AS beta FROM s1, ss),
d1 AS (SELECT d0.*, alpha / (alpha + beta) AS rate FROM d0 JOIN s2 USING (suffix)), {_strength_sql('d1', 'ds')},
d2 AS (SELECT domain, s * rate + bad AS alpha, s * (1 - rate) + n - bad AS beta FROM d1, ds),
h1 AS (SELECT h0.*, alpha / (alpha + beta) AS rate FROM h0 JOIN d2 USING (domain)), {_strength_sql('h1', 'hs')},
h2 AS (SELECT name, s * rate + bad AS alpha, s * (1 - rate) + n - bad AS beta FROM h1, hs),
named AS (SELECT *, {_domain_sql('name')} AS domain, {_suffix_sql('name')} AS suffix FROM (SELECT DISTINCT host, {_NAME} AS name FROM judged)),
kept AS (SELECT host, h2.alpha AS ha, h2.beta AS hb, coalesce(d2.alpha / (d2.alpha + d2.beta), s2.alpha / (s2.alpha + s2.beta), g.rate) AS rate,
  hs.s / (hs.s + 1) * CASE WHEN d2.alpha IS NOT NULL THEN (d2.alpha + d2.beta) / (d2.alpha + d2.beta + 1)
    WHEN s2.alpha IS NOT NULL THEN ds.s / (ds.s + 1) * (s2.alpha + s2.beta) / (s2.alpha + s2.beta + 1) ELSE ds.s / (ds.s + 1) * ss.s / (ss.s + 1) END AS rest
  FROM named CROSS JOIN g CROSS JOIN hs CROSS JOIN ds CROSS JOIN ss LEFT JOIN h2 USING (name) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix)),
post AS (SELECT host, coalesce(ha, rest / (1 - rest) * rate) AS alpha, coalesce(hb, rest / (1 - rest) * (1 - rate)) AS beta FROM kept),
edges AS (SELECT *, ln(alpha / beta) AS peak, sqrt(1 / alpha + 1 / beta) AS wide FROM post),
grid AS (SELECT *, peak - 9 / alpha - 8 * wide AS low, (9 / beta + 9 / alpha + 16 * wide) / {url_filter.GRID - 1} AS step FROM edges),
density AS (SELECT host, low, step, i, exp({_DENSITY.format('(low + step * i)')} - ({_DENSITY.format('peak')})) AS w FROM grid, range({url_filter.GRID}) AS r(i)),
summed AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY i) AS upto, 0.05 * sum(w) OVER (PARTITION BY host) AS wanted FROM density),
found AS (SELECT host, low + step * (i + 1 - (upto - wanted) / w - 0.5) AS y FROM summed WHERE upto > wanted QUALIFY row_number() OVER (PARTITION BY host ORDER BY i) = 1),
scores AS (SELECT host, round(alpha / (alpha + beta), 6) AS bad_rate, round(exp(least(y, 0)) / (1 + exp(-abs(y))), 6) AS bad_lower FROM post JOIN found USING (host)),
ruled AS (SELECT judged.*, {_rules_sql()} AS rule, bad_rate, bad_lower FROM judged JOIN scores USING (host))
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{t}' THEN '{v}'" for t, v in URL_RULES)} WHEN bad_lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict, bad_rate, bad_lower FROM ruled"""


def _values(rows) -> str:
    def text(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else f"'{v}'"

    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


_SQL_WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"

OP2_SQL = f"""WITH templates(template, label, whole, votes, pattern, place, t1, t2, t3) AS (VALUES {_values(license_scan.template_rows())}),
docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_SQL_WORDS}') AS w FROM documents),
words AS (SELECT r, unnest(range(len(w))) AS pos, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM docs),
hits AS (SELECT r, template, label, whole, votes, pattern, place, pos, pos - place AS diagonal FROM words JOIN templates ON w1 = t1 AND w2 = t2 AND (whole OR w3 = t3)),
base AS (SELECT r, label, diagonal AS start FROM hits WHERE whole GROUP BY r, template, label, votes, diagonal HAVING count(*) >= votes),
spans AS (SELECT a.r, a.template, a.label, a.pattern, a.diagonal, min(h.pos) AS lo, max(h.pos) + 2 AS hi
  FROM (SELECT DISTINCT r, template, label, votes, pattern, diagonal FROM hits WHERE NOT whole) a
  JOIN hits h ON h.r = a.r AND h.template = a.template AND h.diagonal BETWEEN a.diagonal AND a.diagonal + {license_scan.NEIGHBOURS}
  GROUP BY a.r, a.template, a.label, a.votes, a.pattern, a.diagonal HAVING 2 * count(DISTINCT h.place) >= a.votes),
places AS (SELECT *, unnest(range(lo, hi + 1)) AS p FROM spans),
letters AS (SELECT s.r, s.template, s.label, s.pattern, s.diagonal, s.p, max(substr(s.pattern, CAST(h.place + 1 + s.p - h.pos AS BIGINT), 1)) AS c
  FROM places s LEFT JOIN hits h ON h.r = s.r AND h.template = s.template AND h.diagonal BETWEEN s.diagonal AND s.diagonal + {license_scan.NEIGHBOURS} AND s.p BETWEEN h.pos AND h.pos + 2
  GROUP BY ALL),
read AS (SELECT r, label, pattern, min(p) AS lo, max(p) AS hi, string_agg(coalesce(c, '{license_scan.UNCONFIRMED}'), '' ORDER BY p) AS span FROM letters GROUP BY r, template, label, pattern, diagonal),
near AS (SELECT r, label, lo, hi, 1 - levenshtein(pattern, span) / length(pattern) AS kept FROM read),
notices AS (SELECT r, label, kept FROM near a WHERE NOT EXISTS (SELECT 1 FROM near b WHERE b.r = a.r AND b.lo <= a.hi AND b.hi >= a.lo AND b.kept >= 0.75 AND b.kept > a.kept)),
every AS (SELECT r, label, 1.0 AS kept FROM base UNION ALL SELECT r, label, kept FROM notices WHERE kept >= 0.75),
based AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(kept) AS score FROM every GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(CAST(coalesce(score, 0) AS DOUBLE), 6) AS score FROM docs LEFT JOIN based USING (r) LEFT JOIN labelled USING (r)"""

OP5_SQL = r"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
late AS (SELECT doc_id, i FROM windows JOIN first USING (h) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM late),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM docs WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

# crc32 by a table of the 256 bytes; prefixes as digests of the chained turns.
OP12_SQL = r"""WITH tb AS (SELECT list(list_reduce([i]::BIGINT[] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
said AS (SELECT conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS turn, length(coalesce(text, '')) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM said), tb),
built AS (SELECT i.conv_id, turn, chars, k FROM ids i JOIN said s ON s.conv_id = i.conv_id - i.conv_id % 100 WHERE k <= h
  UNION ALL SELECT i.conv_id, turn, chars, k FROM ids i JOIN said s ON s.conv_id = i.conv_id WHERE k > h),
ranked AS (SELECT conv_id, turn, chars, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth FROM built),
paths AS (SELECT conv_id, chars, depth, sha256(string_agg(turn, '/') OVER w) AS node FROM ranked WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY node, depth),
links AS (SELECT DISTINCT p.node AS parent, c.node FROM paths p JOIN paths c ON c.conv_id = p.conv_id AND c.depth = p.depth + 1),
below AS (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
sums AS (SELECT top AS node, sum((n_convs - 1) * chars) AS saved_tokens, count(*) FILTER (WHERE b.node NOT IN (SELECT parent FROM links)) AS n_leaves FROM below b JOIN nodes n ON n.node = b.node GROUP BY top),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths WHERE (conv_id, depth) IN (SELECT (conv_id, max(depth)) FROM paths GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM links k WHERE k.parent = n.node) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN ends USING (node) LEFT JOIN links l ON l.node = n.node LEFT JOIN nodes u ON u.node = l.parent"""

OP13_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT *, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS least FROM p),
r AS (SELECT *, payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least AS again FROM g)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM r"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_warc": OP13_SQL,
}
