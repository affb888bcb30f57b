"""Reading exchanges, and the planted exchanges that stand in for captured traffic in the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from .. import schema


def stored(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Stored exchanges and `raw`, the record as it was stored where it is damaged, else null.

    Kinds are parquet, and json: one object a line, bodies in Base64.  A record is damaged
    if it doesn't parse, whole or in a field, or has no exchange_id.
    """
    columns = [f.name for f in types.StructType.fromDDL(schema.EXCHANGES)]
    if kind == "json":
        lines = spark.read.text(path).where(F.trim("value") != "")
        how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        rows = lines.select("value", F.from_json("value", f"{schema.EXCHANGES}, _bad STRING", how).alias("r"))
        bad = F.col("r._bad").isNotNull() | F.col("r.exchange_id").isNull()
        return rows.select("r.*", F.when(bad, F.col("value")).alias("raw")).select(*columns, "raw")
    rows = spark.read.schema(schema.EXCHANGES).format(kind).load(path)
    return rows.withColumn("raw", F.when(F.col("exchange_id").isNull(), F.to_json(F.struct(*columns))))


def read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Stored exchanges as one row each, but for damaged ones; a missing response has null headers and body."""
    return stored(spark, path, kind).where("raw IS NULL").drop("raw")


def damaged(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(raw): the records that read() leaves out."""
    return stored(spark, path, kind).where("raw IS NOT NULL").select("raw")


def write(exchanges: DataFrame, path: str, kind: str = "parquet") -> None:
    """Exchanges as read() takes them."""
    exchanges.write.mode("append").format(kind).save(path)


def read_stream(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Exchanges as they arrive in a folder."""
    return spark.readStream.schema(schema.EXCHANGES).format(kind).load(path)


#: What differs between the two SQL dialects that the planted exchanges are written in.
SPARK = {
    "sha256": "sha2({}, 256)",
    "sha1": "sha1({})",
    "b64": "translate(base64(cast({} AS binary)), '\\r\\n', '')",
    "array": "array({})",
    "ts": "timestamp_seconds(1704067200 + 60 * page_id)",
    "binary": "cast({} AS binary)",
}
DUCK = {
    "sha256": "sha256({})",
    "sha1": "sha1({})",
    "b64": "to_base64(encode({}))",
    "array": "[{}]",
    "ts": "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(60 * page_id)",
    "binary": "{}",
}


def planted_sql(dialect: dict) -> str:
    """One exchange for each page, by page_id % 12 with something planted; bodies are text."""
    f = {k: v.format for k, v in dialect.items() if k not in ("ts",)}
    pid = "cast(page_id AS string)"
    seed = f"concat('k', {pid})"
    md5, sha1, sha256 = f"md5({seed})", f["sha1"](seed), f["sha256"](seed)
    token = f["b64"](f"concat('user=', {pid}, '&role=guest&note=hello')")
    safe = f"translate({token}, '+/=', '-_')"
    case = "page_id % 12"

    def pick(cases: dict, other: str) -> str:
        return f"CASE {case} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"

    url = pick(
        {
            1: f"concat('https://shop.example.com/item/', {pid}, '?sig=', {md5}, '&page=2&key=k', {pid})",
            6: f"concat('https://cdn.example.com/static/', {md5}, '.', CASE WHEN page_id % 24 = 6 THEN 'js' ELSE 'woff2' END)",
            9: "'https://example.net:8443/go/%2541dmin%252Fpanel/a;b=1?next=%252Fhome%253Fx%253D1&flag&q=a+b'",
            10: f"concat('https://example.org/t/', {safe}, '/view')",
        },
        "url",
    )
    kind = pick(
        {
            5: "'application/json; charset=utf-8'",
            7: "CASE WHEN page_id % 24 = 7 THEN 'image/png' ELSE 'application/vnd.api+json' END",
        },
        "'text/html; charset=utf-8'",
    )
    request = pick(
        {
            4: f"concat('user=u', {pid}, '&pw=', {sha1}, '&user=dup&empty=')",
            5: f"""concat('{{"md5":"', {md5}, '","list":["', {md5}, '",{{"sha1":"', {sha1}, '"}}],"n":1}}')""",
            10: f"concat('token=', {token})",
        },
        "NULL",
    )
    response = pick(
        {
            2: f"concat('<p>sha256=', {sha256}, ' end</p>')",
            3: f"concat('x $2y$10$', substring(concat({md5}, {md5}), 1, 53), ' y $6$', {md5}, ' z $1$', {md5}, ' $2a$10$', {md5}, ' $2b$12$', {md5},"
            f" ' $5$', {md5}, ' $apr1$', {md5}, ' $pbkdf2-sha1$', {sha1}, ' $pbkdf2-sha256$', {sha256}, ' $argon2id$v=19$m=65536,t=3,p=4$', {md5},"
            f" ' $argon2i$v=19$', {md5}, ' $argon2d$v=19$', {md5}, ' .')",
            7: f"concat('etag ', {sha1})",
            8: f"concat('crc deadbeef run ', repeat('a', 40), ' odd ', substring({md5}, 1, 31), ' low ', repeat('0123', 12),"
            f" ' long ', repeat({sha256}, 5), ' text 48656c6c6f20776f726c64206f6620706c61696e20656e676c69736820746578742e')",
            11: f"concat('digest ', substring({sha256}, 1, 48), ' ', repeat('x ', 60), substring({sha256}, 9, 48), ' ', repeat('y ', 60))",
        },
        "html",
    )
    headers = [
        "'Host: example.com'", f"concat('Cookie: sid=', {md5}, '; theme=dark')", "'User-Agent: probe/1.0'",
        "'Accept-Language: en'", f"concat('X-Token: ', CASE WHEN {case} = 10 THEN {token} ELSE 'none' END)",
        f"concat('Content-Type: ', CASE {case} WHEN 5 THEN 'application/json' ELSE 'application/x-www-form-urlencoded' END)",
    ]
    resp_headers = [f"concat('Content-Type: ', {kind})", "'Server: test'"]
    none = f"CASE WHEN {case} = 0 AND page_id % 24 = 12 THEN NULL ELSE "
    return f"""SELECT page_id AS exchange_id, {dialect['ts']} AS ts,
  CASE WHEN page_id % 2 = 0 THEN 'proxy' ELSE 'crawler' END AS tool,
  CASE WHEN {case} IN (4, 5, 10) THEN 'POST' ELSE 'GET' END AS method, {url} AS url,
  {f['array'](', '.join(headers))} AS req_headers, {f['binary'](request)} AS req_body,
  {none}{f['array'](', '.join(resp_headers))} END AS resp_headers, {none}{f['binary'](response)} END AS resp_body
FROM pages"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    text = planted_sql(SPARK).replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    return spark.sql(text, pages=pages)
