"""Access-log lines rendered from the ``events`` table, as input to the parser.

``ACCESS_SQL`` states the same rows in SQL without any parsing, for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accessloom.sources.formats import LogFormat, compile_format

COMBINED_PLUS = (
    "$remote_addr - $remote_user [$time_local] \"$request\" $status $body_bytes_sent "
    "\"$http_referer\" \"$http_user_agent\" $request_length $bytes_sent"
)
ISO_TIMED = (
    "$time_iso8601|$msec|$remote_addr|$host|$request_method|$request_uri|$server_protocol|"
    "$status|$request_time|$upstream_response_time|$request_length|$bytes_sent|$http_user_agent"
)
COMBINEDIO = "%h %l %u %t \"%r\" %>s %b \"%{Referer}i\" \"%{User-Agent}i\" %I %O"

USER_AGENTS = (
    "Mozilla/5.0 (X11; Linux x86_64; rv:80.0) Gecko/20100101 Firefox/80.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 13_6) AppleWebKit/605.1.15 (KHTML, like Gecko) Mobile/15E148",
    "Sogou web spider/4.0",
    "Mozilla/5.0 (compatible; Baiduspider/2.0)",
    "360Spider",
    "curl/7.68.0",
)


def format_named(name: str) -> LogFormat:
    server, text = {
        "combined_plus": ("nginx", COMBINED_PLUS),
        "iso_timed": ("nginx", ISO_TIMED),
        "combinedio": ("apache", COMBINEDIO),
    }[name]
    return compile_format(server, name, text)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _by_kind(default, **values) -> Column:
    out = F.lit(default)
    for kind, value in values.items():
        out = F.when(F.col("event_type") == kind, value).otherwise(out)
    return out


def _parts() -> dict[str, Column]:
    key = F.regexp_extract("props", "[0-9]+", 0)
    number = F.pmod(F.lit(167772160) + F.col("user_id") * 7, F.lit(1 << 32))
    agent = F.lit(USER_AGENTS[-1])
    for i, ua in enumerate(USER_AGENTS[:-1]):
        agent = F.when(F.col("event_id") % 6 == i, ua).otherwise(agent)
    size = F.floor(F.col("value") * 100)
    return {
        "ip": F.concat_ws(
            ".", *[F.pmod(F.shiftright(number, n), F.lit(256)).cast("string") for n in (24, 16, 8, 0)]
        ),
        "method": _by_kind("GET", purchase="POST"),
        "target": F.concat(F.lit("/item/"), key, F.lit("?e="), F.col("event_type")),
        "status": _by_kind("200", error="500", signup="302", purchase="201"),
        "ua": agent,
        "body": size.cast("string"),
        "received": (100 + F.col("event_id") % 900).cast("string"),
        "sent": (size + 200).cast("string"),
    }


def _local(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))


def _request(p: dict[str, Column]) -> Column:
    return F.concat_ws(" ", p["method"], p["target"], F.lit("HTTP/1.1"))


def combined_plus_line() -> Column:
    p = _parts()
    return F.concat(
        p["ip"], F.lit(" - - ["), _local(F.col("ts")), F.lit('] "'), _request(p), F.lit('" '),
        p["status"], F.lit(" "), p["body"], F.lit(' "-" "'), p["ua"], F.lit('" '),
        p["received"], F.lit(" "), p["sent"],
    )


def iso_timed_line() -> Column:
    p = _parts()
    return F.concat_ws(
        "|",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")),
        F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(".250")),
        p["ip"], F.lit("shop.example.com"), p["method"], p["target"], F.lit("HTTP/1.1"),
        p["status"], F.concat(F.lit("0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")),
        F.lit("0.215, 0.838"), p["received"], p["sent"], p["ua"],
    )


def combinedio_line() -> Column:
    p = _parts()
    return F.concat(
        p["ip"], F.lit(" - - ["), _local(F.col("ts")), F.lit('] "'), _request(p), F.lit('" '),
        p["status"], F.lit(" "), F.when(p["status"] == "302", "-").otherwise(p["body"]),
        F.lit(' "-" "'), p["ua"], F.lit('" '), p["received"], F.lit(" "), p["sent"],
    )


LINES = {
    "combined_plus": combined_plus_line,
    "iso_timed": iso_timed_line,
    "combinedio": combinedio_line,
}


def rendered(events: DataFrame, name: str = "combined_plus") -> DataFrame:
    return events.select(LINES[name]().alias("value"))


def nation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 of every 40 addresses from 10.0.0.0 on belong to a nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lo = F.lit(167772160).cast("bigint") + F.col("n_nationkey") * 40
    return nation.select(
        lo.alias("lo"), (lo + 29).alias("hi"), F.col("n_nationkey").cast("int").alias("city_id"),
        F.concat(F.lit("Land|0|"), "n_name", F.lit("|City "), F.col("n_nationkey").cast("string"), F.lit("|Net"))
        .alias("region"),
    )


def customer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two addresses per customer, every other pair left out: many ranges in a block."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lo = F.lit(167772160).cast("bigint") + F.col("c_custkey") * 4
    return customer.select(
        lo.alias("lo"), (lo + 1).alias("hi"), F.col("c_nationkey").cast("int").alias("city_id"),
        F.concat(F.lit("Land|0|P"), F.col("c_nationkey").cast("string"), F.lit("|"), "c_mktsegment", F.lit("|Net"))
        .alias("region"),
    )


def nation_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey").cast("double")
    return nation.select(
        F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("name"),
        F.array(F.lit(100.0) + key, F.lit(20.0) + key / 2).alias("center"),
    )


# The rendered rows and their regions, without log lines in between.
ACCESS_SQL = """
numbered AS (SELECT *, (167772160 + user_id*7) % 4294967296 AS ip_num FROM events),
access_rows AS (
  SELECT event_id,
         (ip_num >> 24) || '.' || ((ip_num >> 16) % 256) || '.' || ((ip_num >> 8) % 256)
           || '.' || (ip_num % 256) AS ip,
         ip_num,
         date_trunc('second', ts) AS t,
         CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS "timestamp",
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_str,
         CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS request_method,
         '/item/' || regexp_extract(props, '[0-9]+') AS request_url,
         'e=' || event_type AS args,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 302
              WHEN 'purchase' THEN 201 ELSE 200 END AS status_code,
         CAST(floor(value*100) AS BIGINT) AS body_bytes_sent,
         100 + event_id % 900 AS request_length,
         CAST(floor(value*100) AS BIGINT) + 200 AS bytes_sent,
         CASE event_id % 6
""" + "".join(f"              WHEN {i} THEN '{ua}'\n" for i, ua in enumerate(USER_AGENTS[:-1])) + f"""
              ELSE '{USER_AGENTS[-1]}' END AS ua
  FROM numbered
),
ranges AS (
  SELECT 167772160 + n_nationkey*40 AS lo, 167772160 + n_nationkey*40 + 29 AS hi,
         n_nationkey AS city_id, n_name AS province
  FROM nation
),
access AS (
  SELECT a.*,
         CASE WHEN r.lo IS NULL THEN '0' ELSE 'Net' END AS isp,
         coalesce('City ' || r.city_id, '0') AS city,
         coalesce(r.city_id, 0) AS city_id,
         coalesce(r.province, '0') AS province,
         CASE WHEN r.lo IS NULL THEN '0' ELSE 'Land' END AS country
  FROM access_rows a LEFT JOIN ranges r ON a.ip_num BETWEEN r.lo AND r.hi
)
"""
