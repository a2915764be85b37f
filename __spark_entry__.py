"""Every query of the engine over the given tables, with the SQL that checks it.

Access logs do not come with the tables: lines are rendered from ``events`` by Spark,
parsed, located through ranges made from ``nation`` and then queried.  The SQL computes
the same answers from ``events`` directly, without lines or parsing.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessloom.functions import measures, network, text, times
from accessloom.operators.distinct import distinct_and_all
from accessloom.operators.geo import RangeTable, geo_join, prepare_ranges, read_ranges
from accessloom.operators.parse import (
    column_widths, good_rows, parse_lines, rejected_rows, with_time,
)
from accessloom.operators.untagged import parse_untagged
from accessloom.operators.word_index import WordIndex, keep_index
from accessloom.plans import rollup, traffic
from accessloom.sources import formats as fm
from accessloom.sources import lines as ln
from accessloom.sources import published
from accessloom.sources.tables import (
    PERIOD, read_access, read_rejected, with_period, write_access,
)
from accessloom.sources.variables import ServerType, Variable, register_server_type
from accessloom.sources.workspace import fresh_path
from accessloom.streaming import ingest, live
from fixtures import rendered as fx

DAY = "2024-01-15"
FIRST = "2024-01-01"          # open-ended from here: the whole table
HOUR = "2024-01-15 12:00:00"
IP = "10.0.0.56"              # user 8
Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _access_sql(body: str) -> str:
    return f"WITH {fx.ACCESS_SQL} {body}"


def _on_access(name: str, fn: Callable[[DataFrame], DataFrame], sql: str, located: bool = False) -> None:
    """A question about the access rows; only some need to know where they come from."""
    _query(name, _access_sql(sql))(lambda spark, sf: fn(access_rows(spark, sf, located)))


# ---------------------------------------------------------------- shared inputs

_RANGES: dict[tuple[str, str], RangeTable] = {}


def _ranges(spark: SparkSession, sf_dir: str) -> RangeTable:
    """Cut, measured and cached once per session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _RANGES:
        _RANGES[key] = prepare_ranges(fx.nation_ranges(spark, sf_dir)).persist()
    return _RANGES[key]


def parsed_rows(
    spark: SparkSession, sf_dir: str, name: str = "combined_plus", located: bool = True
) -> DataFrame:
    lines = fx.rendered(fx.events(spark, sf_dir), name)
    ranges = _ranges(spark, sf_dir) if located else None
    return parse_lines(lines, fx.format_named(name), ranges=ranges)


def access_rows(spark: SparkSession, sf_dir: str, located: bool = True) -> DataFrame:
    return good_rows(parsed_rows(spark, sf_dir, located=located))


def _tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three formats and two applications in one set of lines."""
    names = {0: "combined_plus", 1: "iso_timed"}
    kind = F.col("event_id") % 2
    line, name = fx.LINES["combined_plus"](), F.lit(names[0])
    line = F.when(kind == 1, fx.LINES["iso_timed"]()).otherwise(line)
    name = F.when(kind == 1, names[1]).otherwise(name)
    return fx.events(spark, sf_dir).select(
        F.lit("node-1").alias("node_id"),
        F.when(F.col("event_type") == "purchase", "shop").otherwise("www").alias("app_name"),
        name.alias("log_format_name"),
        line.alias("value"),
    )


_MIXED = ("combined_plus", "iso_timed")


# ---------------------------------------------------------------- parsing

@_query("parse_nginx_rows", _access_sql("""
  SELECT ip, '-' AS remote_user, time_str, "timestamp", request_method, request_url, args,
         'HTTP/1.1' AS server_protocol, status_code, body_bytes_sent, '-' AS http_referer, ua,
         request_length, bytes_sent, isp, city, city_id, province, country
  FROM access"""))
def _(spark, sf):
    return access_rows(spark, sf).drop("event_time")


@_query("parse_iso_time_rows", _access_sql("""
  SELECT ip, time_str, "timestamp", CAST("timestamp" + 0.25 AS DOUBLE) AS msec,
         'shop.example.com' AS host, request_method,
         request_url || '?' || args AS request_url, 'HTTP/1.1' AS server_protocol, status_code,
         CAST((event_id % 1000) / 1000.0 AS DOUBLE) AS request_time,
         '0.215, 0.838' AS upstream_response_time, request_length, bytes_sent, ua, province
  FROM access"""))
def _(spark, sf):
    rows = good_rows(parsed_rows(spark, sf, "iso_timed"))
    rows = rows.withColumn("msec", F.col("msec").cast("double"))
    return rows.drop("event_time", "isp", "city", "city_id", "country")


@_query("parse_apache_rows", _access_sql("""
  SELECT ip, '-' AS remote_logname, '-' AS remote_user, time_str, "timestamp", request_method,
         request_url, args, 'HTTP/1.1' AS server_protocol, status_code,
         CASE WHEN status_code = 302 THEN 0 ELSE body_bytes_sent END AS bytes_sent,
         '-' AS referer, ua, request_length AS bytes_received,
         bytes_sent AS bytes_sent_with_header, isp, city, city_id, province, country
  FROM access"""))
def _(spark, sf):
    return good_rows(parsed_rows(spark, sf, "combinedio")).drop("event_time")


@_query("parse_mixed_formats", _access_sql("""
  SELECT 'node-1' AS node_id, CASE WHEN request_method = 'POST' THEN 'shop' ELSE 'www' END AS app_name,
         CASE WHEN event_id % 2 = 0 THEN 'combined_plus' ELSE 'iso_timed' END AS log_format_name,
         ip, "timestamp", time_str,
         CASE WHEN event_id % 2 = 0 THEN request_url ELSE request_url || '?' || args END AS request_url,
         CASE WHEN event_id % 2 = 0 THEN args END AS args,
         CASE WHEN event_id % 2 = 1 THEN 'shop.example.com' END AS host,
         CASE WHEN event_id % 2 = 0 THEN body_bytes_sent END AS body_bytes_sent,
         status_code, bytes_sent, ua, province
  FROM access"""))
def _(spark, sf):
    parsed = ingest.parse_stream(
        _tagged_lines(spark, sf), [fx.format_named(n) for n in _MIXED], ranges=_ranges(spark, sf)
    )
    return good_rows(parsed).select(
        "node_id", "app_name", "log_format_name", "ip", "timestamp", "time_str", "request_url",
        "args", "host", "body_bytes_sent", "status_code", "bytes_sent", "ua", "province",
    )


@_query("parse_untagged_lines", _access_sql("""
  SELECT CASE WHEN event_id % 2 = 0 THEN 'combined_plus' ELSE 'iso_timed' END AS log_format_name,
         ip, "timestamp", time_str, CASE WHEN event_id % 2 = 0 THEN args END AS args, status_code,
         bytes_sent, ua, province,
         CASE WHEN event_id % 2 = 0 THEN request_url ELSE request_url || '?' || args END AS request_url
  FROM access"""))
def _(spark, sf):
    others = [fm.compile_format("nginx", f"f{i}", f'$remote_addr [$time_local] "$request" $status at{i} "$http_user_agent"')
              for i in range(300)]
    lines = _tagged_lines(spark, sf).select("value")
    rows = good_rows(parse_untagged(lines, [fx.format_named(n) for n in _MIXED] + others, ranges=_ranges(spark, sf)))
    return rows.select("log_format_name", "ip", "timestamp", "time_str", "args", "status_code", "bytes_sent", "ua",
                       "province", "request_url")


@_query("envelope_round_trip", _access_sql("""
  SELECT CASE WHEN request_method = 'POST' THEN 'shop' ELSE 'www' END AS app_name,
         CASE WHEN event_id % 2 = 0 THEN 'combined_plus' ELSE 'iso_timed' END AS log_format_name,
         count(*) AS n, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
         min(time_str) AS first_time, max(time_str) AS last_time
  FROM access GROUP BY ALL"""))
def _(spark, sf):
    named = [fx.format_named(n) for n in _MIXED]
    queue = ln.to_envelopes(_tagged_lines(spark, sf), named)
    # Bytes, as a queue would deliver them; formats are taken from the envelopes.
    queue = queue.select(F.col("value").cast("binary").alias("value"))
    found = ln.formats_in(ln.from_envelopes(queue), "nginx")
    rows = good_rows(ingest.parse_envelopes(queue, found))
    return rows.groupBy("app_name", "log_format_name").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes_sent"),
        F.min("time_str").alias("first_time"), F.max("time_str").alias("last_time"),
    )


@_query("envelope_rejects", """
    SELECT 'bad envelope' AS reason, count(*) AS n,
           CAST(sum(length(trim(text, E' \\t\\n\\r'))) AS BIGINT) AS chars FROM documents""")
def _(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("value"))
    parsed = ingest.parse_envelopes(documents, [fx.format_named("combined_plus")])
    return rejected_rows(parsed).groupBy("reason").agg(
        F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")
    )


@_query("parse_rejects", """
  WITH bad_lines AS (
    SELECT trim(text, E' \\t\\n\\r') AS line FROM documents
    UNION ALL
    SELECT '10.0.0.1 - - [' || event_id || '/Foo/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "x" 1 1'
    FROM events)
  SELECT CASE WHEN line LIKE '10.0.0.1 - - [%/Foo/2024%' THEN 'unreadable time'
              ELSE 'format mismatch' END AS reason,
         count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars
  FROM bad_lines GROUP BY ALL""")
def _(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("value"))
    broken = fx.events(spark, sf).select(
        F.concat(
            F.lit("10.0.0.1 - - ["), F.col("event_id").cast("string"),
            F.lit('/Foo/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "x" 1 1'),
        ).alias("value")
    )
    lines = documents.unionByName(broken).unionByName(fx.rendered(fx.events(spark, sf)))
    rejected = rejected_rows(parse_lines(lines, fx.format_named("combined_plus")))
    return rejected.groupBy("reason").agg(
        F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")
    )


@_query("column_widths", _access_sql("""
  SELECT max(length(ip)) AS ip, 1 AS remote_user, max(length(time_str)) AS time_str,
         max(length(request_method)) AS request_method, max(length(request_url)) AS request_url,
         max(length(args)) AS args, 8 AS server_protocol, 1 AS http_referer,
         max(length(ua)) AS ua, max(length(isp)) AS isp, max(length(city)) AS city,
         max(length(province)) AS province, max(length(country)) AS country
  FROM access"""))
def _(spark, sf):
    return column_widths(access_rows(spark, sf))


# ---------------------------------------------------------------- scalar functions

@_query("request_parts", """
  WITH requests AS (
    SELECT page_id, unnest([url, 'GET ' || url, 'GET ' || url || ' HTTP/1.1',
                            'GET ' || url || '?a?b HTTP/1.1 x', '  ']) AS request FROM pages),
  words AS (SELECT *, string_split(request, ' ') AS w FROM requests)
  SELECT page_id, request,
         CASE WHEN trim(request) <> '' AND len(w) >= 3 THEN w[1] ELSE '' END AS request_method,
         CASE WHEN trim(request) = '' THEN '' WHEN len(w) >= 3 THEN split_part(w[2], '?', 1)
              ELSE request END AS request_url,
         CASE WHEN trim(request) <> '' AND len(w) >= 3 THEN split_part(w[2], '?', 2) ELSE '' END AS args,
         CASE WHEN trim(request) <> '' AND len(w) >= 3 THEN w[3] ELSE '' END AS server_protocol
  FROM words""")
def _(spark, sf):
    url = F.col("url")
    requests = spark.read.parquet(f"{sf}/pages.parquet").select(
        "page_id",
        F.explode(F.array(
            url, F.concat(F.lit("GET "), url), F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1")),
            F.concat(F.lit("GET "), url, F.lit("?a?b HTTP/1.1 x")), F.lit("  "),
        )).alias("request"),
    )
    parts = text.request_parts(F.col("request"))
    return requests.select("page_id", "request", *[c.alias(n) for n, c in parts.items()])


@_query("time_parts", """
  SELECT event_id, layout, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_str,
         CAST(epoch(date_trunc('second', ts)) AS BIGINT)
           - CASE layout WHEN 'east' THEN 28800 WHEN 'west' THEN -25200 ELSE 0 END AS instant,
         CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS "timestamp"
  FROM events, (SELECT unnest(['local', 'iso', 'east', 'west']) AS layout)""")
def _(spark, sf):
    ts = F.col("ts")
    local = F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    cases = [
        ("local", F.concat(F.lit("["), local, F.lit(" +0000]")), "time_local"),
        ("iso", F.concat(iso, F.lit("+00:00")), "time_iso8601"),
        ("east", F.concat(iso, F.lit("+08:00")), "time_iso8601"),
        ("west", F.concat(local, F.lit(" -0700")), "time_local"),
    ]
    rows = fx.events(spark, sf).select(
        "event_id",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("layout"), raw.alias("raw"), F.lit(kind).alias("kind"))
            for n, raw, kind in cases
        ])).alias("c"),
    ).select("event_id", "c.*")

    for kind in ("time_local", "time_iso8601"):
        rows = with_time(rows, "raw", kind, prefix=f"{kind}_")
        rows = with_time(rows, "raw", kind, honor_offset=True, prefix=f"{kind}_zoned_")

    def by_kind(column):
        local, iso = (F.col(f"{k}_{column}") for k in ("time_local", "time_iso8601"))
        return F.when(F.col("kind") == "time_local", local).otherwise(iso)

    return rows.select(
        "event_id", "layout", by_kind("time_str").alias("time_str"),
        by_kind("zoned_timestamp").alias("instant"), by_kind("timestamp").alias("timestamp"),
    )


@_query("ip_to_long", """
  SELECT event_id, shape,
         CASE shape WHEN 'quad' THEN CAST((event_id % 256)*16777216 + user_id*65536 % 16777216
                                          + (event_id % 256)*256 + 7 AS BIGINT) END AS number
  FROM events, (SELECT unnest(['quad', 'short', 'large', 'v6', 'dash']) AS shape)""")
def _(spark, sf):
    a, b = (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string")
    cases = {
        "quad": F.concat_ws(".", a, b, a, F.lit("7")), "short": F.concat_ws(".", a, b, a),
        "large": F.concat(a, F.lit(".1.2.256")), "v6": F.concat(F.lit("::"), a), "dash": F.lit("-"),
    }
    rows = fx.events(spark, sf).select(
        "event_id",
        F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), c.alias("ip")) for k, c in cases.items()])).alias("c"),
    ).select("event_id", "c.*")
    return rows.select("event_id", "shape", network.ip_to_long(F.col("ip")).alias("number"))


@_query("stored_values", """
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE o_orderpriority END AS words,
         CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN o_custkey END AS number,
         CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN o_custkey / 4.0 END AS fraction
  FROM orders""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 3
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    words = F.when(kind == 0, "").otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))

    def number(shown):
        return F.when(kind == 0, "").when(kind == 1, shown.cast("string")).otherwise("n/a")

    return orders.select(
        "o_orderkey", text.stored_text(words).alias("words"),
        text.stored_number(number(F.col("o_custkey")), "bigint").alias("number"),
        text.stored_number(number(F.col("o_custkey") / 4), "double").alias("fraction"),
    )


@_query("period_names", """
  SELECT strftime(ts, '%Y_%m_%d') AS day,
         strftime(date_trunc('week', ts), '%Y_%m_%d') || '_'
           || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%d') AS week,
         strftime(ts, '%Y_%m') AS month, strftime(ts, '%Y') AS year, count(*) AS n
  FROM events GROUP BY ALL""")
def _(spark, sf):
    names = [times.period_of(F.col("ts"), p).alias(p) for p in times.PERIODS]
    return fx.events(spark, sf).groupBy(*names).agg(F.count("*").alias("n"))


_WORDS_SQL = "string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+')"


@_query("fulltext_documents", f"""
  WITH words AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS w FROM documents)
  SELECT doc_id, list_contains(w, 'the') OR list_contains(w, 'und') AS either,
         list_contains(w, 'the') AND NOT list_contains(w, 'and') AS one_not_other,
         list_contains(w, 'and') AS required_wins
  FROM words""")
def _(spark, sf):
    body = F.col("text")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", text.fulltext(body, "the und").alias("either"),
        text.fulltext(body, "+the -and", "boolean").alias("one_not_other"),
        text.fulltext(body, "+and the", "boolean").alias("required_wins"),
    )


@_query("digits_and_prefixes", """
  SELECT c_custkey, regexp_replace(c_name || ' x', '[^0-9]', '', 'g') AS digits,
         c_name[1:2] AS prefix
  FROM customer""")
def _(spark, sf):
    name = F.col("c_name")
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", text.digits_only(F.concat(name, F.lit(" x"))).alias("digits"),
        text.first_chars(name).alias("prefix"),
    )


# ---------------------------------------------------------------- IP ranges

_CUSTOMER_GEO_SQL = """
  WITH hits AS (
    SELECT event_id, (167772160 + user_id*7) % 4294967296 AS ip_num FROM events),
  ranges AS (
    SELECT 167772160 + c_custkey*4 AS lo, 167772160 + c_custkey*4 + 1 AS hi, c_nationkey, c_mktsegment
    FROM customer)
  SELECT event_id, coalesce(c_nationkey, 0) AS city_id, coalesce('P' || c_nationkey, '0') AS province,
         coalesce(c_mktsegment, '0') AS city, CASE WHEN lo IS NULL THEN '0' ELSE 'Net' END AS isp,
         CASE WHEN lo IS NULL THEN '0' ELSE 'Land' END AS country
  FROM hits LEFT JOIN ranges ON ip_num BETWEEN lo AND hi"""


def _event_addresses(spark, sf):
    return fx.events(spark, sf).select("event_id", fx._parts()["ip"].alias("ip"))


@_query("geo_join_many_ranges", _CUSTOMER_GEO_SQL)
def _(spark, sf):
    return geo_join(_event_addresses(spark, sf), fx.customer_ranges(spark, sf)).drop("ip")


@_query("geo_join_shuffled", _CUSTOMER_GEO_SQL)
def _(spark, sf):
    ranges = fx.customer_ranges(spark, sf)
    return geo_join(_event_addresses(spark, sf), ranges, max_broadcast_bytes=0).drop("ip")


# ---------------------------------------------------------------- formats

@_query("discover_nginx_formats", """
  SELECT 'fmt_' || c_custkey AS name,
         '$remote_addr [$time_local] "$request" $status ' || c_nationkey || ' "$http_user_agent"' AS format_str,
         '$remote_addr<@>$time_local<@>$request<@>$status<@>$http_user_agent' AS vars
  FROM customer
  UNION ALL
  SELECT 'defualt', '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"',
         '$remote_addr<@>$remote_user<@>$time_local<@>$request<@>$status<@>$body_bytes_sent<@>$http_referer<@>$http_user_agent'""")
def _(spark, sf):
    confs = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.format_string(
            "http {\n  log_format fmt_%d '$remote_addr [$time_local] \"$request\" '\n"
            "    '$status %d \"$http_user_agent\"';\n  access_log logs/a.log fmt_%d;\n}\n",
            "c_custkey", "c_nationkey", "c_custkey",
        ).alias("content")
    )
    return fm.discover_nginx_formats(confs).select(
        "name", "format_str", F.concat_ws(fm.VARS_SEPARATOR, "vars").alias("vars")
    )


@_query("discover_apache_formats", """
  SELECT 'fmt_' || s_suppkey AS name, '%h %l %u %t "%r" %>s %b "%{User-Agent}i"' AS format_str,
         '%h<@>%l<@>%u<@>%t<@>%r<@>%>s<@>%b<@>%{User-Agent}i' AS vars
  FROM supplier
  UNION ALL SELECT 'short_' || s_suppkey, '%h %' || '>s', '%h<@>%>s' FROM supplier""")
def _(spark, sf):
    key = F.col("s_suppkey").cast("string")
    confs = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(
            F.lit('ServerName a\nLogFormat "%h %l %u %t \\"%r\\" %>s %b \\"%{User-Agent}i\\"" fmt_'), key,
            F.lit('\nLogFormat "%h %>s" short_'), key, F.lit("\n"),
        ).alias("content")
    )
    return fm.discover_apache_formats(confs).select(
        "name", "format_str", F.concat_ws(fm.VARS_SEPARATOR, "vars").alias("vars")
    )


# ---------------------------------------------------------------- traffic questions
# "Since the first day" covers the whole table; the others the day or hour asked about.

_IN_DAY = """"timestamp" >= 1705276800 AND "timestamp" < 1705363200"""
_IN_HOUR = """"timestamp" >= 1705320000 AND "timestamp" < 1705323600"""
_SINCE = """"timestamp" >= 1704067200"""


def _register_traffic() -> None:
    for suffix, where, options in (
        ("", _IN_DAY, {"as_of": DAY}),
        ("_since", _SINCE, {"as_of": FIRST, "open_ended": True}),
    ):
        def ask(question, **more):
            return functools.partial(question, **options_now, **more)

        options_now = options

        _on_access(f"total_ip{suffix}", ask(traffic.total_ip),
                   f"SELECT count(DISTINCT ip) AS total_num FROM access WHERE {where}")
        _on_access(f"total_pv{suffix}", ask(traffic.total_pv),
                   f"SELECT count(*) AS total_num FROM access WHERE {where}")
        _on_access(f"request_num_by_url{suffix}", ask(traffic.request_num_by_url), f"""
            SELECT count(*) AS total_num, request_url FROM access WHERE {where}
            GROUP BY request_url ORDER BY total_num DESC, request_url LIMIT 10""")
        _on_access(f"request_num_by_ip{suffix}", ask(traffic.request_num_by_ip), f"""
            SELECT count(*) AS total_num, ip FROM access WHERE {where}
            GROUP BY ip ORDER BY total_num DESC, ip LIMIT 50""")
        _on_access(f"request_urls_by_ip{suffix}", ask(traffic.request_urls_by_ip, ip=IP), f"""
            SELECT count(*) AS total_num, request_url FROM access WHERE {where} AND ip = '{IP}'
            GROUP BY request_url ORDER BY total_num DESC, request_url LIMIT 50""")
        _on_access(f"request_num_by_status{suffix}", ask(traffic.request_num_by_status, percent=True), f"""
            SELECT total_num, status_code,
                   (total_num*20000 + sum(total_num) OVER ()) // (2*sum(total_num) OVER ()) / 100.0 AS percent
            FROM (SELECT count(*) AS total_num, status_code FROM access
                  WHERE {where} AND status_code <> 200
                  GROUP BY status_code ORDER BY total_num DESC, status_code LIMIT 50)""")
        _on_access(f"request_num_by_status_code{suffix}",
                   ask(traffic.request_num_by_status_code, code="500"), f"""
            SELECT count(*) AS total_num, request_url FROM access WHERE {where} AND status_code = 500
            GROUP BY request_url ORDER BY total_num DESC, request_url LIMIT 30""")
        _on_access(f"request_num_by_province{suffix}", ask(traffic.request_num_by_province), f"""
            SELECT count(*) AS value, province FROM access WHERE {where} AND province <> '0'
            GROUP BY province""", located=True)
        _on_access(f"request_num_by_seconds{suffix}", ask(traffic.request_num_by_seconds, init=True), f"""
            SELECT "timestamp"*1000 AS "timestamp", count(*) AS total_request_num FROM access
            WHERE {where} GROUP BY access."timestamp" ORDER BY access."timestamp" DESC LIMIT 600""")


_register_traffic()

_on_access("total_pv_by_text",
           lambda a: a.filter(traffic.on_day_text(DAY)).agg(F.count("*").alias("total_num")),
           "SELECT count(*) AS total_num FROM access WHERE time_str LIKE '2024-01-15%'")
_on_access("distinct_by_grouping",
           lambda a: distinct_and_all(a, "ip", times.date_text(F.col("timestamp")).alias("day")),
           """SELECT strftime(t, '%Y-%m-%d') AS day, count(DISTINCT ip) AS ip_num, count(*) AS pv_num
              FROM access GROUP BY ALL""")
_on_access("request_num_by_province_unresolved",
           lambda a: traffic.request_num_by_province(a, FIRST, keep_unresolved=True, open_ended=True),
           f"SELECT count(*) AS value, province FROM access WHERE {_SINCE} GROUP BY province",
           located=True)
_on_access("request_num_by_seconds_latest",
           lambda a: traffic.request_num_by_seconds(a, DAY), f"""
    SELECT "timestamp"*1000 AS "timestamp", count(*) AS total_request_num FROM access
    WHERE {_IN_DAY} GROUP BY access."timestamp" ORDER BY access."timestamp" DESC LIMIT 5""")

_on_access("request_num_by_seconds_all",
           lambda a: traffic.request_num_by_seconds(a, DAY, limit=None), f"""
    SELECT "timestamp"*1000 AS "timestamp", count(*) AS total_request_num FROM access
    WHERE {_IN_DAY} GROUP BY access."timestamp" """)

_TRAFFIC_SQL = """
    SELECT round(sum(bytes_sent)/1024.0, 2) AS out_network,
           round(sum(request_length)/1024.0, 2) AS in_network,
           "timestamp" // 60 * 60 AS time_str
    FROM access WHERE {where} GROUP BY ALL ORDER BY time_str DESC {limit}"""
_VISITS_SQL = """
    SELECT count(DISTINCT ip) AS ip_num, count(*) AS pv_num, "timestamp" // 60 * 60 AS time_str
    FROM access WHERE {where} GROUP BY ALL ORDER BY time_str DESC {limit}"""

_on_access("network_traffic_by_minute",
           lambda a: traffic.network_traffic_by_minute(a, HOUR),
           _TRAFFIC_SQL.format(where=_IN_HOUR, limit="LIMIT 10"))
_on_access("network_traffic_by_minute_since",
           lambda a: traffic.network_traffic_by_minute(a, FIRST, span="day", open_ended=True, limit=None),
           _TRAFFIC_SQL.format(where=_SINCE, limit=""))
_on_access("network_traffic_unrounded",
           lambda a: traffic.network_traffic_by_minute(a, HOUR, rounded=False, limit=None),
           f"""SELECT sum(bytes_sent)/1024.0 AS out_network, sum(request_length)/1024.0 AS in_network,
                      "timestamp" // 60 * 60 AS time_str
               FROM access WHERE {_IN_HOUR} GROUP BY ALL""")
_on_access("ip_pv_num_by_minute",
           lambda a: traffic.ip_pv_num_by_minute(a, HOUR),
           _VISITS_SQL.format(where=_IN_HOUR, limit="LIMIT 10"))
_on_access("ip_pv_num_by_minute_since",
           lambda a: traffic.ip_pv_num_by_minute(a, FIRST, span="day", open_ended=True, limit=None),
           _VISITS_SQL.format(where=_SINCE, limit=""))
_on_access("ip_num_by_minute",
           lambda a: traffic.ip_num_by_minute(a, HOUR),
           f"SELECT ip_num, time_str FROM ({_VISITS_SQL.format(where=_IN_HOUR, limit='LIMIT 10')})")
_on_access("pv_num_by_minute",
           lambda a: traffic.pv_num_by_minute(a, HOUR),
           f"SELECT pv_num, time_str FROM ({_VISITS_SQL.format(where=_IN_HOUR, limit='LIMIT 10')})")
_on_access("traffic_chart",
           lambda a: traffic.traffic_chart(traffic.network_traffic_by_minute(a, HOUR)),
           f"""SELECT CAST(round(in_network, 0) AS BIGINT) AS in_network,
                      CAST(round(out_network, 0) AS BIGINT) AS out_network,
                      strftime(make_timestamp(time_str*1000000), '%H:%M') AS label
               FROM ({_TRAFFIC_SQL.format(where=_IN_HOUR, limit='LIMIT 10')})""")
_on_access("status_chart",
           lambda a: traffic.status_chart(traffic.request_num_by_status(a, FIRST, open_ended=True)),
           f"""SELECT '状态码：' || status_code AS label, total_num,
                      (total_num*20000 + sum(total_num) OVER ()) // (2*sum(total_num) OVER ()) / 100.0 AS percent
               FROM (SELECT count(*) AS total_num, status_code FROM access
                     WHERE {_SINCE} AND status_code <> 200 GROUP BY status_code)""")

_SPIDER_WORD = f"list_contains({_WORDS_SQL.format('ua')}, 'spider')"
_on_access("spider_by_ua", lambda a: traffic.spider_by_ua(a, percent=True), f"""
    SELECT total_num, ua,
           (total_num*20000 + sum(total_num) OVER ()) // (2*sum(total_num) OVER ()) / 100.0 AS percent
    FROM (SELECT count(*) AS total_num, ua FROM access WHERE {_SPIDER_WORD} GROUP BY ua)""")
_on_access("spider_by_ua_substring", lambda a: traffic.spider_by_ua(a, DAY, match="substring"), f"""
    SELECT count(*) AS total_num, ua FROM access
    WHERE {_IN_DAY} AND contains(ua, 'spider') GROUP BY ua""")
_on_access("device_type_by_ua", traffic.device_type_by_ua, f"""
    SELECT count(DISTINCT CASE WHEN list_contains(w, 'gecko') AND NOT list_contains(w, 'mobile') THEN ua END) AS pc_num,
           count(DISTINCT CASE WHEN list_contains(w, 'mobile') OR list_contains(w, 'xfb') THEN ua END) AS mobile_num
    FROM (SELECT ua, {_WORDS_SQL.format('ua')} AS w FROM access)""")

_PROVINCES_SQL = """
    provinces AS (SELECT count(*) AS value, province FROM access
                  WHERE {where} AND province <> '0' GROUP BY province),
    first_names AS (SELECT n_nationkey AS k, n_name FROM nation
                    QUALIFY row_number() OVER (PARTITION BY n_name[1:2] ORDER BY n_nationkey) = 1)"""


@_query("map_flows", f"WITH {fx.ACCESS_SQL}, {_PROVINCES_SQL.format(where=_SINCE)}" + """
    SELECT n_name AS "fromName", 'Harbour' AS "toName", 100.0 + k AS from_x, 20.0 + k/2 AS from_y,
           114.0 AS to_x, 22.5 AS to_y, value
    FROM provinces JOIN first_names ON province[1:2] = n_name[1:2]""")
def _(spark, sf):
    provinces = traffic.request_num_by_province(access_rows(spark, sf), FIRST, open_ended=True)
    flows = traffic.map_flows(
        provinces, fx.nation_geometry(spark, sf), to_name="Harbour", to_center=[114.0, 22.5]
    )
    at = F.col("coords")
    return flows.select(
        "fromName", "toName", at[0][0].alias("from_x"), at[0][1].alias("from_y"),
        at[1][0].alias("to_x"), at[1][1].alias("to_y"), "value",
    )


@_query("map_points", f"WITH {fx.ACCESS_SQL}, {_PROVINCES_SQL.format(where=_IN_DAY)}" + """
    SELECT n_name AS name, 100.0 + k AS x, 20.0 + k/2 AS y, CAST(value AS DOUBLE) AS size
    FROM provinces JOIN first_names ON province[1:2] = n_name[1:2]""")
def _(spark, sf):
    provinces = traffic.request_num_by_province(access_rows(spark, sf), DAY)
    points = traffic.map_points(provinces, fx.nation_geometry(spark, sf))
    at = F.col("value")
    return points.select("name", at[0].alias("x"), at[1].alias("y"), at[2].alias("size"))


# ---------------------------------------------------------------- stored tables

def _stored(spark: SparkSession, sf: str, split_save: str | None, **options) -> str:
    path = fresh_path(spark, "access")
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("value"))
    lines = fx.rendered(fx.events(spark, sf)).unionByName(documents)
    parsed = parse_lines(lines, fx.format_named("combined_plus"), ranges=_ranges(spark, sf))
    write_access(parsed, path, split_save=split_save, **options)
    return path


@_query("stored_day", _access_sql(f"""
    SELECT count(*) AS total_num, request_url FROM access WHERE {_IN_DAY}
    GROUP BY request_url ORDER BY total_num DESC, request_url LIMIT 10"""))
def _(spark, sf):
    path = _stored(spark, sf, "day")
    return traffic.request_num_by_url(read_access(spark, path, split_save="day", first=DAY), DAY)


@_query("stored_weeks", _access_sql("""
    SELECT strftime(date_trunc('week', t), '%Y_%m_%d') || '_'
             || strftime(date_trunc('week', t) + INTERVAL 6 DAY, '%d') AS period,
           count(*) AS n, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent
    FROM access GROUP BY ALL"""))
def _(spark, sf):
    path = _stored(spark, sf, "week", rebalance=True)
    return read_access(spark, path).groupBy(PERIOD).agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes_sent")
    )


@_query("stored_rejects", """
    SELECT 'format mismatch' AS reason, trim(text, E' \\t\\n\\r') AS line FROM documents""")
def _(spark, sf):
    return read_rejected(spark, _stored(spark, sf, "month"))


# ---------------------------------------------------------------- streams

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.events(spark, sf).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _line_stream(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rendered(_event_stream(spark, sf))


def _access_stream(spark: SparkSession, sf: str, located: bool) -> DataFrame:
    ranges = _ranges(spark, sf) if located else None
    parsed = parse_lines(_line_stream(spark, sf), fx.format_named("combined_plus"), ranges=ranges)
    return good_rows(parsed)


def _drained(result: DataFrame, mode: str) -> DataFrame:
    """Run a live query over everything there is and return what it emitted."""
    spark = result.sparkSession
    out = fresh_path(spark, "live")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        result.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", fresh_path(spark, "offsets"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    emitted = spark.read.schema(result.schema.add("batch", "integer")).parquet(out)
    if mode == "append":
        return emitted.drop("batch")
    # In complete and update mode a later batch replaces an earlier one.
    last = emitted.agg(F.max("batch")).scalar()
    return emitted.filter(F.col("batch") == last).drop("batch")


@_query("stream_ingest", _access_sql("""
    SELECT strftime(t, '%Y_%m_%d') AS period, count(*) AS n, count(DISTINCT ip) AS ips,
           CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent
    FROM access GROUP BY ALL"""))
def _(spark, sf):
    path, offsets = fresh_path(spark, "access"), fresh_path(spark, "offsets")
    parsed = parse_lines(
        _line_stream(spark, sf), fx.format_named("combined_plus"), ranges=_ranges(spark, sf)
    )
    ingest.start_ingest(parsed, path, offsets, every=None).awaitTermination()
    return read_access(spark, path).groupBy(PERIOD).agg(
        F.count("*").alias("n"), F.count_distinct("ip").alias("ips"),
        F.sum("bytes_sent").alias("bytes_sent"),
    )


def _on_stream(
    name: str, fn: Callable[[DataFrame], DataFrame], mode: str, sql: str, located: bool = False
) -> None:
    _query(name, _access_sql(sql))(
        lambda spark, sf: _drained(fn(_access_stream(spark, sf, located)), mode)
    )


_on_stream("live_request_num_by_url", live.live_request_num_by_url, "complete", """
    SELECT count(*) AS total_num, request_url FROM access
    GROUP BY request_url ORDER BY total_num DESC, request_url LIMIT 10""")
_on_stream("live_request_num_by_ip", live.live_request_num_by_ip, "complete", """
    SELECT count(*) AS total_num, ip FROM access
    GROUP BY ip ORDER BY total_num DESC, ip LIMIT 50""")
_on_stream("live_request_num_by_status", live.live_request_num_by_status, "complete", """
    SELECT count(*) AS total_num, status_code FROM access WHERE status_code <> 200
    GROUP BY status_code ORDER BY total_num DESC, status_code LIMIT 50""")
_on_stream("live_request_num_by_province", live.live_request_num_by_province, "complete", """
    SELECT count(*) AS value, province FROM access WHERE province <> '0' GROUP BY province""", located=True)
_on_stream("live_spider_by_ua", live.live_spider_by_ua, "complete", f"""
    SELECT count(*) AS total_num, ua FROM access WHERE {_SPIDER_WORD} GROUP BY ua""")
_on_stream("live_traffic_by_minute", live.live_traffic_by_minute, "complete", """
    SELECT round(sum(bytes_sent)/1024.0, 2) AS out_network,
           round(sum(request_length)/1024.0, 2) AS in_network, "timestamp" // 60 * 60 AS time_str
    FROM access GROUP BY ALL""")
_on_stream("live_pv_by_second", live.live_pv_by_second, "complete", """
    SELECT "timestamp"*1000 AS "timestamp", count(*) AS total_request_num
    FROM access GROUP BY access."timestamp" """)
_on_stream("live_total_pv", live.live_total_pv, "complete", """
    SELECT count(*) AS total_num, "timestamp" // 86400 * 86400 AS time_str FROM access GROUP BY ALL""")
# Append mode shows a bucket once the watermark, 10 minutes behind the newest row, passes it.
_on_stream("live_ip_pv_by_minute", live.live_ip_pv_by_minute, "append", """
    SELECT * FROM (
      SELECT count(DISTINCT ip) AS ip_num, count(*) AS pv_num, "timestamp" // 60 * 60 AS time_str
      FROM access GROUP BY ALL)
    WHERE time_str + 60 <= (SELECT max("timestamp") FROM access) - 600""")
_on_stream("live_total_ip", live.live_total_ip, "append", """
    SELECT * FROM (
      SELECT count(DISTINCT ip) AS total_num, "timestamp" // 86400 * 86400 AS time_str
      FROM access GROUP BY ALL)
    WHERE time_str + 86400 <= (SELECT max("timestamp") FROM access) - 600""")
_on_stream("live_ip_pv_by_minute_running", live.live_ip_pv_by_minute_running, "update", """
    SELECT count(DISTINCT ip) AS ip_num, count(*) AS pv_num, "timestamp" // 60 * 60 AS time_str
    FROM access GROUP BY ALL""")
# With room for all values the ranking is a full count, and exact.
_on_stream("live_top_urls", lambda rows: live.live_top(rows, "request_url", 100_000, tracked=100_000), "update", """
    SELECT "timestamp" // 86400 * 86400 AS time_str, count(*) AS total_num, request_url, 0 AS error
    FROM access GROUP BY ALL""")
_on_stream("live_top_failures", lambda rows: live.live_top(
    rows, "status_code", 50, tracked=100_000, where=F.col("status_code") != 200, width="365 days"), "update", """
    SELECT min("timestamp") // 31536000 * 31536000 AS time_str, count(*) AS total_num, status_code, 0 AS error
    FROM access WHERE status_code <> 200 GROUP BY status_code, "timestamp" // 31536000""")


# ---------------------------------------------------------------- files and queues

def _line_files(spark: SparkSession, sf: str, where=None, path: str | None = None, name: str = "combined_plus") -> str:
    """Rendered lines as six text files, added to what is in the folder."""
    path = path or fresh_path(spark, "log")
    events = fx.events(spark, sf)
    lines = fx.rendered(events if where is None else events.filter(where), name)
    lines.repartition(6).write.mode("append").text(path)
    return path


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("time_str").alias("first_time"), F.max("time_str").alias("last_time"),
        F.sum("bytes_sent").alias("bytes_sent"),
    )


_SUMMED = """count(*) AS n, min(time_str) AS first_time, max(time_str) AS last_time,
       CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent FROM access"""


def _apps(spark: SparkSession, sf: str) -> list[ln.App]:
    purchase = F.col("event_type") == "purchase"
    return [
        ln.App("site.shop", [_line_files(spark, sf, purchase, name="iso_timed")], "iso_timed", "node-1"),
        ln.App("www", [_line_files(spark, sf, ~purchase)], "combined_plus", "node-2"),
    ]


_APPS_SQL = _access_sql(f"""
  SELECT CASE request_method WHEN 'POST' THEN 'node-1' ELSE 'node-2' END AS node_id,
         CASE request_method WHEN 'POST' THEN 'shop' ELSE 'www' END AS app_name,
         CASE request_method WHEN 'POST' THEN 'iso_timed' ELSE 'combined_plus' END AS log_format_name,
         {_SUMMED} GROUP BY ALL""")
_TAGS = ("node_id", "app_name", "log_format_name")


@_query("read_tagged_files", _APPS_SQL)
def _(spark, sf):
    parsed = ingest.parse_stream(ln.read_apps(spark, _apps(spark, sf)), [fx.format_named(n) for n in _MIXED])
    return _summed(good_rows(parsed), *_TAGS)


@_query("stream_tagged_files", _APPS_SQL)
def _(spark, sf):
    lines = ln.stream_apps(spark, _apps(spark, sf), max_files_per_trigger=4)
    path = fresh_path(spark, "access")
    parsed = ingest.parse_stream(lines, [fx.format_named(n) for n in _MIXED])
    ingest.start_ingest(parsed, path, fresh_path(spark, "offsets"), every=None).awaitTermination()
    return _summed(read_access(spark, path), *_TAGS)


def _followed(spark: SparkSession, sf: str, position: str) -> DataFrame:
    """Ingest from a folder that gets more lines between two runs."""
    folder, path, offsets = (fresh_path(spark, n) for n in ("log", "access", "offsets"))
    for half in (0, 1):
        _line_files(spark, sf, F.col("event_id") % 2 == half, folder)
        lines = ln.follow_apps(
            spark, [ln.App("www", [folder], "combined_plus", "node-1")], position=position)
        parsed = ingest.parse_stream(lines, [fx.format_named("combined_plus")])
        ingest.start_ingest(parsed, path, offsets, every=None).awaitTermination()
    return _summed(read_access(spark, path), "node_id", "app_name")


@_query("follow_growing_files", _access_sql(f"SELECT 'node-1' AS node_id, 'www' AS app_name, {_SUMMED}"))
def _(spark, sf):
    return _followed(spark, sf, "head")


@_query("follow_from_the_tail", _access_sql(
    f"SELECT 'node-1' AS node_id, 'www' AS app_name, {_SUMMED} WHERE event_id % 2 = 1"))
def _(spark, sf):
    return _followed(spark, sf, "tail")


def _queued(spark: SparkSession, sf: str, times_sent: int = 1) -> str:
    """A queue of envelopes in compressed text files, each sent as often as asked for."""
    tagged = _tagged_lines(spark, sf).withColumn(
        ln.SENT_KEY, F.concat_ws(" ", "node_id", F.monotonically_increasing_id().cast("string")))
    envelopes = ln.to_envelopes(tagged, [fx.format_named(n) for n in _MIXED])
    once = fresh_path(spark, "sent")
    envelopes.write.text(once, compression="lz4")
    path = fresh_path(spark, "queue")
    for _ in range(times_sent):
        spark.read.text(once).repartition(4).write.mode("append").text(path, compression="lz4")
    return path


_QUEUE_SQL = _access_sql(f"""
  SELECT CASE WHEN request_method = 'POST' THEN 'shop' ELSE 'www' END AS app_name, {_SUMMED} GROUP BY ALL""")


@_query("queue_in_two_runs", _QUEUE_SQL)
def _(spark, sf):
    queue, path, offsets = _queued(spark, sf), fresh_path(spark, "access"), fresh_path(spark, "offsets")
    named = [fx.format_named(n) for n in _MIXED]
    for _ in range(2):  # the second finds everything handled
        parsed = ingest.parse_envelopes(ln.read_queue(spark, "text", path=queue, maxFilesPerTrigger=3), named)
        ingest.start_ingest(parsed, path, offsets, every=None).awaitTermination()
    return _summed(read_access(spark, path), "app_name")


@_query("queue_of_resent_envelopes", _QUEUE_SQL)
def _(spark, sf):
    queue, path = _queued(spark, sf, times_sent=3), fresh_path(spark, "access")
    once = ln.drop_resent(ln.read_queue(spark, "text", path=queue, maxFilesPerTrigger=6))
    parsed = ingest.parse_envelopes(once, [fx.format_named(n) for n in _MIXED])
    ingest.start_ingest(parsed, path, fresh_path(spark, "offsets"), every=None).awaitTermination()
    return _summed(read_access(spark, path), "app_name")


@_query("queue_with_bad_formats", _access_sql("""
  SELECT CASE WHEN event_id % 3 = 0 THEN 'unknown format' END AS reason, count(*) AS n
  FROM access GROUP BY ALL"""))
def _(spark, sf):
    fmt = fx.format_named("combined_plus")
    bad = F.col("event_id") % 3 == 0
    queue = fx.events(spark, sf).select(F.to_json(F.struct(
        fx.combined_plus_line().alias("line"), F.lit("main").alias("log_format_name"),
        F.when(bad, F.concat(F.lit("$no_such_"), F.col("event_id") % 7)).otherwise(fmt.format_str).alias("log_format_str"),
    )).alias("value"))
    found = ln.formats_in(ln.from_envelopes(queue), "nginx")
    parsed = ingest.parse_envelopes(queue, found)
    return parsed.groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@_query("stream_in_steps", _access_sql("""
  SELECT strftime(t, '%Y_%m') AS period, count(*) AS n, 'after' AS step FROM access GROUP BY ALL"""))
def _(spark, sf):
    path, out = fresh_path(spark, "access"), fresh_path(spark, "panel")

    def after(batch: DataFrame, number: int) -> None:
        table = read_access(batch.sparkSession, path)
        table.groupBy(PERIOD).agg(F.count("*").alias("n")).withColumn("step", F.lit("after")).write.mode(
            "overwrite").parquet(out)

    lines = ln.stream_apps(
        spark, [ln.App("www", [_line_files(spark, sf)], "combined_plus", "node-1")], max_files_per_trigger=3)
    parsed = ingest.parse_stream(lines, [fx.format_named("combined_plus")])
    ingest.start_batches(
        parsed, fresh_path(spark, "offsets"), ingest.write_numbered(path, split_save="month"), after=after, every=None
    ).awaitTermination()
    return spark.read.schema("period string, n long, step string").parquet(out)


@_query("parse_own_server_type", _access_sql("""
  SELECT ip, request_length AS took, 'e' || CAST(event_id % 5 AS VARCHAR) AS edge, count(*) AS n FROM access GROUP BY ALL"""))
def _(spark, sf):
    register_server_type(ServerType("edge", r"<\w+>", {
        "<who>": Variable("ip"), "<ms>": Variable("took", "digits+", "bigint"), "<edge>": Variable("edge")}))
    p = fx._parts()
    lines = fx.events(spark, sf).select(F.concat(
        p["ip"], F.lit(" took "), p["received"], F.lit("ms at e"), (F.col("event_id") % 5).cast("string")).alias("value"))
    rows = good_rows(parse_lines(lines, fm.compile_format("edge", "edge", "<who> took <ms>ms at <edge>")))
    return rows.groupBy("ip", "took", "edge").agg(F.count("*").alias("n"))


@_query("geo_join_read_ranges", _CUSTOMER_GEO_SQL)
def _(spark, sf):
    path = fresh_path(spark, "ranges")
    fx.customer_ranges(spark, sf).write.parquet(path)
    return geo_join(_event_addresses(spark, sf), read_ranges(spark, path)).drop("ip")


@_query("three_places", """
  SELECT o_orderkey, CAST(round(CAST((o_orderkey * 10007 % 1000003) / 10000.0 AS DECIMAL(18, 4)), 3) AS DOUBLE) AS amount
  FROM orders""")
def _(spark, sf):
    amount = ((F.col("o_orderkey") * 10007 % 1000003) / 10000).cast("decimal(18,4)")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", measures.three_places(amount).alias("amount"))


# ---------------------------------------------------------------- rollups and word index

def _rolled(spark: SparkSession, sf: str, **options) -> DataFrame:
    table, out = _stored(spark, sf, "month"), fresh_path(spark, "rollup")
    rollup.keep_rollup(spark, table, out, **options)
    return rollup.read_rollup(spark, out)


@_query("rollup_by_hour", _access_sql("""
  SELECT "timestamp" // 3600 * 3600 AS time_str, count(*) AS pv_num,
         count(*) FILTER (status_code <> 200) AS failed, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
         CAST(sum(request_length) AS BIGINT) AS request_length
  FROM access GROUP BY ALL"""))
def _(spark, sf):
    return rollup.totals(_rolled(spark, sf), 3600).drop("ip_num")


@_query("rollup_traffic_by_minute", _access_sql(_TRAFFIC_SQL.format(where=_SINCE, limit="")))
def _(spark, sf):
    return rollup.network_traffic(_rolled(spark, sf))


@_query("rollup_visitors_by_day", _access_sql("""
  SELECT "timestamp" // 86400 * 86400 AS time_str, count(*) AS pv_num, TRUE AS within_error FROM access GROUP BY ALL"""))
def _(spark, sf):
    rolled = rollup.totals(_rolled(spark, sf), 86400).select("time_str", "pv_num", "ip_num")
    day = F.expr("timestamp div 86400 * 86400").alias("time_str")
    exact = distinct_and_all(access_rows(spark, sf, False), "ip", day).select(F.col("ip_num").alias("exact"), "time_str")
    error = F.abs(F.col("ip_num") - F.col("exact")) <= F.ceil(rollup.visitors_error() * F.col("exact"))
    return rolled.join(exact, "time_str").select("time_str", "pv_num", error.alias("within_error"))


@_query("rollup_top_urls", _access_sql("""
  SELECT count(*) AS total_num, request_url FROM access GROUP BY request_url ORDER BY total_num DESC, request_url LIMIT 10"""))
def _(spark, sf):
    return rollup.top(_rolled(spark, sf, by=("request_url",)), "request_url")


def _word_index(spark: SparkSession, sf: str) -> WordIndex:
    table, out = _stored(spark, sf, "month"), fresh_path(spark, "index")
    keep_index(spark, table, out)
    return WordIndex(spark, out)


@_query("index_spider_by_ua", _access_sql(f"SELECT count(*) AS total_num, ua FROM access WHERE {_SPIDER_WORD} GROUP BY ua"))
def _(spark, sf):
    return _word_index(spark, sf).counts("spider").withColumnRenamed("text", "ua")


@_query("index_device_type_by_ua", _access_sql(f"""
    SELECT count(DISTINCT CASE WHEN list_contains(w, 'gecko') AND NOT list_contains(w, 'mobile') THEN ua END) AS pc_num,
           count(DISTINCT CASE WHEN list_contains(w, 'mobile') OR list_contains(w, 'xfb') THEN ua END) AS mobile_num
    FROM (SELECT ua, {_WORDS_SQL.format('ua')} AS w FROM access)"""))
def _(spark, sf):
    index = _word_index(spark, sf)
    pc = index.distinct_texts("+gecko -mobile", "boolean").select(F.col("num").alias("pc_num"))
    mobile = index.distinct_texts("mobile xfb").select(F.col("num").alias("mobile_num"))
    return pc.join(mobile, F.lit(True))  # one row each


# ---------------------------------------------------------------- rewritten tables

@_query("compacted_months", _access_sql("""
    SELECT strftime(t, '%Y_%m') AS period, count(*) AS n, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
           TRUE AS fewer_files
    FROM access GROUP BY ALL"""))
def _(spark, sf):
    path = fresh_path(spark, "access")
    lines = ln.stream_apps(
        spark, [ln.App("www", [_line_files(spark, sf)], "combined_plus", "node-1")], max_files_per_trigger=1)
    parsed = ingest.parse_stream(lines, [fx.format_named("combined_plus")])
    ingest.start_ingest(parsed, path, fresh_path(spark, "offsets"), split_save="month", every=None).awaitTermination()
    before = published.live_files(spark, path).count()
    published.compact(spark, path)
    fewer = published.live_files(spark, path).count() < before
    return published.read_published(spark, path).groupBy(PERIOD).agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes_sent")).withColumn("fewer_files", F.lit(fewer))


@_query("replayed_rejects", _access_sql(f"""
    SELECT coalesce(host, '-') AS host, n, first_time, last_time, bytes_sent FROM (
      SELECT CASE WHEN event_id % 2 = 1 THEN 'shop.example.com' END AS host, {_SUMMED} GROUP BY ALL)"""))
def _(spark, sf):
    path = fresh_path(spark, "access")
    known, late = (fx.format_named(n) for n in _MIXED)
    write_access(ingest.parse_stream(_tagged_lines(spark, sf), [known]), path, split_save="month")
    published.replay_rejects(spark, path, [late], format_column="log_format_name", split_save="month")
    rows = published.read_published(spark, path)
    return _summed(rows.withColumn("host", F.coalesce("host", F.lit("-"))), "host")


@_query("clustered_look_up", _access_sql(f"""
    SELECT ip, status_code, count(*) AS n, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent
    FROM access WHERE ip = '{IP}' GROUP BY ALL"""))
def _(spark, sf):
    path = _stored(spark, sf, "year")
    published.cluster(spark, path, periods=["2024"], target_bytes=8 << 20)
    rows = published.read_published(spark, path, split_save="year", first="2024-01-01").filter(F.col("ip") == IP)
    return rows.groupBy("ip", "status_code").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes_sent"))


# ---------------------------------------------------------------- driver contract

def entry(spark: SparkSession) -> DataFrame:
    """Lines to parsed, located rows to the most requested URLs."""
    return queries()["request_num_by_url_since"](spark, "/root/testdata/sf0.001")


def _in_utc(fn: Query) -> Query:
    """The rendered lines and the SQL are in UTC, so the wall clock is read in it."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


try:
    from accessloom.llm import entries as _llm
except ImportError:  # the training-data operators are an add-on
    _llm = None


def _on_workers(fn: Query) -> Query:
    """Python workers of a local session find the package as this process does."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = spark.sparkContext.environment
        root = os.path.dirname(os.path.abspath(__file__))
        if root not in known.get("PYTHONPATH", "").split(os.pathsep):
            known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _on_workers(_in_utc(fn)) for name, fn in (_QUERIES | (_llm.queries() if _llm else {})).items()}


def oracle_sql() -> dict[str, str]:
    return _SQL | (_llm.oracle_sql() if _llm else {})
