import datetime as dt

import pytest
from pyspark.sql import functions as F

from accessloom.functions import measures, network, text, times


def one_by_one(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    exprs = expr if isinstance(expr, dict) else {"x": expr}
    rows = df.select("i", *[c.alias(k) for k, c in exprs.items()]).orderBy("i").collect()
    return [tuple(r)[1:] if isinstance(expr, dict) else r.x for r in rows]


def test_request_parts(spark):
    cases = {
        "": ("", "", "", ""),
        "   ": ("", "", "", ""),
        "\\x16\\x03": ("", "\\x16\\x03", "", ""),
        "GET /a": ("", "GET /a", "", ""),
        "GET /a HTTP/1.1": ("GET", "/a", "", "HTTP/1.1"),
        "GET /a?x=1?y=2 HTTP/1.1": ("GET", "/a", "x=1", "HTTP/1.1"),
        "GET /a b HTTP/1.1": ("GET", "/a", "", "b"),
        "GET  /a HTTP/1.1": ("GET", "", "", "/a"),
        "GET ?q HTTP/1.1": ("GET", "", "q", "HTTP/1.1"),
        " a": ("", " a", "", ""),
    }
    assert one_by_one(spark, cases, text.request_parts(F.col("v"))) == list(cases.values())


@pytest.mark.parametrize("layout,raw,expected", [
    ("time_local", "11/Sep/2020:15:20:43 +0800", ("2020-09-11 15:20:43", 1599837643)),
    ("time_local", "[11/Sep/2020:15:20:43 +0800]", ("2020-09-11 15:20:43", 1599837643)),
    ("time_local", "11/Sep/2020:15:20:43+0800", ("2020-09-11 15:20:43", 1599837643)),
    ("time_local", "11/sep/2020:15:20:43", ("2020-09-11 15:20:43", 1599837643)),
    ("time_local", "1/Sep/2020:5:20:43 +0800", ("2020-09-01 05:20:43", 1598937643)),
    ("time_local", "10/Oct/2000:13:55:36 -0700", ("2000-10-10 13:55:36", 971186136)),
    ("time_iso8601", "2020-09-11T15:20:43+08:00", ("2020-09-11 15:20:43", 1599837643)),
    ("time_iso8601", "2020-09-11T15:20:43-08:00", ("2020-09-11 15:20:43", 1599837643)),
    ("time_local", "bad", (None, None)),
    ("time_local", "", (None, None)),
    ("time_local", "31/Feb/2020:15:20:43 +0800", (None, None)),
    ("time_local", "11/Foo/2020:15:20:43 +0800", (None, None)),
    ("time_local", "11/ep /2020:15:20:43 +0800", (None, None)),
    ("time_local", "11/Sep/2020:15:20:43 junk", (None, None)),
    ("time_iso8601", "11/Sep/2020:15:20:43 +0800", (None, None)),
])
def test_time_parts(spark, layout, raw, expected):
    parts = times.time_parts(F.col("v"), layout)
    assert one_by_one(spark, [raw], {k: parts[k] for k in ("time_str", "timestamp")}) == [expected]


def test_time_offset_on_request(spark):
    parts = times.time_parts(F.col("v"), "time_local", honor_offset=True)
    got = one_by_one(spark, ["11/Sep/2020:15:20:43 +0800", "10/Oct/2000:13:55:36 -0730", "11/Sep/2020:15:20:43"],
                     {k: parts[k] for k in ("time_str", "timestamp")})
    assert got == [("2020-09-11 07:20:43", 1599837643 - 28800), ("2000-10-10 21:25:36", 971186136 + 27000),
                   ("2020-09-11 15:20:43", 1599837643)]


def test_session_zone_plays_the_local_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        parts = times.time_parts(F.col("v"), "time_local")
        got = one_by_one(spark, ["11/Sep/2020:15:20:43 +0000"], {k: parts[k] for k in ("time_str", "timestamp")})
        assert got == [("2020-09-11 15:20:43", 1599837643 - 28800)]
        assert spark.range(1).select(times.epoch_of("2020-09-11").alias("x")).first().x == 1599753600
        assert spark.range(1).select(times.clock_label(F.lit(1599753660)).alias("x")).first().x == "00:01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_periods(spark):
    days = {"2024-01-17": ("2024_01_17", "2024_01_15_21", "2024_01", "2024"),
            "2024-01-31": ("2024_01_31", "2024_01_29_04", "2024_01", "2024")}
    exprs = {p: times.period_of(F.col("v").cast("timestamp"), p) for p in times.PERIODS}
    assert one_by_one(spark, days, exprs) == list(days.values())
    for day, names in days.items():
        assert tuple(times.period_name(dt.date.fromisoformat(day), p) for p in times.PERIODS) == names
    with pytest.raises(ValueError):
        times.period_of(F.col("v"), "hour")
    with pytest.raises(ValueError):
        times.period_name(dt.date(2024, 1, 1), "hour")


def test_ip_to_long(spark):
    cases = {"47.112.167.32": 795911968, "10.0.0.0": 167772160, "255.255.255.255": 4294967295,
             "010.0.0.1": 167772161, "::1": None, "-": None, "1.2.3": None, "1.2.3.999": None,
             "1.2.3.4.5": None, "1.2.3.+4": None, " 1.2.3.4": None, "": None}
    assert one_by_one(spark, cases, network.ip_to_long(F.col("v"))) == list(cases.values())


def test_region_parts(spark):
    cases = {"China|0|Guangdong|Shenzhen|Telecom": ("Telecom", "Shenzhen", 7, "Guangdong", "China"),
             "a|b|c": ("c", "b", 7, "a", "a"), "a|b": ("0", "0", 0, "0", "0"), "": ("0", "0", 0, "0", "0")}
    got = one_by_one(spark, list(cases) + [None], network.region_parts(F.col("v"), F.lit(7)))
    assert got == list(cases.values()) + [("0", "0", 0, "0", "0")]


def test_stored_values(spark):
    assert one_by_one(spark, ["", "a", '"a"', "-", '"'], text.stored_text(F.col("v"))) == ["-", "a", "a", "-", ""]
    assert one_by_one(spark, ["", '"a"'], text.stored_text(F.col("v"), False)) == ["", '"a"']
    assert one_by_one(spark, ["", "-", "12", "x"], text.stored_number(F.col("v"), "bigint")) == [0, 0, 12, None]
    assert one_by_one(spark, ["", "12"], text.stored_number(F.col("v"), "int", False)) == [None, 12]
    assert one_by_one(spark, ["0.0184", ""], text.stored_number(F.col("v"), "double")) == [0.018, 0.0]


def test_strip_and_digits(spark):
    assert one_by_one(spark, ["　 a b\t\r\n\x85"], text.strip(F.col("v"))) == ["a b"]
    assert one_by_one(spark, ["code=5 0x2"], text.digits_only(F.col("v"))) == ["502"]


def test_word_search(spark):
    agents = ["Sogou web spider/4.0", "Baiduspider/2.0", "360Spider", "SPIDER", "spider_x", "a-spider", "spiderspider spider", "éspider", ""]
    assert one_by_one(spark, agents, text.has_word(F.col("v"), "spider")) == [
        True, False, False, True, False, True, True, False, False]
    assert one_by_one(spark, agents, text.has_substring(F.col("v"), "spider")) == [
        True, True, False, False, True, True, True, True, False]
    both = ["like Gecko", "Gecko Mobile", "XFB", "none"]
    assert one_by_one(spark, both, text.fulltext(F.col("v"), "+gecko -mobile", "boolean")) == [True, False, False, False]
    assert one_by_one(spark, both, text.fulltext(F.col("v"), "mobile xfb", "boolean")) == [False, True, True, False]
    assert one_by_one(spark, both, text.fulltext(F.col("v"), "-mobile", "boolean")) == [False] * 4
    assert one_by_one(spark, ["c++ x", "c x"], text.has_word(F.col("v"), "c++")) == [True, False]
    with pytest.raises(ValueError):
        text.fulltext(F.col("v"), "a", "phrase")
    with pytest.raises(ValueError):
        text.fulltext(F.col("v"), "+ a", "boolean")


def test_measures(spark):
    row = spark.range(1).select(
        measures.kilobytes(F.lit(1536 + 128)).alias("kb"), measures.whole(F.lit(2.5)).alias("w"),
        measures.three_places(F.lit("1.23456").cast("decimal(10,5)")).alias("t"),
        measures.percent(F.lit(1), F.lit(3)).alias("p"), measures.percent(F.lit(201), F.lit(20000)).alias("q"),
        times.minute_of(F.lit(119)).alias("m"), times.millis(F.lit(5)).alias("ms"),
        times.date_text(F.lit(1705276800)).alias("d"),
    ).first()
    assert (row.kb, row.w, row.t, row.p, row.q) == (1.63, 3, 1.235, 33.33, 1.01)
    assert (row.m, row.ms, row.d) == (60, 5000, "2024-01-15")
