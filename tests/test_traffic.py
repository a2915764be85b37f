import datetime as dt

import pytest
from pyspark.sql import functions as F

from accessloom.plans import traffic

DAY = "2024-01-15"
SCHEMA = ("ip string, request_url string, status_code int, province string, ua string, "
          "bytes_sent bigint, request_length bigint, timestamp bigint")


def at(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp())


@pytest.fixture(scope="module")
def access(spark):
    rows = [
        ("a", "/1", 200, "Guangdong", "Gecko x", 1024, 512, at("2024-01-15 00:00:00")),
        ("a", "/1", 500, "Guangdong", "Gecko Mobile", 1024, 512, at("2024-01-15 12:00:00")),
        ("b", "/2", 500, "0", "web spider", 100, 5, at("2024-01-15 12:00:59")),
        ("b", "/2", 404, "Beijing", "Baiduspider", 128, 5, at("2024-01-15 12:59:59")),
        ("c", "/3", 200, "Beijing", "web spider", 7, 7, at("2024-01-15 23:59:59")),
        ("d", "/1", 500, "Beijing", "xfb", 7, 7, at("2024-01-16 00:00:00")),
        ("e", "/1", 500, "Beijing", "Gecko x", 7, 7, at("2024-01-14 23:59:59")),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_totals(access):
    assert rows(traffic.total_ip(access, DAY)) == [(3,)]
    assert rows(traffic.total_ip(access, DAY, rsd=0.01)) == [(3,)]
    assert rows(traffic.total_pv(access, DAY)) == [(5,)]
    assert rows(traffic.total_pv(access, dt.date(2024, 1, 15), open_ended=True)) == [(6,)]
    assert rows(traffic.total_ip(access, "2020-01-01")) == [(0,)]


def test_rankings(access):
    urls = traffic.request_num_by_url(access, DAY)
    assert urls.columns == ["total_num", "request_url"]
    assert rows(urls) == [(1, "/3"), (2, "/2"), (2, "/1")]
    assert rows(traffic.request_num_by_url(access, DAY, limit=1)) == [(2, "/1")]
    assert rows(traffic.request_num_by_url(access, DAY, limit=None)) == rows(urls)
    assert rows(traffic.request_num_by_ip(access, DAY)) == [(1, "c"), (2, "b"), (2, "a")]
    assert rows(traffic.request_urls_by_ip(access, DAY, ip="a")) == [(2, "/1")]
    assert rows(traffic.request_num_by_status(access, DAY)) == [(1, 404), (2, 500)]
    assert rows(traffic.request_num_by_status(access, DAY, percent=True)) == [(1, 404, 33.33), (2, 500, 66.67)]
    assert rows(traffic.request_num_by_status_code(access, DAY, code="500")) == [(1, "/2"), (1, "/1")]
    assert rows(traffic.request_num_by_status_code(access, DAY, code="code 404")) == [(1, "/2")]
    assert rows(traffic.request_num_by_province(access, DAY)) == [(2, "Guangdong"), (2, "Beijing")]
    kept = traffic.request_num_by_province(access, DAY, keep_unresolved=True)
    assert rows(kept) == [(1, "0"), (2, "Guangdong"), (2, "Beijing")]
    with pytest.raises(ValueError):
        traffic.request_num_by_url(access, DAY, limit=-1)


@pytest.mark.parametrize("call", [
    lambda a: traffic.request_urls_by_ip(a, DAY), lambda a: traffic.request_urls_by_ip(a, DAY, ip=""),
    lambda a: traffic.request_num_by_status_code(a, DAY),
    lambda a: traffic.request_num_by_status_code(a, DAY, code="x"),
    lambda a: traffic.network_traffic_by_minute(a, DAY, span="week"),
    lambda a: traffic.spider_by_ua(a, match="regex"),
])
def test_missing_or_wrong_arguments(access, call):
    with pytest.raises(ValueError):
        call(access)


def test_series(access):
    noon, last = at("2024-01-15 12:00:00"), at("2024-01-15 12:59:00")
    series = traffic.network_traffic_by_minute(access, "2024-01-15 12:34:56")
    assert series.columns == ["out_network", "in_network", "time_str"]
    assert rows(series) == [(1.1, 0.5, noon), (0.13, 0.0, last)]
    assert rows(traffic.network_traffic_by_minute(access, "2024-01-15 12:34:56", rounded=False, limit=1)) == [
        (0.125, 5 / 1024, last)]
    assert rows(traffic.traffic_chart(series)) == [(1, 1, "12:00"), (0, 0, "12:59")]
    assert rows(traffic.ip_pv_num_by_minute(access, dt.datetime(2024, 1, 15, 12))) == [(2, 2, noon), (1, 1, last)]
    assert rows(traffic.ip_num_by_minute(access, dt.datetime(2024, 1, 15, 12))) == [(2, noon), (1, last)]
    assert rows(traffic.pv_num_by_minute(access, dt.datetime(2024, 1, 15, 12), limit=1)) == [(1, last)]
    assert traffic.pv_num_by_minute(access, DAY, span="day", limit=None).count() == 4
    seconds = traffic.request_num_by_seconds(access, DAY, limit=2)
    assert rows(seconds) == [(at("2024-01-15 12:59:59") * 1000, 1), (at("2024-01-15 23:59:59") * 1000, 1)]
    assert traffic.request_num_by_seconds(access, DAY, init=True).count() == 5


def test_agents(access):
    assert rows(traffic.spider_by_ua(access)) == [(2, "web spider")]
    assert rows(traffic.spider_by_ua(access, DAY, match="substring")) == [(2, "web spider"), (1, "Baiduspider")]
    assert rows(traffic.spider_by_ua(access, match="substring", percent=True)) == [
        (2, "web spider", 66.67), (1, "Baiduspider", 33.33)]
    assert rows(traffic.spider_by_ua(access, match="substring", ascending=True))[0] == (1, "Baiduspider")
    assert rows(traffic.device_type_by_ua(access)) == [(1, 2)]
    assert rows(traffic.device_type_by_ua(access, DAY)) == [(1, 1)]


def test_map(access, spark):
    geometry = spark.createDataFrame(
        [(1, "Guangdong Sheng", [113.0, 23.0]), (0, "Gu first", [1.0, 2.0]), (2, "Hebei", [3.0, 4.0])],
        "ord int, name string, center array<double>")
    provinces = traffic.request_num_by_province(access, DAY)
    flows = traffic.map_flows(provinces, geometry, to_name="Shenzhen", to_center=[114.0, 22.5])
    assert rows(flows) == [("Gu first", "Shenzhen", [[1.0, 2.0], [114.0, 22.5]], 2)]
    assert rows(traffic.map_points(provinces, geometry)) == [("Gu first", [1.0, 2.0, 2.0])]


def test_status_chart(access):
    assert rows(traffic.status_chart(traffic.request_num_by_status(access, DAY)))[0] == ("状态码：404", 1, 33.33)


def test_plans(access, spark, tmp_path, capsys):
    access.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    traffic.request_num_by_url(stored, DAY).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(timestamp,1705276800), LessThan(timestamp,1705363200)" in plan
    assert "ReadSchema: struct<request_url:string,timestamp:bigint>" in plan
    traffic.spider_by_ua(stored, percent=True).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_time_zone(access, spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert rows(traffic.total_pv(access, "2024-01-16")) == [(2,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
