"""Rollups and word indexes: equal to the rows, and only changed periods are made again."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from accessloom.functions.text import fulltext
from accessloom.operators.parse import parse_lines
from accessloom.operators.word_index import WordIndex, keep_index
from accessloom.plans import rollup as ru
from accessloom.plans import traffic
from accessloom.sources.derived import read_part
from accessloom.sources.tables import read_access, write_access
from fixtures import rendered as fx

FMT = fx.format_named("combined_plus")


@pytest.fixture
def table(spark, tmp_path):
    events = fx.events(spark, "/root/testdata/sf0.001").filter(F.col("ts") < "2024-01-09")
    write_access(parse_lines(fx.rendered(events), FMT), str(tmp_path / "access"))
    return str(tmp_path / "access")


def add(spark, table, day):
    events = fx.events(spark, "/root/testdata/sf0.001").filter(F.col("ts").cast("date") == day)
    write_access(parse_lines(fx.rendered(events), FMT), table)


def plain(df):
    return sorted(map(tuple, df.collect()))


def stamps(folder):
    return {d: os.stat(os.path.join(folder, d)).st_mtime_ns for d in os.listdir(folder) if "=" in d}


def test_rollup_answers_spans(spark, tmp_path, table):
    out = str(tmp_path / "rollup")
    made = ru.keep_rollup(spark, table, out)
    rows, rolled = read_access(spark, table), ru.read_rollup(spark, out)
    assert len(made) == rows.select("period").distinct().count()
    first, last = 1704067200 + 3600 * 5, 1704067200 + 3600 * 77
    span = rows.filter((F.col("timestamp") >= first) & (F.col("timestamp") < last))
    one = ru.totals(ru.in_span(rolled, first, last)).first()
    want = span.agg(F.count("*"), F.count_if(F.col("status_code") != 200), F.sum("bytes_sent"), F.sum("request_length"),
                    F.count_distinct("ip")).first()
    assert (one.pv_num, one.failed, one.bytes_sent, one.request_length) == tuple(want)[:4]
    assert abs(one.ip_num - want[4]) <= ru.visitors_error() * want[4]
    assert plain(ru.totals(ru.in_span(rolled, first, last), 3600).select("time_str", "pv_num")) == plain(
        span.groupBy(F.expr("timestamp div 3600 * 3600")).count())
    minutes = traffic.network_traffic_by_minute(rows, "2024-01-01", span="day", open_ended=True, limit=None)
    assert plain(ru.network_traffic(rolled)) == plain(minutes)
    nothing = ru.totals(ru.in_span(rolled, 60, 120)).first()
    assert nothing.pv_num is None and nothing.ip_num == 0
    with pytest.raises(ValueError):
        ru.in_span(rolled, 30)
    with pytest.raises(ValueError):
        ru.totals(rolled, 90)


def test_rollup_by_url(spark, tmp_path, table):
    out = str(tmp_path / "urls")
    ru.keep_rollup(spark, table, out, by=("request_url",))
    got = ru.top(ru.read_rollup(spark, out), "request_url")
    want = traffic.request_num_by_url(read_access(spark, table), "2024-01-01", open_ended=True)
    assert got.collect() == want.collect()


def test_only_changed_periods_are_made_again(spark, tmp_path, table):
    out = str(tmp_path / "rollup")
    ru.keep_rollup(spark, table, out)
    assert ru.keep_rollup(spark, table, out) == []
    before = stamps(f"{out}/minutes")
    add(spark, table, "2024-01-03")
    add(spark, table, "2024-01-20")
    assert ru.keep_rollup(spark, table, out) == ["2024_01_03", "2024_01_20"]
    after = stamps(f"{out}/minutes")
    assert {d for d in after if after[d] != before.get(d)} == {"period=2024_01_03", "period=2024_01_20"}
    assert ru.totals(ru.read_rollup(spark, out)).first().pv_num == read_access(spark, table).count()
    shutil.rmtree(f"{table}/outcome=parsed/period=2024_01_20")
    assert ru.keep_rollup(spark, table, out) == ["2024_01_20"]
    assert ru.totals(ru.read_rollup(spark, out)).first().pv_num == read_access(spark, table).count()


def test_a_job_that_died_before_its_marks(spark, tmp_path, table, monkeypatch):
    """Periods written without a mark are written again, not twice."""
    from accessloom.sources import derived

    out, replace = str(tmp_path / "rollup"), derived._replace

    def dies(df, path):
        if path.endswith(derived.MARKS):
            raise RuntimeError("lost")
        replace(df, path)

    monkeypatch.setattr(derived, "_replace", dies)
    with pytest.raises(RuntimeError):
        ru.keep_rollup(spark, table, out)
    monkeypatch.setattr(derived, "_replace", replace)
    assert len(ru.keep_rollup(spark, table, out)) > 5
    assert ru.totals(ru.read_rollup(spark, out)).first().pv_num == read_access(spark, table).count()


QUERIES = [("spider", "natural"), ("spider mobile", "natural"), ("+gecko -mobile", "boolean"), ("+mozilla +linux", "boolean"),
           ("+nothing", "boolean"), ("-gecko", "boolean"), ("Firefox/80.0", "natural"), ("curl -spider", "boolean"),
           ("+web +spider -sogou", "boolean"), ("SPIDER", "natural")]


def test_index_equals_a_scan(spark, tmp_path, table):
    out = str(tmp_path / "index")
    keep_index(spark, table, out)
    index, rows = WordIndex(spark, out), read_access(spark, table)
    for query, mode in QUERIES:
        found = rows.filter(fulltext(F.col("ua"), query, mode))
        assert plain(index.counts(query, mode)) == sorted(
            (r["count"], r.ua) for r in found.groupBy("ua").count().collect()), query
        assert index.distinct_texts(query, mode).first().num == found.select("ua").distinct().count()
    add(spark, table, "2024-01-04")
    assert keep_index(spark, table, out) == ["2024_01_04"]
    day = WordIndex(spark, out, ["2024_01_04"])
    scan = read_access(spark, table, split_save="day", first="2024-01-04")
    assert plain(day.counts("spider")) == plain(traffic.spider_by_ua(scan).select("total_num", "ua"))
    with pytest.raises(ValueError):
        index.with_word("//")


def test_an_index_reads_no_rows(spark, tmp_path, table):
    out = str(tmp_path / "index")
    keep_index(spark, table, out)
    read = WordIndex(spark, out).distinct_texts("+gecko -mobile", "boolean").inputFiles()
    assert read and all("/postings/" in f for f in read)
    counts = WordIndex(spark, out).counts("spider").inputFiles()
    assert all("/index/" in f for f in counts)
    assert read_part(spark, out, "texts").count() <= 6 * 8
