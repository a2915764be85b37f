"""Formats found from the lines themselves."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from accessloom.operators.parse import good_rows, parse_lines, rejected_rows
from accessloom.operators.untagged import FormatTrie, parse_untagged
from accessloom.sources.formats import compile_format
from fixtures import rendered as fx

SF = "/root/testdata/sf0.001"
NAMES = ("combined_plus", "iso_timed", "combinedio")


def many(n):
    return [compile_format("nginx", f"f{i}", f'$remote_addr [$time_local] "$request" $status edge{i} "$http_user_agent"')
            for i in range(n)]


def test_equal_to_tagged_lines(spark):
    """Each line gets its own format, and the same columns as when it is told."""
    events = fx.events(spark, SF).limit(300)
    named = [fx.format_named(n) for n in NAMES[:2]]
    lines = fx.rendered(events).unionByName(fx.rendered(events, "iso_timed"))
    got = parse_untagged(lines.withColumn("node_id", F.lit("n")), named + many(40))
    assert good_rows(got).groupBy("log_format_name").count().collect() and good_rows(got).count() == 600
    for name in NAMES[:2]:
        want = good_rows(parse_lines(fx.rendered(events, name), fx.format_named(name)))
        mine = good_rows(got).filter(F.col("log_format_name") == name).select(want.columns)
        assert sorted(map(tuple, mine.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_five_hundred_formats(spark):
    formats = many(500)
    events = fx.events(spark, SF).limit(500).withColumn("i", F.row_number().over(Window.orderBy("event_id")) - 1)
    p = fx._parts()
    lines = events.select(F.concat(
        p["ip"], F.lit(" ["), fx._local(F.col("ts")), F.lit('] "'), fx._request(p), F.lit('" '), p["status"],
        F.lit(" edge"), F.col("i").cast("string"), F.lit(' "'), p["ua"], F.lit('"')).alias("value"))
    rows = good_rows(parse_untagged(lines, formats))
    assert rows.count() == 500 and rows.select("log_format_name").distinct().count() == 500
    assert rows.filter(F.col("status_code") > 0).count() == 500

    def size(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString())

    assert size(parse_untagged(lines, formats)) == size(parse_untagged(lines, formats[:2]))


def test_rejects_and_ties(spark):
    formats = [compile_format("nginx", "loose", "$remote_addr $status"), compile_format("nginx", "strict", "$remote_addr $status x"),
               compile_format("nginx", "begun", "<$remote_addr> [$time_local]"), compile_format("nginx", "a", "$host|$status"),
               compile_format("nginx", "b", "$remote_addr|$status")]
    lines = [("1.1.1.1 200",), ("1.1.1.1 200 X",), ("x<1.1.1.1>[b]",), ("<1.1.1.1> [11/Sep/2020:15:20:43 +0800]",),
             ("<1.1.1.1> [nonsense]",), ("h|5",), (None,), ("",)]
    parsed = parse_untagged(spark.createDataFrame(lines, "value string"), formats)
    got = {r.ip or r.host: r.log_format_name for r in good_rows(parsed).select("ip", "host", "log_format_name").collect()}
    assert good_rows(parsed).groupBy("log_format_name").count().count() == 4 and got["h"] == "a"
    assert sorted((r.line or "", r.reason) for r in rejected_rows(parsed).collect()) == [
        ("", "format mismatch"), ("", "format mismatch"), ("<1.1.1.1> [nonsense]", "unreadable time"),
        ("x<1.1.1.1>[b]", "format mismatch")]
    with pytest.raises(ValueError):
        parse_untagged(spark.createDataFrame(lines, "value string"), formats[:1] * 2)


def test_the_trie_finds_what_trying_all_finds():
    rng = random.Random(7)
    formats = []
    for i in range(60):
        pieces = rng.choices([" ", " - ", "|", " [", "] ", '"', " x", "-Y "], k=rng.randint(1, 4))
        names = rng.sample(["$remote_addr", "$status", "$host", "$http_referer", "$bytes_sent", "$remote_user"], len(pieces) + 1)
        body = "".join(n + p for n, p in zip(names, pieces)) + (names[-1] if rng.random() < 0.5 else "")
        formats.append(compile_format("nginx", f"f{i:02d}", rng.choice(["", "", "<"]) + body))
    slots = list(dict.fromkeys(s for f in formats for s in f.slots))
    trie = FormatTrie(formats, slots)
    for _ in range(3000):
        line = "".join(rng.choices(["a", "1", " ", "-", "|", "[", "]", '"', "x", "y", "<", "12", "é"], k=rng.randint(0, 25)))
        tried = next((n for n, p, _ in trie.known if p.match(line)), None)
        assert trie.read(line)[0] == tried, line
