import pytest
from pyspark.sql import functions as F

from accessloom.operators.parse import column_widths, good_rows, parse_lines, rejected_rows
from accessloom.sources.formats import compile_format
from accessloom.sources.lines import App, formats_in, from_envelopes, read_apps, to_envelopes
from accessloom.streaming.ingest import parse_envelopes, parse_stream
from accessloom.sources.variables import NGINX
from fixtures import rendered as fx

LINE = '1.2.3.4 - bob [11/Sep/2020:15:20:43 +0800] "GET /a?x=1 HTTP/1.1" 200 12 "-" "ua" 1 2'
PLUS = compile_format("nginx", "plus", fx.COMBINED_PLUS)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_row(spark):
    row = good_rows(parse_lines(lines(spark, "  " + LINE + "\t"), PLUS)).first().asDict()
    assert row.pop("event_time").isoformat() == "2020-09-11T15:20:43"
    assert row == {
        "ip": "1.2.3.4", "remote_user": "bob", "time_str": "2020-09-11 15:20:43", "timestamp": 1599837643,
        "request_method": "GET", "request_url": "/a", "args": "x=1", "server_protocol": "HTTP/1.1",
        "status_code": 200, "body_bytes_sent": 12, "http_referer": "-", "ua": "ua", "request_length": 1,
        "bytes_sent": 2, "isp": "0", "city": "0", "city_id": 0, "province": "0", "country": "0",
    }


def test_column_types(spark):
    text = "$msec $request_time $connection $upstream_response_time $status $time_iso8601 $body_bytes_sent x"
    parsed = good_rows(parse_lines(lines(spark, ""), compile_format("nginx", "f", text)))
    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema.fields}
    assert kinds == {
        "msec": "decimal(16,3)", "request_time": "double", "connection": "bigint",
        "upstream_response_time": "string", "status_code": "int", "time_str": "string",
        "timestamp": "bigint", "event_time": "timestamp", "body_bytes_sent": "bigint",
    }


def test_rejects_are_kept_whole(spark):
    bad_time = LINE.replace("Sep", "Foo")
    values = [LINE, "", "junk", "a\nb", LINE + "\n" + LINE, bad_time, LINE[:-2]]
    parsed = parse_lines(lines(spark, *values).withColumn("node_id", F.lit("n")), PLUS)
    got = {r.line: r.reason for r in rejected_rows(parsed).collect()}
    assert got == {
        "": "format mismatch", "junk": "format mismatch", "a\nb": "format mismatch",
        bad_time: "unreadable time", LINE[:-2]: "format mismatch",
    }
    assert rejected_rows(parsed).columns == ["node_id", "line", "reason"]
    assert good_rows(parsed).count() == 2     # text after the last number is ignored


def test_missing_line(spark):
    row = parse_lines(spark.createDataFrame([(None,)], "value string"), PLUS).first()
    assert (row.parse_ok, row.reject_reason, row.rejected_line) == (False, "format mismatch", None)


def test_wide_format(spark):
    names = [n for n in NGINX.variables if n != "$time_iso8601"]
    fmt = compile_format("nginx", "wide", " | ".join(names))
    values = {"$time_local": "11/Sep/2020:15:20:43 +0800", "$request": "GET /r HTTP/1.0", "$request_uri": "/u"}
    line = " | ".join(values.get(n, str(i)) for i, n in enumerate(names))
    row = good_rows(parse_lines(lines(spark, line), fmt)).first().asDict()
    # Without request and time, and with args, three times and five places.
    assert len(row) == len(fmt.variables) - 2 + 1 + 3 + 5
    for i, (name, var) in enumerate(zip(names, fmt.variables)):
        if name not in values and var.column in row and var.kind == "string":
            assert row[var.column] in (str(i), "0")
    assert (row["request_url"], row["status_code"], row["timestamp"]) == (
        "/u", names.index("$status"), 1599837643)


def test_line_of_as_many_pieces_as_fields_is_no_match(spark):
    fmt = compile_format("nginx", "f", "[$host] [$scheme]")
    parsed = parse_lines(lines(spark, "a\nb\nc", "[a] [b]", "\n[a] [b]"), fmt)
    assert [r.parse_ok for r in parsed.collect()] == [False, True, True]


def test_normalising_is_a_switch(spark):
    empty = '1.2.3.4 -  [11/Sep/2020:15:20:43 +0800] "" 200  "" "" 1 '
    on = parse_lines(lines(spark, empty), compile_format("nginx", "f", fx.COMBINED_PLUS)).first()
    # The line's end is trimmed, so the last literal is missing: no match.
    assert not on.parse_ok
    fmt = compile_format("nginx", "f", '$remote_user|$request|$status|$bytes_sent|$http_referer|')
    row = parse_lines(lines(spark, "|||||"), fmt).first()
    assert (row.remote_user, row.request_method, row.request_url, row.status_code, row.bytes_sent) == ("-", "-", "-", 0, 0)
    row = parse_lines(lines(spark, "|||||"), fmt, normalise=False).first()
    assert (row.remote_user, row.request_method, row.request_url, row.status_code, row.bytes_sent) == ("", "", "", None, None)


def test_later_variable_wins(spark):
    for text, url in [("$request|$request_uri|", "/u?q"), ("$request_uri|$request|", "/r")]:
        value = "GET /r HTTP/1.1|/u?q|" if text.startswith("$request|") else "/u?q|GET /r HTTP/1.1|"
        assert parse_lines(lines(spark, value), compile_format("nginx", "f", text)).first().request_url == url


def test_apache_row(spark):
    fmt = compile_format("apache", "f", '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i" %I %O %D')
    value = '::1 - frank [10/Oct/2000:13:55:36 -0700] "GET /x HTTP/1.0" 200 - "http://r" "Moz" 5 6 77'
    row = good_rows(parse_lines(lines(spark, value), fmt)).first()
    assert (row.ip, row.remote_logname, row.remote_user, row.timestamp, row.request_url) == (
        "::1", "-", "frank", 971186136, "/x")
    assert (row.status_code, row.bytes_sent, row.referer, row.ua) == (200, 0, "http://r", "Moz")
    assert (row.bytes_received, row.bytes_sent_with_header, row.request_time) == (5, 6, 77.0)


def test_mixed_server_types_in_one_pass(spark):
    apache = compile_format("apache", "ap", '%h %t "%>s"')
    nginx = compile_format("nginx", "ng", "$remote_addr|$time_iso8601|$host")
    bare = compile_format("nginx", "bare", "$host $status")
    rows = spark.createDataFrame(
        [("ap", "1.1.1.1 [10/Oct/2000:13:55:36 -0700] \"404\""), ("ng", "2.2.2.2|2000-10-10T13:55:36+08:00|h"),
         ("bare", "h 200"), ("ap", "2.2.2.2|2000-10-10T13:55:36+08:00|h"), ("other", "x"), (None, "y")],
        "log_format_name string, value string",
    )
    parsed = parse_stream(rows, [apache, nginx, bare]).collect()
    assert [r.reject_reason for r in parsed] == [
        None, None, None, "format mismatch", "unknown format", "unknown format"]
    assert [(r.ip, r.timestamp, r.status_code, r.host) for r in parsed[:3]] == [
        ("1.1.1.1", 971186136, 404, None), ("2.2.2.2", 971186136, None, "h"), (None, None, 200, "h")]
    with pytest.raises(ValueError):
        parse_lines(rows, [apache, nginx])
    with pytest.raises(ValueError):
        parse_lines(rows, [apache, apache], format_column="log_format_name")


def test_regex_runs_once(spark, capsys):
    parsed = good_rows(parse_lines(spark.read.text("/root/repo/README.md"), PLUS))
    parsed.filter("status_code = 200").groupBy("request_url").count().explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(__line") == 1
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_apps_and_envelopes(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(LINE + "\n" + "junk\n")
    apps = [App("inputer.log_file.shop", [str(tmp_path / "a")], "plus", "n1"),
            App("blog", [str(tmp_path / "b")], "plus", "n1")]
    tagged = read_apps(spark, apps)
    assert {r.app_name for r in tagged.collect()} == {"shop", "blog"}
    queue = to_envelopes(tagged, [PLUS])
    decoded = from_envelopes(queue)
    first = decoded.filter("app_name = 'shop'").first()
    assert first.log_format_str == fx.COMBINED_PLUS and first.log_format_vars.split("<@>")[0] == "$remote_addr"
    parsed = parse_envelopes(queue, formats_in(decoded, "nginx"))
    assert good_rows(parsed).count() == 2
    assert sorted(tuple(r) for r in rejected_rows(parsed).collect()) == [
        ("n1", app, "plus", fx.COMBINED_PLUS, "junk", "format mismatch") for app in ("blog", "shop")]
    with pytest.raises(ValueError):
        read_apps(spark, [])


def test_envelope_formats_go_by_text(spark):
    def envelope(app, name, text, line):
        return (f'{{"node_id":"n","app_name":"{app}","log_format_name":"{name}",'
                f'"line":"{line}","log_format_str":"{text}","log_format_vars":""}}',)

    queue = spark.createDataFrame(
        [envelope("a", "main", "$host $status", "h 200"), envelope("b", "main", " $status|$host", "404|g"),
         envelope("c", "other", "%h %>s", "1.2.3.4 500"), envelope("d", "new", "$host", "x")], "value string")
    decoded = from_envelopes(queue.filter("value not like '%new%'"))
    formats = formats_in(decoded, lambda name: "apache" if name == "other" else "nginx")
    rows = {r.app_name: r for r in parse_envelopes(queue, formats).collect()}
    assert [(rows[a].host, rows[a].ip, rows[a].status_code) for a in "abc"] == [
        ("h", None, 200), ("g", None, 404), (None, "1.2.3.4", 500)]
    assert rows["d"].reject_reason == "unknown format" and rows["d"].rejected_line == "x"
    assert "__format" not in rows["a"].asDict()


def test_bad_envelopes_keep_their_text(spark):
    queue = spark.createDataFrame([("not json",), ('{"node_id":"n"}',), ("",), (None,)], "value string")
    rejected = rejected_rows(parse_envelopes(queue, [PLUS])).collect()
    assert {r.reason for r in rejected} == {"bad envelope"}
    assert sorted(r.line for r in rejected) == ["", "", "not json", '{"node_id":"n"}']


def test_column_widths(spark):
    rows = spark.createDataFrame([("a", "bbb", 1), (None, "b", 2)], "x string, y string, z int")
    assert column_widths(rows).first().asDict() == {"x": 1, "y": 3}
