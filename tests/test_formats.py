import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accessloom.operators.parse import parse_lines
from accessloom.sources.formats import (
    builtin_formats, compile_format, discover_apache_formats, discover_nginx_formats, load_formats,
    read_server_confs,
)
from accessloom.sources.variables import ServerType, Variable, register_server_type
from fixtures.rendered import COMBINED_PLUS, COMBINEDIO

FORMATS = [
    ("nginx", COMBINED_PLUS),
    ("apache", COMBINEDIO),
    ("nginx", '$remote_addr $status "$request" $bytes_sent-$request_length "$http_referer" x'),
    ("nginx", '[$http_host] $status$host [$scheme]'),
    ("apache", 'a%hBc%uB%l a b'),
]


def lazy(fmt):
    """The format as an unanchored lazy match, the last variable taking the rest."""
    out = ""
    tokens = list(re.finditer(r"\$\w+|%(?:\{[\w-]+\}|[<>])?[A-Za-z]", fmt.format_str))
    end = 0
    for m, var in zip(tokens, fmt.variables):
        out += re.escape(fmt.format_str[end:m.start()])
        out += {"any": r"([\s\S]*?)", "digits": r"(\d*?)", "digits+": r"(\d+?)"}[var.capture]
        end = m.end()
    tail = fmt.format_str[end:]
    if not tail:
        out = out[:-2] + ")"     # greedy
    return re.compile(out + re.escape(tail), re.I)


def pieces(fmt):
    literals = re.split(r"\$\w+|%(?:\{[\w-]+\}|[<>])?[A-Za-z]", fmt.format_str)
    fragments = {c for text in literals for c in (text, text[:1], text[1:], text[-1:])}
    return st.sampled_from(sorted(fragments | {"", "1", "23", "a", "B", " ", '"', "]", "x y"}))


@pytest.mark.parametrize("server,text", FORMATS)
def test_matches_like_lazy_regex(server, text):
    fmt = compile_format(server, "f", text)
    ours, theirs = re.compile(fmt.regex), lazy(fmt)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(pieces(fmt), max_size=30).map("".join))
    def check(line):
        a, b = ours.match(line), theirs.match(line)
        assert (a is None) == (b is None)
        if a:
            assert a.groups() == b.groups()

    check()

    @settings(max_examples=300, deadline=None)
    @given(st.data())
    def check_full(data):
        line = ""
        for literal in re.split(r"\$\w+|%(?:\{[\w-]+\}|[<>])?[A-Za-z]", text):
            line += literal + data.draw(pieces(fmt)) + data.draw(pieces(fmt))
        check_one(line)

    def check_one(line):
        a, b = ours.match(line), theirs.match(line)
        assert (a is None) == (b is None)
        if a:
            assert a.groups() == b.groups()

    check_full()


def test_spark_agrees_with_python(spark):
    fmt = compile_format("nginx", "f", COMBINED_PLUS)
    base = '1.2.3.4 - - [11/Sep/2020:15:20:43 +0800] "GET /a HTTP/1.1" 200 12 "-" "ua" 1 2'
    lines = [base] + [base[:i] + extra + base[i:] for i in range(len(base)) for extra in ('"', " ", '" 5 6 "', "]")]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select(
        "value", F.split(F.regexp_replace("value", F.lit(fmt.regex), F.lit(fmt.replacement())), "\n").alias("f")
    ).collect()
    for row in rows:
        m = lazy(fmt).match(row.value)
        assert row.f == ([""] + list(m.groups()) if m else [row.value])


def test_empty_tail():
    text = '$status "$http_user_agent" $bytes_sent'
    assert re.match(compile_format("nginx", "f", text).regex, '200 "x" 55').groups() == ("200", "x", "55")
    short = compile_format("nginx", "f", text, empty_tail=True)
    assert re.match(short.regex, '200 "x" 55').groups() == ("200", "x", "")
    free = compile_format("nginx", "f", "$status $host", empty_tail=True)
    assert re.match(free.regex, "200 abc").groups() == ("200", "")


def test_adjacent_variables():
    fmt = compile_format("nginx", "f", "$remote_user$host-$status")
    assert re.match(fmt.regex, "ab-1").groups() == ("", "ab", "1")


def test_unknown_variable_and_server():
    with pytest.raises(ValueError, match="pipe"):
        compile_format("nginx", "f", "$pipe $status")
    with pytest.raises(ValueError, match="server type"):
        compile_format("iis", "f", "$status")
    with pytest.raises(ValueError, match="no variable"):
        compile_format("nginx", "f", "plain")


def test_header_names_ignore_case():
    fmt = compile_format("apache", "f", '%h "%{User-agent}i"')
    assert [v.column for v in fmt.variables] == ["ip", "ua"]
    with pytest.raises(ValueError):
        compile_format("apache", "f", "%H")


def test_builtin_format():
    (fmt,) = builtin_formats("nginx")
    assert fmt.name == "defualt" and len(fmt.variables) == 8
    assert builtin_formats("apache") == []


def test_hostile_lines_take_linear_time(spark):
    fmt = compile_format("nginx", "f", COMBINED_PLUS)
    hostile = [' - [] "" ' * 20000, '1 - - [x] "' + '" 1 ' * 50000, '1 - - [x] "' + '" 1 1 ' * 50000,
               "- " * 100000, '1 - - [x] "' + '"' * 200000, '1 - - [' + '] ' * 100000]
    long = f'1.2.3.4 - - [11/Sep/2020:15:20:43 +0800] "GET /{"a" * 180000} HTTP/1.1" 200 12 "-" "ua" 1 2'
    quotes = f'1.2.3.4 - - [11/Sep/2020:15:20:43 +0800] "GET /{chr(34) * 180000} HTTP/1.1" 200 12 "-" "ua" 1 2'
    lines = spark.createDataFrame([(x,) for x in hostile + [long, quotes]], "value string").repartition(1)
    start = time.time()
    rows = parse_lines(lines, fmt).collect()
    assert time.time() - start < 20
    assert sum(r.parse_ok for r in rows) == 2
    # Trailing double quotes are stripped from stored text.
    assert {len(r.request_url) for r in rows if r.parse_ok} == {180001, 1}


def test_discovery_from_files(spark, tmp_path):
    (tmp_path / "nginx.conf").write_text(
        "http {\n log_format main '$remote_addr [$time_local] \"$request\" '\n"
        "                 '$status';\nlog_format none 'nothing';\n"
        " log_format\tshort   '$remote_addr $msec' ;\n}\n"
    )
    found = discover_nginx_formats(read_server_confs(spark, str(tmp_path / "nginx.conf")))
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"defualt", "main", "short"}
    assert rows["main"].format_str == '$remote_addr [$time_local] "$request" $status'
    assert rows["short"].vars == ["$remote_addr", "$msec"]
    assert {f.name for f in load_formats(found)} == set(rows)

    (tmp_path / "httpd.conf").write_text(
        'LogFormat "%h %l %u %t \\"%r\\" %>s %b" common\n# x\nLogFormat "%h" one'
    )
    found = discover_apache_formats(read_server_confs(spark, str(tmp_path / "httpd.conf")))
    rows = {r.name: r.format_str for r in found.collect()}
    assert rows == {"common": '%h %l %u %t "%r" %>s %b', "one": "%h"}


def test_registered_server_type(spark):
    register_server_type(
        ServerType("proxy", r"<\w+>", {"<who>": Variable("ip"), "<ms>": Variable("ms", "digits", "int")})
    )
    fmt = compile_format("proxy", "p", "<who> took <ms>ms")
    row = parse_lines(spark.createDataFrame([("me took 12ms",)], "value string"), fmt).first()
    assert (row.ip, row.ms, row.parse_ok) == ("me", 12, True)
