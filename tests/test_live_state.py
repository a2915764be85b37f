"""Streams that keep bounded state: resent envelopes, open minutes, rankings."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from accessloom.operators.parse import good_rows, parse_lines, rejected_rows
from accessloom.sources.formats import discover_nginx_formats, load_formats
from accessloom.sources.lines import (
    App, drop_resent, follow_apps, formats_in, from_envelopes, read_queue, start_queueing, to_envelopes,
)
from accessloom.streaming import live
from accessloom.streaming.ingest import parse_envelopes
from fixtures import rendered as fx

FMT = fx.format_named("combined_plus")
ROWS = "event_time timestamp, ip string, request_url string"


def write(folder, name, values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(v + "\n" for v in values))


def envelope(key, line="x"):
    return json.dumps({"line": line, **({"sent_key": key} if key else {})})


def run(stream, tmp_path, mode="append"):
    """Handle what is there; the rows of each new batch and the query's progress."""
    got = []
    query = (stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: got.append(df.collect()))
             .option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start())
    query.awaitTermination()
    return got, query


def test_resent_envelopes_count_once(spark, tmp_path):
    folder = tmp_path / "queue"

    def once():
        return drop_resent(read_queue(spark, "text", path=str(folder)), within="3 seconds")

    write(folder, "a", [envelope(f"k{i}") for i in range(50)] * 2 + [envelope(None)] * 4 + ["no json"])
    got, _ = run(once(), tmp_path)
    assert sum(map(len, got)) == 50 + 4 + 1
    write(folder, "b", [envelope(f"k{i}") for i in range(60)])  # the batch again, and ten more
    got, query = run(once(), tmp_path)
    assert sorted(json.loads(r.value)["sent_key"] for b in got for r in b) == sorted(f"k{i}" for i in range(50, 60))
    time.sleep(7)
    write(folder, "c", [envelope("late")])
    run(once(), tmp_path)
    time.sleep(1)
    write(folder, "d", [envelope("later")])
    _, query = run(once(), tmp_path)
    assert sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p.stateOperators) <= 2


def test_resent_envelopes_of_a_table(spark):
    queue = spark.createDataFrame([(envelope("a"),), (envelope("a"),), (envelope(None),), (envelope(None),)], "value string")
    assert drop_resent(queue).count() == 3


def test_followed_lines_have_keys(spark, tmp_path):
    """From a growing file to a queue, sent twice, received once."""
    lines = [r.value for r in fx.rendered(fx.events(spark, "/root/testdata/sf0.001")).limit(40).collect()]
    write(tmp_path / "log", "access.log", lines + lines)  # equal lines are lines of their own
    for turn in ("one", "two"):  # a sender that lost its checkpoint
        tagged = follow_apps(spark, [App("www", [str(tmp_path / "log")], FMT.name, "n1")])
        start_queueing(to_envelopes(tagged, [FMT]), "text", str(tmp_path / turn), every=None,
                       path=str(tmp_path / f"queue_{turn}")).awaitTermination()
    queue = read_queue(spark, "text", path=str(tmp_path / "queue_*"))
    assert spark.read.text(str(tmp_path / "queue_*")).count() == 160
    got, _ = run(parse_envelopes(drop_resent(queue), [FMT]), tmp_path)
    rows = [r for b in got for r in b]
    assert len(rows) == 80 and all(r.parse_ok for r in rows)


def test_consumed_files_expire(spark, tmp_path):
    folder = tmp_path / "queue"
    for i in range(4):
        write(folder, f"f{i}", [envelope(f"{i}")])
        run(read_queue(spark, "text", path=str(folder), cleanSource="delete", maxFilesPerTrigger=1), tmp_path)
    left = [f for f in folder.iterdir() if not f.name.startswith(".")]
    assert len(left) < 4


def test_formats_of_envelopes(spark):
    """Texts that can't be compiled, and too many of them, cost their own lines only."""
    good, line = FMT.format_str, fx.rendered(fx.events(spark, "/root/testdata/sf0.001")).first().value
    rows = [("a", good, line)] * 3 + [("b", "$no_such_variable", line), ("c", "nothing", line), ("d", None, line)]
    rows += [(f"e{i}", f"$remote_addr {i}", "1.2.3.4 0") for i in range(5)]
    queue = spark.createDataFrame([
        (json.dumps({"log_format_name": n, "log_format_str": t, "line": x}),) for n, t, x in rows], "value string")
    found = formats_in(from_envelopes(queue), "nginx", most=3)
    assert [f.name for f in found] == ["a"]  # the bad ones come next by name
    assert len(formats_in(from_envelopes(queue), "nginx")) == 6
    parsed = parse_envelopes(queue, found)
    assert good_rows(parsed).count() == 3
    lost = rejected_rows(parsed).collect()
    assert len(lost) == len(rows) - 3 and {r.reason for r in lost} == {"unknown format"}
    assert {r.log_format_str for r in lost} >= {"$no_such_variable", "nothing"}


def test_two_hosts_may_use_one_name(spark):
    confs = spark.createDataFrame([
        ("/a", "log_format main '$remote_addr x'; log_format main '$remote_addr y';"),
        ("/b", "log_format main '$msec'; log_format defualt '$status';"), ("/c", None)], "path string, content string")
    found = discover_nginx_formats(confs)
    assert {(r.path, r.name, r.format_str) for r in found.collect() if r.path} == {
        ("/a", "main", "$remote_addr y"), ("/b", "main", "$msec"), ("/b", "defualt", "$status")}
    assert {f.name: f.format_str for f in load_formats(found, "/b")} == {"main": "$msec", "defualt": "$status"}
    assert len({f.name: f.format_str for f in load_formats(found, "/a")}["defualt"]) > 20
    with pytest.raises(ValueError):
        load_formats(found)


def stream_of(spark, tmp_path, **options):
    return spark.readStream.schema(ROWS).options(**options).json(str(tmp_path / "rows"))


def rows_of_minute(rng, minute, n):
    at = f"2024-01-15 12:{minute:02d}:{rng.randrange(60):02d}"
    return [json.dumps({"event_time": at, "ip": rng.choice(["a", "b", None, f"i{rng.randrange(30)}"]),
                        "request_url": f"/{rng.randrange(5)}"}) for _ in range(n)]


def test_running_visitors_equal_batch_after_each_step(spark, tmp_path):
    rng, folder = random.Random(3), tmp_path / "rows"
    seen = {}
    for step in range(4):
        write(folder, f"{step}", [r for m in (step, step + 1, 5) for r in rows_of_minute(rng, m, 40)])
        got, query = run(live.live_ip_pv_by_minute_running(stream_of(spark, tmp_path)), tmp_path, "update")
        for batch in got:
            seen.update({r.time_str: (r.ip_num, r.pv_num) for r in batch})
        table = spark.read.schema(ROWS).json(str(folder))
        want = table.groupBy(F.window("event_time", "1 minute").alias("w")).agg(
            F.count_distinct("ip"), F.count("*")).select(F.col("w.start").cast("long"), "count(DISTINCT ip)", "count(1)")
        assert seen == {r[0]: (r[1], r[2]) for r in want.collect()}
    write(folder, "later", ['{"event_time": "2024-01-15 13:00:00", "ip": "z", "request_url": "/"}'])
    run(live.live_ip_pv_by_minute_running(stream_of(spark, tmp_path)), tmp_path, "update")
    write(folder, "latest", ['{"event_time": "2024-01-15 13:00:10", "ip": "z", "request_url": "/"}'])
    _, query = run(live.live_ip_pv_by_minute_running(stream_of(spark, tmp_path)), tmp_path, "update")
    assert sum(s["numRowsTotal"] for s in query.recentProgress[-1].stateOperators) <= 2  # closed minutes are gone


@pytest.mark.parametrize("shape", ["skewed", "flat", "few"])
def test_rankings_with_bounded_state(spark, tmp_path, shape):
    rng, folder = random.Random(5), tmp_path / "rows"
    pick = {"skewed": lambda: int(rng.paretovariate(0.8)) % 100_000, "flat": lambda: rng.randrange(20_000),
            "few": lambda: rng.randrange(50)}[shape]
    true = Counter()
    for step in range(3):
        urls = [f"/{pick()}" for _ in range(8_000)]
        true.update(urls)
        write(folder, f"{step}", [json.dumps({"event_time": "2024-01-15 12:00:00", "request_url": u}) for u in urls])
    stream = stream_of(spark, tmp_path, maxFilesPerTrigger=1)
    got, query = run(live.live_top(stream, "request_url", 10, tracked=700), tmp_path, "update")
    top, error = got[-1], got[-1][0].error if got[-1] else int(24_000 * 3.5 / 1024)
    assert error <= 24_000 * 3.5 / 1024
    for r in top:
        assert true[r.request_url] <= r.total_num <= true[r.request_url] + error
    assert {u for u, n in true.most_common(10) if n > 2 * error + max([true[u] for u, _ in true.most_common(11)][10:])} <= {
        r.request_url for r in top}
    if shape == "few":
        assert sorted((r.total_num for r in top), reverse=True) == [n for _, n in true.most_common(10)]
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 1
    assert query.recentProgress[-1].stateOperators[0].memoryUsedBytes < 2_000_000


def test_ranking_refused(spark):
    with pytest.raises(ValueError):
        live.live_top(spark.createDataFrame([], ROWS), "ip", 10, tracked=5)
