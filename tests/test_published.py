"""Rewriting a table: readers see old or new, rows are neither lost nor doubled."""

import glob
import json
import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from accessloom.operators.parse import parse_lines
from accessloom.sources import published as pb
from accessloom.sources.formats import compile_format
from accessloom.sources.lines import App, stream_apps
from accessloom.sources.tables import read_access, read_rejected, write_access
from accessloom.streaming.ingest import parse_envelopes, parse_stream, start_ingest
from fixtures import rendered as fx

FMT = fx.format_named("combined_plus")
SF = "/root/testdata/sf0.001"


def plain(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


KEY = ("timestamp", "ip", "bytes_sent", "ua", "request_url")


@pytest.fixture
def streamed(spark, tmp_path):
    """A table written by a stream in many small files."""
    def feed(parts):
        (tmp_path / "log").mkdir(exist_ok=True)
        for i in parts:
            rows = fx.rendered(fx.events(spark, SF).filter(F.col("event_id") % 8 == i)).collect()
            (tmp_path / "log" / f"f{i}").write_text("".join(r.value + "\n" for r in rows) + f"junk {i}\n")
        lines = stream_apps(spark, [App("www", [str(tmp_path / "log")], FMT.name, "n1")], max_files_per_trigger=1)
        start_ingest(parse_stream(lines, [FMT]), str(tmp_path / "t"), str(tmp_path / "o"), split_save="month",
                     every=None).awaitTermination()

    feed(range(5))
    return str(tmp_path / "t"), feed


def test_compaction_of_stream_output(spark, streamed):
    table, feed = streamed
    before = plain(read_access(spark, table), *KEY)
    assert plain(pb.read_published(spark, table), *KEY) == before
    many = pb.live_files(spark, table).count()
    assert pb.compact(spark, table) == 1
    files = pb.live_files(spark, table)
    assert files.count() <= 4 < many and files.filter("not rewritten").count() <= 2
    assert plain(pb.read_published(spark, table), *KEY) == before
    assert pb.read_published(spark, table, outcome="rejected").count() == 5
    assert pb.compact(spark, table) == 1  # nothing to gather
    feed([5, 6])  # the stream goes on
    now = plain(read_access(spark, table), *KEY)
    assert len(now) > len(before) and plain(pb.read_published(spark, table), *KEY) == now
    assert pb.compact(spark, table) == 2
    assert plain(pb.read_published(spark, table), *KEY) == now
    month = pb.read_published(spark, table, split_save="month", first="2024-01-10")
    assert plain(month, *KEY) == plain(read_access(spark, table, split_save="month", first="2024-01-10"), *KEY)


def test_compacted_files_follow_each_other(spark, streamed):
    table, _ = streamed
    pb.compact(spark, table, target_bytes=30_000)
    spans = []
    for f in glob.glob(f"{table}/_rewritten/*/outcome=parsed/**/*.parquet", recursive=True):
        times = pq.read_table(f, columns=["timestamp"]).column(0).to_pylist()
        assert times == sorted(times)
        spans.append((f.split("/")[-2], times[0], times[-1]))
    spans.sort()
    assert len(spans) > 2, spans
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])


def test_compacted_files_hold_so_many_rows_at_most(spark, streamed, monkeypatch):
    table, feed = streamed
    monkeypatch.setattr(pb, "MOST_ROWS", 250)
    before = plain(read_access(spark, table), *KEY)

    def held():
        files = glob.glob(f"{table}/_rewritten/*/outcome=parsed/**/*.parquet", recursive=True)
        return {f: pq.read_metadata(f).num_rows for f in files}

    assert len(before) > 500 and pb.compact(spark, table) == 1
    first = held()
    assert sum(first.values()) == len(before) and max(first.values()) < 2 * 250
    assert plain(pb.read_published(spark, table), *KEY) == before
    assert pb.compact(spark, table) == 1  # they are full
    feed([5, 6, 7])
    pb.compact(spark, table)
    live = {r.file.split("/")[-1] for r in pb.live_files(spark, table).filter("rewritten").collect()}
    assert {f.split("/")[-1] for f, n in first.items() if n >= 125} <= live
    assert plain(pb.read_published(spark, table), *KEY) == plain(read_access(spark, table), *KEY)


def test_clustered_files_hold_so_many_rows_at_most(spark, streamed, monkeypatch):
    table, _ = streamed
    monkeypatch.setattr(pb, "MOST_ROWS", 250)
    before = plain(read_access(spark, table), *KEY)
    pb.cluster(spark, table, periods=["2024_01"])
    files = glob.glob(f"{table}/_rewritten/*/outcome=parsed/**/*.parquet", recursive=True)
    rows = [pq.read_metadata(f).num_rows for f in files]
    assert sum(rows) == len(before) and max(rows) < 2 * 250
    assert plain(pb.read_published(spark, table), *KEY) == before


def test_readers_see_old_or_new(spark, streamed, monkeypatch):
    """Reads all through a rewrite, and after one that dies before it is published."""
    table, _ = streamed
    want, seen, stop = read_access(spark, table).count(), [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append(pb.read_published(spark, table).count())

    reader = threading.Thread(target=watch)
    reader.start()
    try:
        pb.compact(spark, table)
    finally:
        stop.set()
        reader.join()
    assert set(seen) == {want}

    def dies(*_):
        raise RuntimeError("lost")

    for _ in range(3):
        write_access(parse_lines(fx.rendered(fx.events(spark, SF).limit(30)), FMT), f"{table}x", split_save="year")
    monkeypatch.setattr(pb, "_publish", dies)
    with pytest.raises(RuntimeError):
        pb.compact(spark, f"{table}x")
    monkeypatch.undo()
    assert pb.read_published(spark, f"{table}x").count() == 90
    assert pb.compact(spark, f"{table}x") == 1 and pb.read_published(spark, f"{table}x").count() == 90


def test_replay_of_rejects(spark, tmp_path, monkeypatch):
    table, iso = str(tmp_path / "t"), fx.format_named("iso_timed")
    events = fx.events(spark, SF).limit(200)
    lines = fx.rendered(events).unionByName(fx.rendered(events, "iso_timed")).unionByName(
        spark.createDataFrame([("junk",)] * 3, "value string"))
    write_access(parse_lines(lines, FMT), table)
    assert read_rejected(spark, table).count() == 203

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(pb, "_publish", dies)
    with pytest.raises(RuntimeError):
        pb.replay_rejects(spark, table, [iso])
    monkeypatch.undo()
    assert pb.read_published(spark, table).count() == 200  # nothing moved yet
    assert pb.replay_rejects(spark, table, [iso]) == 1
    rows = pb.read_published(spark, table)
    assert rows.count() == 400 and rows.filter("host = 'shop.example.com'").count() == 200
    assert [r.line for r in pb.read_published(spark, table, outcome="rejected").collect()] == ["junk"] * 3
    pb.replay_rejects(spark, table, [iso])
    assert pb.read_published(spark, table).count() == 400


def test_replay_of_envelopes(spark, tmp_path):
    """A format that wasn't known at first, and what is no envelope at all."""
    table = str(tmp_path / "t")
    texts = {"a": FMT.format_str, "b": "$remote_addr|$status|$msec"}
    values = [json.dumps({"line": "1.2.3.4|200|1.5", "log_format_name": "x", "log_format_str": texts["b"]})] * 4
    line = fx.rendered(fx.events(spark, SF)).first().value
    values += [json.dumps({"line": line, "log_format_name": "x", "log_format_str": texts["a"]}), "no envelope"]
    queue = spark.createDataFrame([(v,) for v in values], "value string")
    write_access(parse_envelopes(queue, [FMT]), table)
    late = compile_format("nginx", "x", texts["b"])
    pb.replay_rejects(spark, table, [late], format_column="log_format_str")
    rows = pb.read_published(spark, table)
    assert rows.count() == 5 and rows.filter("ip = '1.2.3.4' AND status_code = 200").count() == 4
    left = pb.read_published(spark, table, outcome="rejected").collect()
    assert [(r.line, r.reason) for r in left] == [("no envelope", "bad envelope")]


def scanned(df):
    """Rows that the scans of a query handed on."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        if name.startswith("Scan parquet"):
            out += p.metrics().apply("numOutputRows").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_look_ups_read_few_row_groups(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = parse_lines(fx.rendered(fx.events(spark, "/root/testdata/sf0.1")), FMT)
    write_access(rows, table, split_save="year")
    want = read_access(spark, table).filter("ip = '10.0.0.56'")
    before, total = plain(want, *KEY), read_access(spark, table).count()
    pb.cluster(spark, table, periods=["2024"], target_bytes=400_000, addresses=500,
               options={"parquet.block.size": "40000"})
    got = pb.read_published(spark, table)
    assert got.count() == total
    one = got.filter("ip = '10.0.0.56'")
    assert plain(one, *KEY) == before
    assert scanned(one.select("ip", "bytes_sent")) < total / 8
    assert scanned(got.filter("status_code = 500").select("status_code", "ua")) < total / 2
    assert scanned(got.filter("ip = '10.0.0.57'").select("ip", "ua")) < total / 8  # inside the range, never seen


def test_interleaved_bits(spark):
    df = spark.createDataFrame([(0b101, 0b011)], "a long, b long")
    assert df.select(pb.interleaved([F.col("a"), F.col("b")], 3)).first()[0] == 0b100111
