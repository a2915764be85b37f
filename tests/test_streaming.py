import pytest
from pyspark.sql import functions as F

from accessloom.operators.parse import good_rows, parse_lines
from accessloom.plans import traffic
from accessloom.sources.formats import compile_format
from accessloom.sources.lines import App, read_queue, start_queueing, stream_apps, to_envelopes
from accessloom.sources.tables import read_access, read_rejected
from accessloom.streaming import live
from accessloom.streaming.ingest import (
    parse_envelopes, parse_stream, skip_existing, start_batches, start_ingest, write_numbered,
)
from accessloom.streaming.panels import panel_step, refresh_panels
from fixtures import rendered as fx

FMT = fx.format_named("combined_plus")


@pytest.fixture
def site(spark, tmp_path):
    """Ten files of rendered lines and some junk, and a way to add more."""
    def write(name, df):
        (tmp_path / "log").mkdir(exist_ok=True)
        text = "".join(r.value + "\n" for r in df.collect())
        (tmp_path / "log" / name).write_text(text + "junk " + name + "\n")

    events = fx.events(spark, "/root/testdata/sf0.001")
    for i in range(5):
        write(f"old{i}", fx.rendered(events.filter(F.col("event_id") % 10 == i)))

    class Site:
        path = tmp_path
        apps = [App("www", [str(tmp_path / "log")], FMT.name, "n1")]

        @staticmethod
        def add(i):
            write(f"new{i}", fx.rendered(events.filter(F.col("event_id") % 10 == i)))

        @staticmethod
        def stream():
            return parse_stream(stream_apps(spark, Site.apps, max_files_per_trigger=2), [FMT])

    return Site


def test_ingest_continues_where_it_stopped(spark, site):
    table, offsets = str(site.path / "t"), str(site.path / "o")
    start_ingest(site.stream(), table, offsets, every=None).awaitTermination()
    assert read_access(spark, table).count() == 500
    site.add(5)
    start_ingest(site.stream(), table, offsets, every=None).awaitTermination()
    rows = read_access(spark, table)
    assert rows.count() == 600 and rows.select("event_time", "ip", "bytes_sent", "ua").distinct().count() == 600
    assert read_rejected(spark, table).count() == 6
    batch = good_rows(parse_lines(spark.read.text(str(site.path / "log")), FMT))
    day = "2024-01-15"
    assert traffic.request_num_by_url(rows, day).collect() == traffic.request_num_by_url(batch, day).collect()


def test_tail_starts_at_the_end(spark, site):
    table, offsets = str(site.path / "t"), str(site.path / "o")
    start_ingest(site.stream(), table, offsets, position="tail", every=None).awaitTermination()
    site.add(7)
    start_ingest(site.stream(), table, offsets, every=None).awaitTermination()
    rows = read_access(spark, table)
    assert rows.count() == 100
    assert read_rejected(spark, table).first().line == "junk new7"
    site.add(8)
    skip_existing(site.stream(), table, offsets)
    start_ingest(site.stream(), table, offsets, every=None).awaitTermination()
    assert read_access(spark, table).count() == 100
    with pytest.raises(ValueError):
        start_ingest(site.stream(), table, offsets, position="middle")


def test_envelope_queue(spark, site):
    queue = str(site.path / "queue")
    sent = to_envelopes(stream_apps(spark, site.apps), [FMT])
    start_queueing(sent, "text", str(site.path / "qo"), every=None, path=queue).awaitTermination()
    assert read_queue(spark, "text", stream=False, path=queue).count() == 505
    parsed = parse_envelopes(read_queue(spark, "text", path=queue, maxFilesPerTrigger=1), [FMT])
    table = str(site.path / "t")
    start_ingest(parsed, table, str(site.path / "o"), every=None).awaitTermination()
    rows = read_access(spark, table)
    assert rows.count() == 500 and rows.first().app_name == "www" and rows.first().node_id == "n1"


def test_replayed_batches_replace_themselves(spark, site):
    table = str(site.path / "t")
    write = write_numbered(table)
    seen = []
    steps = dict(before=lambda df, n: seen.append(("before", n)), after=lambda df, n: seen.append(("after", n)))

    def write_twice(df, n):
        write(df, n)
        write(df, n)

    start_batches(site.stream(), str(site.path / "o"), write_twice, every=None, **steps).awaitTermination()
    assert read_access(spark, table).count() == 500
    assert seen == [(step, n) for n in range(3) for step in ("before", "after")]


def test_another_checkpoint_adds_to_a_numbered_table(spark, site):
    table = str(site.path / "t")
    for offsets in ("o", "p"):
        start_batches(
            site.stream(), str(site.path / offsets), write_numbered(table), every=None
        ).awaitTermination()
    assert read_access(spark, table).count() == 1000


def test_panels_are_refreshed(spark, site):
    table, out = str(site.path / "t"), str(site.path / "panels")
    panels = {"pv": lambda a: traffic.total_pv(a, "2024-01-15"),
              "urls": lambda a: traffic.request_num_by_url(a, "2024-01-15")}
    start_batches(
        site.stream(), str(site.path / "o"), write_numbered(table),
        after=panel_step(table, out, panels, day="2024-01-15"), every=None,
    ).awaitTermination()
    now = refresh_panels(spark, table, panels, day="2024-01-15")
    assert spark.read.parquet(f"{out}/pv").collect() == now["pv"].collect()
    assert now["pv"].first().total_num > 0
    assert spark.read.parquet(f"{out}/urls").count() == now["urls"].count()


def run_live(spark, site, result, mode, name):
    query = (result.writeStream.outputMode(mode).format("memory").queryName(name)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)


def test_late_rows_are_stored_but_not_live(spark, site):
    site.add(9)
    rows = good_rows(site.stream())
    got = run_live(spark, site, live.live_ip_pv_by_minute_estimate(rows), "update", "estimate")
    last = got.groupBy("time_str").agg(F.max("pv_num").alias("pv_num"), F.max("ip_num").alias("ip_num"))
    batch = good_rows(parse_lines(spark.read.text(str(site.path / "log")), FMT))
    want = traffic.ip_pv_num_by_minute(batch, "2024-01-01", span="day", open_ended=True, limit=None)
    # Files come in no order of time, so some minutes are late; none is counted too high.
    joined = last.join(want.withColumnsRenamed({"pv_num": "p", "ip_num": "i"}), "time_str")
    assert joined.count() == last.count() > 0
    assert joined.filter("pv_num > p").count() == 0


def test_live_rankings_equal_batch(spark, site):
    batch = good_rows(parse_lines(spark.read.text(str(site.path / "log")), FMT))
    got = run_live(spark, site, live.live_request_num_by_url(good_rows(site.stream())), "complete", "urls")
    want = traffic.request_num_by_url(batch, "2024-01-01", open_ended=True)
    assert got.collect() == want.collect()
