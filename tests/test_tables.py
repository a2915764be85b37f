import pytest
from pyspark.sql import functions as F

from accessloom.operators.parse import good_rows, parse_lines
from accessloom.sources.formats import compile_format
from accessloom.sources.tables import access_schema, read_access, read_rejected, with_period, write_access
from fixtures import rendered as fx


@pytest.fixture(scope="module")
def parsed(spark):
    lines = fx.rendered(fx.events(spark, "/root/testdata/sf0.001")).unionByName(
        spark.createDataFrame([("junk",), ("more junk",)], "value string"))
    return parse_lines(lines, fx.format_named("combined_plus"))


@pytest.mark.parametrize("split,periods", [("day", 30), ("week", 5), ("month", 1), ("year", 1), (None, 1)])
@pytest.mark.parametrize("rebalance", [False, True])
def test_round_trip(spark, tmp_path, parsed, split, periods, rebalance):
    path = str(tmp_path / "t")
    write_access(parsed, path, split_save=split, rebalance=rebalance)
    rows = read_access(spark, path)
    assert rows.count() == 1000
    assert rows.select("period").distinct().count() == periods
    names = [f.name for f in good_rows(parsed).schema.fields]
    assert rows.select(names).exceptAll(good_rows(parsed)).count() == 0
    assert {r.line for r in read_rejected(spark, path).collect()} == {"junk", "more junk"}


def test_only_wanted_periods_are_read(spark, tmp_path, parsed, capsys):
    path = str(tmp_path / "t")
    write_access(parsed, path)
    day = read_access(spark, path, split_save="day", first="2024-01-15")
    expected = good_rows(parsed).filter("time_str like '2024-01-15%'").count()
    assert day.count() == expected > 0
    day.explain("formatted")
    (filters,) = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PartitionFilters")]
    assert "outcome" in filters and "2024_01_15" in filters
    few = read_access(spark, path, split_save="day", first="2024-01-15", last="2024-01-17")
    assert few.select("period").distinct().count() == 3
    schema = access_schema(spark, fx.format_named("combined_plus"))
    for folders_only in (False, True):
        given = read_access(
            spark, path, schema=schema, split_save="day", first="2024-01-15", folders_only=folders_only)
        assert given.select(day.columns).exceptAll(day).count() == 0 and given.count() == expected
        assert given.filter("node_id is not null").count() == 0
    assert {r.line for r in read_rejected(spark, path, schema=schema).collect()} == {"junk", "more junk"}
    with pytest.raises(ValueError):
        read_access(spark, path, first="2024-01-15")
    with pytest.raises(ValueError):
        read_access(spark, path, folders_only=True)


def test_columns_may_be_added(spark, tmp_path, parsed):
    path = str(tmp_path / "t")
    write_access(parsed, path)
    other = compile_format("nginx", "o", "$time_iso8601 $host")
    write_access(parse_lines(spark.createDataFrame([("2024-01-15T00:00:00+00:00 h",)], "value string"), other), path)
    rows = read_access(spark, path)
    assert rows.count() == 1001 and rows.filter("host = 'h'").count() == 1


def test_ingest_clock_and_errors(spark, parsed):
    stamped = with_period(parsed, "day", by="ingest")
    assert stamped.filter(F.col("period") != F.date_format(F.current_timestamp(), "yyyy_MM_dd")).count() == 0
    with pytest.raises(ValueError):
        with_period(parsed, "hour")
    with pytest.raises(ValueError):
        with_period(parsed, "day", by="mtime")
