import random

import pytest
from pyspark.sql import functions as F

from accessloom.operators.geo import geo_join, prepare_ranges

SCHEMA = "lo bigint, hi bigint, city_id int, region string"


def quad(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def random_ranges(rng):
    """Narrow, wide and single-address ranges with gaps; some blocks very crowded."""
    out, at = [], rng.randrange(1 << 20)
    while at < 2 ** 32 - 1 and len(out) < 900:
        width = rng.choice([1, 1, 2, 7, 256, 65536, 200000, 3 << 20])
        hi = min(at + width - 1, 2 ** 32 - 1)
        out.append((at, hi, len(out), f"C{len(out)}|0|P|T|I"))
        at = hi + 1 + rng.choice([0, 0, 1, 5, 300, 10 << 20])
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_equals_plain_range_join(spark, seed, limit):
    rng = random.Random(seed)
    ranges = random_ranges(rng)
    borders = [b + d for lo, hi, *_ in ranges for b in (lo, hi) for d in (-1, 0, 1)]
    ips = [quad(n) for n in borders if 0 <= n < 2 ** 32] + [quad(rng.randrange(2 ** 32)) for _ in range(500)]
    ips += ["::1", "-", "", "1.2.3", None]
    df = spark.createDataFrame(list(enumerate(ips)), "i int, ip string")

    def expected(ip):
        try:
            a, b, c, d = (int(x) for x in ip.split("."))
        except (ValueError, AttributeError):
            return "0", 0
        n = ((a * 256 + b) * 256 + c) * 256 + d
        hit = [r for r in ranges if r[0] <= n <= r[1]]
        return (f"C{hit[0][2]}", hit[0][2]) if hit else ("0", 0)

    table = prepare_ranges(spark.createDataFrame(ranges, SCHEMA))
    joined = geo_join(df, table, max_broadcast_bytes=limit)
    got = {r.i: (r.country, r.city_id) for r in joined.collect()}
    assert len(got) == len(ips)
    assert got == {i: expected(ip) for i, ip in enumerate(ips)}


def test_candidates_and_size_are_bounded(spark):
    # 65,536 single addresses in one block, and one range over half of all addresses.
    dense = spark.range(65536).select(
        (F.col("id") + 167772160).alias("lo"), (F.col("id") + 167772160).alias("hi"),
        F.lit(1).alias("city_id"), F.lit("a|b|c|d|e").alias("region"))
    wide = spark.createDataFrame([(1 << 31, (1 << 32) - 1, 2, "w|x|y|z|v")], SCHEMA)
    table = prepare_ranges(dense.unionByName(wide))
    per_cell = table.cells.groupBy("block", "cell").count()
    assert per_cell.agg(F.max("count")).first()[0] == 1
    assert table.cells.count() == 65536 + 32768
    assert table.shifts.count() == 1 + 32768


def test_shuffled_join_salts_and_broadcasts_only_the_block_table(spark, capsys):
    ranges = spark.createDataFrame([(0, 10, 1, "a|b|c|d|e")], SCHEMA)
    df = spark.createDataFrame([(i, "0.0.0.5") for i in range(1000)], "i int, ip string")
    joined = geo_join(df, prepare_ranges(ranges), max_broadcast_bytes=0)
    joined.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "__salt" in plan and "NestedLoop" not in plan
    assert joined.filter("country = 'a'").count() == 1000


def test_addresses_without_a_block_are_spread(spark):
    ranges = prepare_ranges(spark.createDataFrame([(0, 10, 1, "a|b|c|d|e")], SCHEMA))
    df = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, ("-", "::1", "9.9.9.9", "0.0.0.5"))), (F.col("id") % 4 + 1).cast("int")).alias("ip"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = geo_join(df, ranges, max_broadcast_bytes=0).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 4000 and {r.country for r in rows if r.ip != "0.0.0.5"} == {"0"}
    assert {r.country for r in rows if r.ip == "0.0.0.5"} == {"a"}
    sizes = {}
    for r in rows:
        if r.ip != "0.0.0.5":
            sizes[r.task] = sizes.get(r.task, 0) + 1
    assert len(sizes) > 1 and max(sizes.values()) < 2 * 3000 / len(sizes)


def test_backward_range_is_refused(spark):
    ranges = spark.createDataFrame([(9, 5, 1, "A|0|B|C|D")], "lo bigint, hi bigint, city_id int, region string")
    with pytest.raises(ValueError, match="before they begin"):
        prepare_ranges(ranges)


def test_overlap_is_refused(spark):
    with pytest.raises(ValueError, match="overlap"):
        prepare_ranges(spark.createDataFrame([(0, 10, 1, "a"), (10, 20, 2, "b")], SCHEMA))
    with pytest.raises(ValueError, match="overlap"):
        prepare_ranges(spark.createDataFrame([(0, 1 << 20, 1, "a"), (70000, 70001, 2, "b")], SCHEMA))


def test_numbers_beyond_addresses_are_cut_off(spark):
    ranges = [(-5, 3, 1, "a|b|c|d|e"), (2 ** 32 - 2, 2 ** 40, 2, "w|x|y|z|v"), (2 ** 41, 2 ** 42, 3, "n|n|n|n|n")]
    table = prepare_ranges(spark.createDataFrame(ranges, SCHEMA))
    assert {r.block for r in table.shifts.collect()} == {0, 65535}
    df = spark.createDataFrame([("0.0.0.0",), ("0.0.0.4",), ("255.255.255.255",)], "ip string")
    assert {r.ip: r.country for r in geo_join(df, table).collect()} == {
        "0.0.0.0": "a", "0.0.0.4": "0", "255.255.255.255": "w"}


def test_no_ranges(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "ip string")
    row = geo_join(df, spark.createDataFrame([], SCHEMA)).first()
    assert tuple(row) == ("1.2.3.4", "0", "0", 0, "0", "0")


def test_half_covered_and_previous_columns_replaced(spark):
    df = spark.createDataFrame([("0.0.0.5", "old")], "ip string, city string")
    ranges = spark.createDataFrame([(0, 10, 1, "a|b|c|d|e")], SCHEMA)
    assert geo_join(df, ranges).first().city == "d"
