"""Block-wise operators equal a plain loop, whatever the block size."""

import random

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import features, geo, order_stats, ordered, report, windows

BITS = [0, 2, 5, 16]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # One key holds most rows; order values have gaps.
    return [("hot" if rng.random() < 0.8 else f"k{rng.randrange(3)}", i * rng.choice([1, 1, 7]) + i * 8, rng.randrange(100)) for i in range(400)]


def by_key(rows):
    out = {}
    for key, order, value in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append((order, value))
    return out


@pytest.mark.parametrize("bits", BITS)
def test_running_and_preceding(spark, rows, bits):
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    total = {(r.k, r.o): r.t for r in ordered.running_sum(df, ["k"], "o", F.col("v"), "t", bits).collect()}
    newest = {(r.k, r.o): r.t for r in ordered.running_max_before(df, ["k"], "o", F.col("v"), "t", bits).collect()}
    near = {(r.k, r.o): r.t for r in ordered.preceding(df, ["k"], "o", F.col("v"), 3, "t", bits).collect()}
    last = {(r.k, r.o) for r in ordered.latest(df, ["k"], "o", 4, bits).collect()}
    for key, series in by_key(rows).items():
        values = [v for _, v in series]
        for i, (o, _) in enumerate(series):
            assert total[key, o] == sum(values[: i + 1])
            assert newest[key, o] == (max(values[:i]) if i else None)
            assert near[key, o] == values[max(0, i - 3) : i]
        assert {o for k, o in last if k == key} == {o for o, _ in series[-4:]}


@pytest.mark.parametrize("bits", [2, 6])
def test_features_do_not_depend_on_blocks(spark, bits):
    from fluxwarden.plans import packet_queries as Q

    packets = Q._registered(spark, "/root/testdata/sf0.001").cache()

    def result(df):
        columns = [F.round(c, 9).alias(c) for c in features.FEATURES]
        return sorted(map(tuple, df.select(*windows.WINDOW_KEYS, *columns).collect()))

    assert result(features.window_features(packets.repartition(7), bits)) == result(features.window_features(packets))


def test_features_are_in_range_and_interior_packets_in_three_windows(spark):
    from fluxwarden.plans import packet_queries as Q

    packets = Q._registered(spark, "/root/testdata/sf0.001")
    low = [F.min(c).alias(f"l{i}") for i, c in enumerate(features.FEATURES)]
    high = [F.max(c).alias(f"h{i}") for i, c in enumerate(features.FEATURES)]
    row = features.window_features(packets).agg(*low, *high).first()
    assert min(row) >= 0.0 and max(row) <= 1.0
    anchored = windows.anchored(packets, previous=False)
    interior = (F.col("ts_us") - F.col("first_ts") >= 60_000_000) & (F.col("last_ts") - F.col("ts_us") >= 60_000_000)
    counts = windows.explode_windows(anchored).filter(interior).groupBy("seq").count()
    assert [r["count"] for r in counts.select("count").distinct().collect()] == [3]


def test_carry_splits_captures_without_a_seam(spark):
    """Features of two captures processed one after the other equal one run."""
    from fluxwarden.plans import packet_queries as Q

    packets = Q._registered(spark, "/root/testdata/sf0.001").cache()
    whole = features.window_features(packets)
    empty = spark.createDataFrame([], features.CARRY_SCHEMA)
    first = features.window_features(packets.filter("capture_id = 0"), carry=empty)
    later = features.window_features(packets.filter("capture_id > 0"), carry=features.next_carry(first))

    def result(df):
        return sorted(map(tuple, df.select(*windows.WINDOW_KEYS, *[F.round(c, 9).alias(c) for c in features.FEATURES]).collect()))

    assert result(whole) == sorted(result(first) + result(later))


def test_exact_percentiles_of_a_hot_key(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    series = {"hot": np.round(rng.gamma(0.5, 0.1, 3000), 3), "one": np.array([0.5]), "zero": np.zeros(40)}
    rows = [(k, float(v)) for k, vs in series.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    ranks = order_stats.ranked(order_stats.counted(df, ["k"], "v"), ["k"], "v")
    got = ranks.groupBy("k").agg(*[order_stats.quantile("v", p).alias(str(p)) for p in (0.1, 0.5, 0.999)], order_stats.count_above_quantile(0.95).alias("above"))
    for r in got.collect():
        for p in (0.1, 0.5, 0.999):
            assert r[str(p)] == pytest.approx(np.quantile(series[r.k], p), abs=1e-12)
        assert r.above == (series[r.k] > np.quantile(series[r.k], 0.95) + 1e-12).sum()


def test_overlapping_ranges_keep_the_greatest_start(spark):
    import bisect

    ranges = [(10, 1_000_000, "A"), (500, 600, "B"), (70_000, 70_010, "C"), (70_000, 70_020, "D"), (2_000_000, 2_000_001, "E"), (33_554_432, 33_554_500, "F")]
    ips = [5, 10, 499, 500, 600, 601, 69_999, 70_000, 70_015, 70_021, 1_000_000, 2_000_001, 2_000_002, 33_554_431, 33_554_433]
    dim = spark.createDataFrame(ranges, "ip_start long, ip_end long, country string")
    got = {r.remote_ip: r.country for r in geo.with_country(spark.createDataFrame([(i,) for i in ips], "remote_ip long"), dim).collect()}
    ordered_ranges = sorted(ranges)
    for ip in ips:
        at = bisect.bisect_right(ordered_ranges, (ip, float("inf"), "")) - 1
        s, e, c = ordered_ranges[at]
        assert got[ip] == (c if at >= 0 and s <= ip <= e else "Unknown")


@pytest.mark.parametrize("bits", [1, 16])
def test_error_streak_restarts_after_success(spark, bits):
    oks = [True, False, False, False, False, False, False, True, False, False, True, False]
    df = spark.createDataFrame([("s", i, ok) for i, ok in enumerate(oks)], "site string, run long, ok boolean")
    got = [(r.streak, r.raises) for r in report.error_streak(df, ["site"], "run", bits=bits).orderBy("run").collect()]
    expected, run = [], 0
    for ok in oks:
        run = 0 if ok else run + 1
        expected.append((run, run > 0 and run % 3 == 0))
    assert got == expected
