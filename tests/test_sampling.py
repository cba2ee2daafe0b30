"""Bursts of samples and breach episodes: batch, stream and a plain re-statement."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from netweave.operators.islands import islands
from netweave.streaming import readings, sampling

SCHEMA = "station string, property string, ts timestamp, sample long, value double"
RANGES = {"pH": (6.5, 8.5), "turbidity": (None, 1.0)}
START = datetime(2024, 1, 1)
IDLE = 60.0
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def plain(rows, size):
    """Bursts and episodes of rows, one station and property after the other."""
    once = {}
    for station, prop, ts, sample, value in rows:
        if None not in (station, prop, ts, sample, value) and value == value and abs(value) != float("inf"):
            key = (station, prop, ts, sample)
            once[key] = min(once.get(key, value), value)
    series = defaultdict(list)
    for (station, prop, ts, _), value in sorted(once.items()):
        series[station, prop].append((ts, value))
    bursts, episodes = [], []
    for (station, prop), found in series.items():
        cut, last = [], None
        for ts, value in found:
            if last is None or (ts - last).total_seconds() > IDLE or len(cut[-1]) == size:
                cut.append([])
            cut[-1].append((ts, value))
            last = ts
        low, high = RANGES.get(prop, (None, None))
        run = None
        for burst in cut:
            start, end, value = burst[0][0], burst[-1][0], median(v for _, v in burst)
            bursts.append((station, prop, start, end, value, len(burst)))
            side = "low" if low is not None and value < low else "high" if high is not None and value > high else None
            if run and (side != run[-1] or (start - run[3]).total_seconds() > IDLE):
                episodes.append(tuple(run))
                run = None
            if side and run:
                run[3:6] = end, (min if side == "low" else max)(run[4], value), run[5] + 1
            elif side:
                run = [station, prop, start, end, value, 1, side]
        if run:
            episodes.append(tuple(run))
    return sorted(bursts), sorted(episodes)


def made(seed, n=400):
    draw = random.Random(seed)
    rows, ts = [], START
    for i in range(n):
        ts += timedelta(seconds=draw.choice((0, 1, 1, 2, 5, 61)), microseconds=draw.choice((0, 250)))
        prop = draw.choice(("pH", "pH", "turbidity", "flow"))
        rows.append((draw.choice(("A", "A", "A", "B")), prop, ts, i, draw.choice((0.5, 1.5, 6.0, 7.0, 9.0, float("nan"), None))))
    return rows + rows[::7]  # delivered twice


def split(found):
    bursts, episodes = [], []
    for r in found:
        row = (r.station, r.property, r.start, r.end, r.value, r.n)
        bursts.append(row) if r.kind == "burst" else episodes.append((*row, r.side))
    return sorted(bursts), sorted(episodes)


def batch(spark, rows, size):
    found = sampling.bursts(spark.createDataFrame(rows, SCHEMA), IDLE, size)
    runs = sampling.episodes(found, readings.permissible(spark, RANGES), IDLE)
    return sorted((r.station, r.property, r.start, r.end, r.value, r.n) for r in found.collect()), sorted(tuple(r) for r in runs.collect())


@pytest.mark.parametrize("size", [1, 3, 21])
def test_batch(spark, size):
    rows = made(size)
    assert batch(spark, rows, size) == plain(rows, size)


def test_odd_rows(spark):
    assert batch(spark, [], 21) == ([], [])
    rows = [(None, "pH", START, 1, 7.0), ("A", None, START, 1, 7.0), ("A", "pH", None, 1, 7.0), ("A", "pH", START, None, 7.0), ("A", "pH", START, 1, float("inf"))]
    assert batch(spark, rows, 21) == ([], [])
    ties = [("A", "pH", START, i, float(i)) for i in range(42)]
    assert batch(spark, ties, 21) == plain(ties, 21)


def test_islands_over_ranges(spark):
    """One key in many ranges: places go on where the range before ended."""
    rows = spark.range(5000).withColumn("key", F.lit(1)).repartition(7)
    got = islands(rows, ["key", "id"], lambda p: F.col("id") % 1250 == 0)
    assert sorted((r.id, r.island, r.at) for r in got.collect()) == [(i, i // 1250 * 1250, i % 1250) for i in range(5000)]


def test_stream_equals_batch(spark, tmp_path):
    """Fed in four starts on one checkpoint, out of order within the watermark; a
    sample later than that is left out."""
    rows = sorted(made(5), key=lambda r: r[2])
    end = rows[-1][2] + timedelta(hours=2)
    parts = [rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3] for i in range(3)] + [[("clock", "pH", end, 1, 7.0)]]
    late = ("A", "pH", START, 10**6, 7.0)
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        for i, part in enumerate(parts):
            random.Random(i).shuffle(part)
            spark.createDataFrame(part + ([late] if i == 3 else []), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            found = sampling.sampled(stream, RANGES, IDLE, "30 seconds", 3)
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert split(spark.read.parquet(str(tmp_path / "out")).collect()) == plain(rows, 3) == batch(spark, rows, 3)
