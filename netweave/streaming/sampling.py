"""Samples to published readings, and readings to breach episodes; batch or stream.

A station takes samples of a property in bursts. A burst is ``SAMPLES`` samples in
order of time (then of number), or fewer where the next one comes more than ``idle``
later; its median is the published reading. An episode is a run of bursts of one
station and property that are out of range on one side, with no pause of more
than ``idle`` between them. Equal sample numbers at one time of one station and
property are one sample, delivered twice: its smallest value counts. Samples that
lack anything, or are not a finite number, are none. A property without a range
is never in breach.

The stream gives the same rows when the watermark has passed them by ``idle``, if no
sample comes later than the watermark allows; such a sample is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from netweave.operators.islands import islands

#: Fixed value: samples of a burst.
SAMPLES = 21
OUT = "kind string, station string, property string, start timestamp, end timestamp, value double, n long, side string"


def usable(samples: DataFrame) -> DataFrame:
    """(station, property, ts, sample, value): the samples that count."""
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return samples.select("station", "property", "ts", "sample", "value").dropna().filter(finite)


def _side(value: Column) -> Column:
    return F.when(value < F.col("low"), "low").when(value > F.col("high"), "high")


def bursts(samples: DataFrame, idle: float, size: int = SAMPLES) -> DataFrame:
    """(station, property, start, sample, end, value, n): the readings of a batch,
    with the number of the first sample. idle in seconds."""
    once = usable(samples).groupBy("station", "property", "ts", "sample").agg(F.min("value").alias("value"))
    late = lambda p: F.unix_micros("ts") - F.unix_micros(p["ts"]) > int(idle * 1e6)
    other = lambda p: (p["station"] != F.col("station")) | (p["property"] != F.col("property"))
    runs = islands(once, ["station", "property", "ts", "sample"], lambda p: other(p) | late(p))
    burst = F.floor(F.col("at") / size).alias("burst")
    return runs.groupBy("station", "property", "island", burst).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("sample", "at").alias("sample"), F.percentile("value", F.lit(0.5)).alias("value"), F.count("*").alias("n")).drop("island", "burst")


def episodes(readings: DataFrame, ranges: DataFrame, idle: float) -> DataFrame:
    """(station, property, start, end, value, n, side): the runs of readings out of
    range; value is the one furthest out, n the number of readings. ranges is a row
    for each property (property, low, high)."""
    judged = readings.join(F.broadcast(ranges), "property", "left").withColumn("side", _side(F.col("value"))).select(*readings.columns, "side")
    late = lambda p: F.unix_micros("start") - F.unix_micros(p["end"]) > int(idle * 1e6)
    other = lambda p: (p["station"] != F.col("station")) | (p["property"] != F.col("property")) | ~p["side"].eqNullSafe(F.col("side"))
    runs = islands(judged, ["station", "property", "start", "sample"], lambda p: other(p) | late(p)).filter("side IS NOT NULL")
    worst = F.when(F.col("side") == "low", F.min("value")).otherwise(F.max("value"))
    return runs.groupBy("station", "property", "island", "side").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), worst.alias("value")).select("station", "property", "start", "end", "value", "n", "side")


class Sampler(StatefulProcessor):
    """State of a station and property: ``pending``, samples that the watermark
    has not passed; ``burst``, the values of the open one; ``episode``, the open one.
    Bounded by what comes within the watermark's delay, and by a burst."""

    def __init__(self, ranges: dict, idle: float, size: int):
        self.ranges, self.idle, self.size = ranges, int(idle * 1e6), size
        self.made = Row("kind", "station", "property", "start", "end", "value", "n", "side")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long, sample long", "value double")
        self.burst = handle.getMapState("burst", "nr int", "at long, value double")
        self.episode = handle.getValueState("episode", "start long, end long, value double, n long, side string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for row in rows:
            if row.at >= passed:
                place = (row.at, row.sample)
                before = self.pending.getValue(place)[0] if self.pending.containsKey(place) else row.value
                self.pending.updateValue(place, (min(before, row.value),))
        yield from self._advance(key, passed)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key: tuple, passed: int) -> Iterator[Row]:
        """Takes what the watermark has passed, and sets the next timer."""
        self.taken = sorted((nr, at, value) for (nr,), (at, value) in self.burst.iterator())
        kept, self.open = len(self.taken), self.episode.get()
        waiting = sorted((at, sample, value) for (at, sample), (value,) in self.pending.iterator())
        ready = [w for w in waiting if w[0] < passed]
        self.taken = [(at, value) for _, at, value in self.taken]
        for at, sample, value in ready:
            self.pending.removeKey((at, sample))
            if self.taken and at - self.taken[-1][0] > self.idle:
                yield from self._close(key)
            self.taken.append((at, value))
            if len(self.taken) == self.size:
                yield from self._close(key)
        if self.taken and passed - self.taken[-1][0] > self.idle:
            yield from self._close(key)
        if self.open and not self.taken and passed - self.open[1] > self.idle:
            yield self._ended(key)
        for nr in range(max(kept, len(self.taken))):
            if nr < len(self.taken):
                self.burst.updateValue((nr,), self.taken[nr])
            else:
                self.burst.removeKey((nr,))
        self.episode.update(self.open) if self.open else self.episode.clear()
        due = [waiting[len(ready)][0]] if len(waiting) > len(ready) else []
        due += [self.taken[-1][0] + self.idle] if self.taken else [self.open[1] + self.idle] if self.open else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    def _close(self, key: tuple) -> Iterator[Row]:
        start, end, value = self.taken[0][0], self.taken[-1][0], float(median(v for _, v in self.taken))
        low, high = self.ranges.get(key[1], (None, None))
        side = "low" if low is not None and value < low else "high" if high is not None and value > high else None
        yield self._row("burst", key, start, end, value, len(self.taken), None)
        if self.open and (side != self.open[4] or start - self.open[1] > self.idle):
            yield self._ended(key)
        if side and self.open:
            worst = min(self.open[2], value) if side == "low" else max(self.open[2], value)
            self.open = (self.open[0], end, worst, self.open[3] + 1, side)
        elif side:
            self.open = (start, end, value, 1, side)
        self.taken = []

    def _ended(self, key: tuple) -> Row:
        row, self.open = self._row("episode", key, *self.open), None
        return row

    def _row(self, kind: str, key: tuple, start: int, end: int, value: float, n: int, side: str | None) -> Row:
        return self.made(kind, *key, start, end, value, n, side)


def sampled(samples: DataFrame, ranges: dict, idle: float, delay: str, size: int = SAMPLES) -> DataFrame:
    """The stream of bursts and episodes (kind, station, property, start, end,
    value, n, side) of a stream of samples; ranges as ``RANGES``. Needs the RocksDB
    state store."""
    out = OUT.replace("timestamp", "long")
    fed = usable(samples).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    found = fed.groupBy("station", "property").transformWithState(Sampler(ranges, idle, size), StructType.fromDDL(out), "append", "eventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})
