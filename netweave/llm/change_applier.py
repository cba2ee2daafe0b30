"""Numbered changes applied in order by a stateful stream, with targeted ticks.

Each client's changes are numbered 1, 2, 3, ... and come in batches, late and
out of order. A stream keeps for each client the number it waits for (``next``),
the values so far, and the changes that are held because an earlier number is
missing. What is held too long makes ``next`` jump to the smallest number held.

The stream is started anew for every batch on one checkpoint. A client that gets
no rows would not notice that its time has run out, so before each start the
checkpoint is read through the statestore source: clients that hold a row which
has expired get a clock row in the batch's input, and nobody else does. After the
last batch every client that holds anything gets one.

A client's rows may come in any order, in several pieces and several
micro-batches of one start: every row carries the batch's clock, a client's
first row of a start makes the jumps, and of a number's rows in one batch only
the first by day and id can be held. The others are rejected whatever the state,
so they are marked before and dealt out by a salt: of a client with a third of all
rows one task gets one row for each number and batch.

Clients are dealt into buckets by a hash, of about ``BUCKET`` rows of the table
each, and a bucket is a key of the stream: its clients' heads are read and written
at once, not a call to the store for each. A head has up to ``INLINE`` of the
rows that are held; a client that holds more has them in pages of ``PAGE``
numbers in the store, of which a task has up to ``MEMORY`` rows at a time. A piece
of input is ``PIECE`` rows.

Ranks come from one range sort of the distinct pairs of client and number; no
window holds a client, and nothing but a figure for each batch and each sorted range
reaches the driver.

Defined results: rows that repeat in all columns are one; rows without id,
client, number, time or batch vanish, and null numbers have no rank; ties by day
and id go by a hash of all columns; an op other than I, U and D is applied and
changes nothing; batches before the first belong to the first, those after the
last to the last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from netweave.operators.topology import number
from netweave.session import shared_path, stored

PIECE, SALTS = 4096, 64
BUCKET, INLINE, PAGE, MEMORY = 1024, 64, 64, 8192
#: The day by which everything has expired.
END_OF_TIME = 1 << 40
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no space on disk ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@dataclass(frozen=True)
class Names:
    """The columns of a table of changes. values: what a change sets."""

    id: str
    client: str
    seq: str
    op: str
    values: tuple[str, ...]


def ranked(df: DataFrame, client: str, seq: str) -> DataFrame:
    """(client, seq, n): for each distinct pair the dense rank of seq."""
    pairs = number(df.select(client, seq).filter(F.col(client).isNotNull() & F.col(seq).isNotNull()).distinct(), [client, seq], "__at")
    first = pairs.groupBy(client).agg(F.min("__at").alias("__first"))
    return pairs.join(first, client).select(client, seq, (F.col("__at") - F.col("__first") + 1).alias("n"))


def planned(changes: DataFrame, names: Names, day: Column, batch: Column, stays: Column, batches: int) -> DataFrame:
    """The rows that take part, with n, day, batch, and lead: whether a row is
    the first of its client, number and batch. day, batch and stays are
    expressions over the changes' own columns."""
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in changes.columns])
    values = [F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(names.values)]
    rows = changes.distinct().select(F.col(f"`{names.id}`").alias("id"), F.col(f"`{names.client}`").alias("client"), F.col(f"`{names.seq}`").alias("seq"), F.col(f"`{names.op}`").alias("op"), *values, day.cast("long").alias("day"), F.greatest(F.lit(1), F.least(F.lit(batches), batch.cast("int"))).alias("batch"), F.coalesce(stays, F.lit(False)).alias("stays"), batch.isNotNull().alias("dated"), whole.alias("whole"))
    rows = stored(rows, "changes")
    taken = rows.filter("stays AND dated AND day IS NOT NULL AND id IS NOT NULL AND client IS NOT NULL AND seq IS NOT NULL").drop("stays", "dated")
    taken = stored(taken.join(ranked(rows, "client", "seq"), ["client", "seq"]).drop("seq"), "ranked")
    first = taken.groupBy("client", "n", "batch").agg(F.min(F.struct("day", "id", "whole")).alias("first")).select("first.id", "first.whole", F.lit(True).alias("lead"))
    return taken.join(first, ["id", "whole"], "left").withColumn("lead", F.coalesce("lead", F.lit(False))).drop("whole")


class Client:
    """What is known of a client: next, batch of its last jump, values, the held
    rows that are in memory, by number, and which pages of more are in the store."""

    def __init__(self, key: object, pages: object, head: tuple | None, n_values: int):
        self.key, self.store = key, pages
        self.next, self.batch, self.values, held, paged = head if head is not None else (1, 0, [None] * n_values, (), ())
        self.values, self.held, self.paged = list(self.values), {row[0]: tuple(row[1:]) for row in held}, set(paged)

    def head(self) -> tuple:
        if len(self.held) > INLINE:
            self.spill()
        return (self.key, self.next, self.batch, *self.values, [(n, *row) for n, row in self.held.items()], sorted(self.paged))

    def spill(self) -> None:
        pages: dict[int, list] = {}
        for n, row in self.held.items():
            pages.setdefault(n // PAGE, []).append((n, *row))
        for page, rows in pages.items():
            self.store.updateValue((self.key, page), (self._page(page) + rows,))
        self.paged |= set(pages)
        self.held = {}

    def _page(self, page: int) -> list[tuple]:
        return [tuple(row) for row in self.store.getValue((self.key, page))[0]] if page in self.paged else []

    def fetch(self, page: int) -> None:
        """A page's rows are held in memory from now on."""
        if page in self.paged:
            if len(self.held) > MEMORY:
                self.spill()
            self.held.update((row[0], row[1:]) for row in self._page(page))
            self.store.removeKey((self.key, page))
            self.paged.remove(page)

    def holds(self, n: int) -> bool:
        if self.paged:
            self.fetch(n // PAGE)
        return n in self.held

    def hold(self, n: int, row: tuple) -> None:
        self.held[n] = row
        if len(self.held) > MEMORY:
            self.spill()

    def expired(self, latest: int) -> int:
        """The largest number of a held row of that day or an earlier one; 0: none."""
        last = max((n for n, row in self.held.items() if row[1] <= latest), default=0)
        for page in self.paged:
            last = max([last, *(row[0] for row in self._page(page) if row[2] <= latest)])
        return last

    def numbers(self) -> Iterator[int]:
        """The numbers that are held, rising; those given may go."""
        for page in sorted(self.paged | {n // PAGE for n in self.held}):
            self.fetch(page)
            yield from sorted(n for n in self.held if n // PAGE == page)


class Applier(StatefulProcessor):
    """State of a bucket: ``heads``, of each of its clients, and ``pages``, held rows
    of clients that hold many, by client and page."""

    def __init__(self, client_type: str, id_type: str, value_types: list[str], patience: int):
        self.client, self.id, self.types, self.patience, self.end = client_type, id_type, value_types, patience, 6 + len(value_types)
        self.made = Row("id", "client", "n", "op", "status", "batch", "missed", *[f"v{i}" for i in range(len(value_types))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = ", ".join(f"v{i}: {t}" for i, t in enumerate(self.types))
        rows = f"array<struct<n: bigint, id: {self.id}, day: bigint, op: string, {values}>>"
        self.heads = handle.getValueState("heads", f"clients array<struct<client: {self.client}, next: bigint, batch: int, {values}, held: {rows}, paged: array<bigint>>>")
        self.pages = handle.getMapState("pages", f"client {self.client}, page long", f"held {rows}")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if key[0] < 0:
            for row in rows:
                yield self._rejected(row)
            return
        found, clients = self.heads.get(), {}
        for client, following, batch, *values, held, paged in found[0] if found is not None else ():
            clients[client] = Client(client, self.pages, (following, batch, values, held, paged), len(self.types))
        while piece := list(islice(rows, PIECE)):
            by_client: dict[object, list] = {}
            for row in piece:
                by_client.setdefault(row.client, []).append(row)
            for client, own in by_client.items():
                if client not in clients:
                    clients[client] = Client(client, self.pages, None, len(self.types))
                yield from self._taken(clients[client], own)
        self.heads.update(([c.head() for c in clients.values()],))

    def _taken(self, client: Client, rows: list[Row]) -> Iterator[Row]:
        now, clock = rows[0].batch, rows[0].clock
        if client.batch < now:
            client.batch = now
            if clock is not None:
                yield from self._jumped(client, now, clock)
        for row in sorted((r for r in rows if r.id is not None), key=lambda r: r.n):
            if row.n < client.next or client.holds(row.n):
                yield self._rejected(row)
            elif row.n > client.next:
                client.hold(row.n, (row.id, row.day, row.op, *row[6:self.end]))
            else:
                yield self._applied(client, row.n, row.id, row.op, row[6:self.end], now)
                while client.holds(client.next):
                    yield self._released(client, client.next, now)

    def _rejected(self, row: Row) -> Row:
        return self.made(row.id, row.client, row.n, row.op, "rejected", row.batch, 0, *[None] * len(self.types))

    def _applied(self, client: Client, n: int, change: int, op: str, values: tuple, batch: int) -> Row:
        if op == "I":
            client.values = list(values)
        elif op == "U":
            client.values = [old if new is None else new for old, new in zip(client.values, values, strict=True)]
        elif op == "D":
            client.values = [None] * len(self.types)
        missed, client.next = n - client.next, n + 1
        return self.made(change, client.key, n, op, "applied", batch, missed, *client.values)

    def _released(self, client: Client, n: int, batch: int) -> Row:
        change, _, op, *values = client.held.pop(n)
        return self._applied(client, n, change, op, tuple(values), batch)

    def _jumped(self, client: Client, batch: int, clock: int) -> Iterator[Row]:
        """Jumps until no held row has expired: that is up to the largest number of
        an expired row, and on from there as far as numbers follow each other."""
        last = client.expired(clock - self.patience)
        for n in client.numbers() if last else ():
            if n > last and n != client.next:
                break
            yield self._released(client, n, batch)


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """The session with a state store that transformWithState needs."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def overdue(spark: SparkSession, checkpoint: str, patience: int, clock: int) -> DataFrame:
    """(client): those that hold a row which has expired, read from the state."""
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    due = lambda held: F.exists(held, lambda row: row["day"] + patience <= clock)
    heads = state("heads").select(F.explode("value.clients").alias("head")).filter(due(F.col("head.held"))).select("head.client")
    pages = state("pages").filter(due(F.col("user_map_value.held"))).select("user_map_key.client")
    return heads.union(pages).distinct()


def apply_changes(changes: DataFrame, names: Names, day: Column, batch: Column, stays: Column, batches: int, patience: int) -> DataFrame:
    """(id, client, n, op, status, batch, missed, current, v0, v1, ...): what
    became of each change, and the values after it. Numbers are dense ranks of seq
    over all rows, before those that do not stay vanish."""
    spark = changes.sparkSession
    rows = planned(changes, names, day, batch, stays, batches)
    types = [rows.schema[f"v{i}"].dataType.simpleString() for i in range(len(names.values))]
    id_type, client_type = (rows.schema[c].dataType.simpleString() for c in ("id", "client"))
    columns = [f"v{i}" for i in range(len(types))]
    ready, folder, inputs, checkpoint = (shared_path(spark, x) for x in ("batches", "applied", "arrivals", "state"))
    ordered = rows.select("client", "lead", "id", "n", "day", "op", *columns, "batch")
    ordered.repartition("batch", F.pmod(F.xxhash64("id"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy("batch").parquet(ready)
    inside = f"client {client_type}, lead boolean, id {id_type}, n long, day long, op string, " + "".join(f"{c} {t}, " for c, t in zip(columns, types, strict=True))
    table = spark.read.schema(inside + "batch int").parquet(ready)
    figures = table.groupBy("batch").agg(F.max("day").alias("latest"), F.count("*").alias("rows")).collect()
    per_batch, buckets = {r["batch"]: r["latest"] for r in figures}, 1 + sum(r["rows"] for r in figures) // BUCKET
    out = f"id {id_type}, client {client_type}, n long, op string, status string, batch int, missed long" + "".join(f", {c} {t}" for c, t in zip(columns, types, strict=True))
    if not per_batch:
        return spark.createDataFrame([], out.replace("missed long", "missed long, current boolean"))
    fields = StructType.fromDDL(inside + "batch int, clock long").fieldNames()
    with _store(spark):
        for now in range(1, batches + 2):
            earlier = [latest for b, latest in per_batch.items() if b < now]
            clock = END_OF_TIME if now > batches else max(earlier, default=None)
            fed = table.filter(F.col("batch") == now)
            if earlier:
                ticks = overdue(spark, checkpoint, patience, clock).withColumns({"lead": F.lit(True), "batch": F.lit(now)})
                fed = fed.unionByName(ticks, allowMissingColumns=True)
            fed.withColumn("clock", F.lit(clock).cast("long")).select(*fields).write.mode("append").parquet(inputs)
            stream = spark.readStream.schema(inside + "batch int, clock long").parquet(inputs)
            bucket = F.when(F.col("lead"), F.pmod(F.xxhash64("client"), F.lit(buckets))).otherwise(-1 - F.pmod(F.hash("id"), F.lit(SALTS)))
            applied = stream.withColumn("bucket", bucket.cast("long")).groupBy("bucket").transformWithState(Applier(client_type, id_type, types, patience), StructType.fromDDL(out), "append", "none")
            query = applied.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    done = spark.read.schema(out).parquet(folder)
    last = done.filter("status = 'applied'").groupBy("client").agg(F.max("n").alias("n")).withColumn("last", F.lit(True))
    current = F.coalesce(F.col("last") & (F.col("status") == "applied") & ~F.col("op").eqNullSafe("D"), F.lit(False))
    return done.join(last, ["client", "n"], "left").select("id", "client", "n", "op", "status", "batch", "missed", current.alias("current"), *columns)
