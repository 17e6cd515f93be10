"""Reassembly of conversations whose turns arrive in batches, late, repeated and out of order."""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import read, shared_root

#: Batches that the query cuts a table into, and successive batches without an arrival that close a conversation.
BATCHES, IDLE = 10, 2
_ARRIVAL = "conv_id long, turn long, first long, role string, text string, beat boolean, batch long"
_EVENT = "event string, conv_id long, turn long, batch long, role string, text string, unreleased array<long>, n_missing long, n_breaks long"
_FIELDS = [x.split()[0] for x in _EVENT.split(", ")]
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_SESSION = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def tick(batch: int) -> int:
    """The event time of a batch, in milliseconds: its number plus one, as seconds."""
    return (batch + 1) * 1000


def event(kind: str, conv_id: int | None, turn: int, batch: int, role=None, text=None, unreleased=None, n_missing=None, n_breaks=None) -> Row:
    return Row(*_FIELDS)(kind, conv_id, turn, batch, role, text, unreleased, n_missing, n_breaks)


class Turns(StatefulProcessor):
    """One conversation's state: where its gapless run stands, the kept turns that wait for a gap to fill, and a tombstone.

    Arrivals move an event-time timer to idle batches after their own; when the watermark, which is the number of the last batch
    read, reaches it, the conversation closes. Rows come before timers in a micro-batch, so an arrival behind an expired timer
    that hasn't fired yet closes the conversation first. No text stays in the state once it is released."""

    def __init__(self, idle: int, end: int):
        self.idle, self.end = idle, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # next: the turn to release next; role: that of the turn before it; kept and largest: of all kept turns
        self.run = handle.getValueState("run", "first long, next long, role string, breaks long, kept long, largest long, last long")
        self.held = handle.getMapState("held", "turn long", "role string, text string")
        self.tombstone = handle.getValueState("tombstone", "batch long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        conv_id, beat = key
        if beat:
            return
        rows = iter(rows)
        head = next(rows, None)
        if head is None:
            return
        rows, batch = itertools.chain([head], rows), head.batch
        state = self.run.get()
        closed = state is None and self.tombstone.exists()
        if state is not None and batch > state[6] + self.idle:
            self.handle.deleteTimer(tick(state[6] + self.idle))
            yield self.shut(conv_id, state)
            closed = True
        if closed:
            for r in rows:
                yield event("reject", conv_id, r.turn, r.batch, r.role, r.text)
            return
        if state is not None:
            self.handle.deleteTimer(tick(state[6] + self.idle))
        first, turn, role, breaks, kept, largest, _ = state or (head.first, head.first, None, 0, 0, head.first - 1, batch)
        for some in itertools.batched(rows, 1000):
            for r in sorted(some, key=lambda r: r.turn):
                waits = kept > turn - first
                if r.turn < turn or r.turn > turn and waits and self.held.containsKey((r.turn,)):
                    continue
                kept, largest = kept + 1, max(largest, r.turn)
                if r.turn > turn:
                    self.held.updateValue((r.turn,), (r.role, r.text))
                    continue
                out = (r.role, r.text)
                while out is not None:
                    yield event("release", conv_id, turn, batch, *out)
                    breaks, role, turn = breaks + (turn > first and role == out[0]), out[0], turn + 1
                    out = self.held.getValue((turn,)) if waits and kept > turn - first and self.held.containsKey((turn,)) else None
                    if out is not None:
                        self.held.removeKey((turn,))
        self.run.update((first, turn, role, breaks, kept, largest, batch))
        self.handle.registerTimer(tick(batch + self.idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.run.get()
        if state is not None:
            yield self.shut(key[0], state)

    def shut(self, conv_id: int | None, state: tuple) -> Row:
        """The closing event; only the tombstone stays."""
        first, _, _, breaks, kept, largest, last = state
        left = sorted((k[0], v[0]) for k, v in self.held.iterator())
        breaks += sum(a + 1 == b and r == s for (a, r), (b, s) in itertools.pairwise(left))
        batch = min(last + self.idle, self.end)
        self.held.clear()
        self.run.clear()
        self.tombstone.update((batch,))
        return event("close", conv_id, -1, batch, None, None, [t for t, _ in left], largest - first + 1 - kept, breaks)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def session(spark: SparkSession, settings: dict[str, str]):
    """The session's settings are these inside, and as they were afterwards."""
    was = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def reassemble(arrivals: DataFrame, batches: int, idle: int = IDLE) -> DataFrame:
    """(event, conv_id, turn, batch, role, text, unreleased, n_missing, n_breaks) of arrivals (conv_id, turn, role, text, batch).

    Batches 0 to batches - 1 are fed in order to a streaming query with state, started anew for each on one checkpoint. Of a
    turn's arrivals in one batch only the smallest `role|text` (bytewise) counts; of those in several batches the earliest is
    kept, the others only keep the conversation open. Events:
    release: a kept turn, once, when all turns from the conversation's smallest on are kept; reject: an arrival at a closed
    conversation; close (turn -1): idle successive batches without an arrival, in the last of them, or the end, which is
    batch number batches. unreleased: kept turns that never were released, ascending; n_missing: turns not kept up to the
    largest kept; n_breaks: kept turns with the role of the turn before, which is kept too. An arrival opens a conversation
    that was never seen; a closed one stays closed.

    Null turns and batches are dropped; null roles and texts are empty; null conv_ids are one conversation. Other columns take no
    part. Batches may be empty, texts of any length; of an empty table there is no event. Aggregations before the stream
    leave a row for each turn and batch at most, so repeated rows don't gather in a task. Batches, checkpoint and events lie in a new
    folder under spark.checkpoint.dir."""
    spark = arrivals.sparkSession
    root = f"{shared_root(spark)}/turns-{uuid.uuid4().hex}"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = arrivals.where("turn is not null and batch is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("batch").cast("long"), text("role").alias("role"), text("text").alias("text"))
    payload = F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role", "text")
    once = rows.groupBy("conv_id", "turn", "batch").agg(F.min(payload).alias("x")).select("conv_id", "turn", "x.role", "x.text", "batch")
    first = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.min("turn").alias("first"))
    put = once.join(first, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "turn", "first", "role", "text", F.lit(False).alias("beat"), "batch")
    # a row of each batch that only moves the watermark; the last one stands after all timers
    beats = spark.range(batches + 1).select(*(F.lit(None).cast(t).alias(c) for c, t in put.dtypes[:5]), F.lit(True).alias("beat"), F.when(F.col("id") < batches, F.col("id")).otherwise(F.lit(batches + idle)).alias("batch"))
    put.unionByName(beats).hint("rebalance", F.col("batch")).write.partitionBy("batch").parquet(f"{root}/waiting")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{root}/arrived"))
    with session(spark, _SESSION | {_NO_DATA: "false"}):
        for batch in [*range(batches), batches + idle]:
            if not files.rename(path(f"{root}/waiting/batch={batch}"), path(f"{root}/arrived/batch={batch}")):
                raise OSError(f"batch {batch} can't be moved in {root}")
            stream = spark.readStream.schema(_ARRIVAL).parquet(f"{root}/arrived").withColumn("at", F.timestamp_seconds(F.col("batch") + 1)).withWatermark("at", "0 seconds")
            events = stream.groupBy("conv_id", "beat").transformWithState(Turns(idle, batches), _EVENT, "append", "EventTime")
            # an expiry that a batch's watermark brings is fired by the next start, so only the last one needs a micro-batch of its own
            spark.conf.set(_NO_DATA, str(batch == batches + idle).lower())
            started = events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            started.awaitTermination()
    return spark.read.schema(_EVENT).parquet(f"{root}/events")


def dealt(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows of conversations as arrivals: each in the batch that a hash of `conv_id:turn` gives, some once more, as the
    user's, in another batch."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    own = F.struct("role", (F.col("_h") % batches).alias("batch"))
    again = F.struct(F.lit("user").alias("role"), ((F.col("_h") + 5) % batches).alias("batch"))
    each = F.when(F.col("_h") % 7 < 2, F.array(own, again)).otherwise(F.array(own))
    return conversations.where("turn is not null").withColumn("_h", h).select("conv_id", "turn", "text", F.explode(each).alias("x")).select("conv_id", "turn", "text", "x.role", "x.batch")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the events of conversations, with digests for payloads and for turns that weren't released."""
    out = reassemble(dealt(read(spark, sf_dir, "conversations")), BATCHES)
    body = F.when(F.col("event") == "close", F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    return out.select("event", "conv_id", "turn", "batch", F.sha2(body, 256).alias("sha256"), "n_missing", "n_breaks")


_H = "CAST(('0x' || substr(sha256(concat(conv_id, ':', turn)), 1, 8)) AS BIGINT)"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_H} AS h FROM conversations WHERE turn IS NOT NULL),
every AS (SELECT conv_id, turn, role, text, h % 10 AS batch FROM t UNION ALL SELECT conv_id, turn, 'user', text, (h + 5) % 10 FROM t WHERE h % 7 < 2),
a AS (SELECT conv_id, turn, batch, min((role || '|' || text, role)) AS x FROM every GROUP BY ALL),
seen AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS after FROM (SELECT DISTINCT conv_id, batch FROM a)),
closed AS (SELECT conv_id, least(min(batch) + 2, 10) AS closing FROM seen WHERE coalesce(after, 99) > batch + 2 GROUP BY 1),
kept AS (SELECT conv_id, turn, min(batch) AS batch, arg_min(x, batch) AS x FROM a JOIN closed USING (conv_id) WHERE batch <= closing GROUP BY 1, 2),
run AS (SELECT k.*, s.first, k.turn - s.first + 1 = row_number() OVER w AS gapless, max(k.batch) OVER w AS released,
  lag(k.turn) OVER w = k.turn - 1 AND lag(k.x[2]) OVER w = k.x[2] AS again
  FROM kept k JOIN (SELECT conv_id, min(turn) AS first FROM t GROUP BY 1) s USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'release' AS event, conv_id, turn, released AS batch, sha256(x[1]) AS sha256, CAST(NULL AS BIGINT) AS n_missing, CAST(NULL AS BIGINT) AS n_breaks FROM run WHERE gapless
UNION ALL SELECT 'reject', conv_id, turn, batch, sha256(x[1]), NULL, NULL FROM a JOIN closed USING (conv_id) WHERE batch > closing
UNION ALL SELECT 'close', conv_id, -1, any_value(closing), sha256(coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (NOT gapless), '')),
  max(turn) - any_value(first) + 1 - count(*), count(*) FILTER (again) FROM run JOIN closed USING (conv_id) GROUP BY conv_id"""
