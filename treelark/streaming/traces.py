"""Tool-call traces from events, in batch and as a stream.

Events: (session, event_id, ts, kind, tool, args, elapsed_ms, result); kind is tool_start, tool_done or tool_error. A terminal event closes the
latest running call of its tool in its session; one without a running call is a trace of its own. In the stream a call that stays
open for `timeout` of event time is unfinished.

The streams keep their state in RocksDB by key (transformWithState): what a trigger costs goes by its new events and the keys that they touch.
"""

from __future__ import annotations

import contextlib
import heapq
import json
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import batched, groupby

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRACE = "session string, tool string, start_id bigint, end_id bigint, status string, args string, elapsed_ms double"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Events of a session that wait in one value, or in one block, of its state.
LIMIT = 1024


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams with keyed state are started inside: the session's state provider is RocksDB meanwhile."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


def run_to_end(stream: DataFrame, out: str) -> DataFrame:
    """All that the stream gives for what has arrived, appended to out/rows exactly once, and read from there. A killed run goes on where it stopped."""
    spark = stream.sparkSession
    with keyed_state(spark):
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def traces(events: DataFrame) -> DataFrame:
    """All traces of a finished table of events; calls that never end have status running. Of a null kind or one unknown: an error.

    The number of open calls after an event is a running sum that never falls below zero. A start that opens the n-th call and the next terminal
    event that finds n calls open belong together, so both are neighbours among the events of that level; windows spill, and no group is held whole.
    """
    group = ["session", "tool"]
    order = [F.col("ts"), F.col("event_id")]
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.col("kind") == "tool_start", F.lit(False))
    e = events.select(*group, "event_id", "ts", "kind", "args", F.nanvl(F.col("elapsed_ms").cast("double"), F.lit(None).cast("double")).alias("elapsed_ms"), starts.alias("opens"))
    e = e.withColumn("sum", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(so_far))
    e = e.withColumn("open", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    before = F.lag("open", 1, 0).over(Window.partitionBy(*group).orderBy(*order))
    e = e.withColumn("level", F.when(F.col("opens"), F.col("open")).otherwise(before))
    level = Window.partitionBy(*group, "level").orderBy(*order)
    own = F.struct("event_id", "ts", "args")
    e = e.withColumn("start", F.when(F.col("opens"), own).when(F.col("level") > 0, F.lag(own).over(level))).withColumn("ends", F.lead("event_id").over(level).isNotNull())
    took = (F.unix_micros("ts") - F.unix_micros("start.ts")) / 1000
    ended = lambda c: F.when(~F.col("opens"), c)
    return e.where("not (opens and ends)").select(
        *group, F.col("start.event_id").alias("start_id"), ended(F.col("event_id")).alias("end_id"), F.when(F.col("opens"), "running").when(F.col("kind") == "tool_done", "done").otherwise("error").alias("status"),
        F.coalesce("args", "start.args").alias("args"), ended(F.coalesce("elapsed_ms", took)).alias("elapsed_ms"),
    )


class CallsOfASession(StatefulProcessor):
    """Events of a session wait until the watermark has passed their slot of event time; then they are folded in order, tool by tool.

    Each call of the state store costs far more than an event, so a session has one value with its open calls, its waiting events and its one timer. If more
    than LIMIT events wait, they go to blocks of that size at most, cut between slots; the value then knows where the blocks begin. What is in memory is
    a block, or one slot of one session if that holds more, and the calls that are open.
    """

    def __init__(self, slot_ms: int, timeout_ms: int, limit: int) -> None:
        self.slot, self.timeout, self.limit = slot_ms, timeout_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held string")
        self.waiting = handle.getMapState("blocks", "first bigint", "events string")

    def end_of(self, ms: int) -> int:
        return (ms // self.slot + 1) * self.slot

    def state(self) -> tuple[list, list, list, int | None]:
        """Open calls (tool, id, ms, args) in order, waiting events, [slot from which a block has its events, its least time] in order, and the earliest timer."""
        found = self.held.get()
        return tuple(json.loads(found[0])) if found is not None else ([], [], [], None)

    def keep(self, calls: list, events: list, blocks: list, timer: int | None) -> None:
        """Writes what is left, with a timer for the end of the next slot that has something in it; it runs out once the watermark is there."""
        first = min((e[0] for e in events), default=blocks[0][1] if blocks else None)
        due = [self.end_of(first)] if first is not None else []
        due += [self.end_of(min(c[2] for c in calls) + self.timeout)] if calls else []
        if not due:
            self.held.clear()
            return
        if timer is None or min(due) < timer:
            timer = min(due)
            self.handle.registerTimer(timer - 1)
        self.held.update((json.dumps((calls, events, blocks, timer)),))

    def pieces(self, events: list) -> Iterator[list]:
        """Events in order, cut between slots into pieces of half a block; a slot that holds more is a piece of its own."""
        piece: list = []
        for _, own in groupby(sorted(events, key=lambda e: e[:2]), key=lambda e: e[0] // self.slot):
            same = list(own)
            if piece and len(piece) + len(same) > self.limit // 2:
                yield piece
                piece = []
            piece += same
        yield piece

    def put(self, blocks: list, events: list) -> list:
        """Events into the blocks that their slots belong to; blocks that grow too large are cut. The blocks after it."""
        starts, by = [b[0] for b in blocks], {}
        for e in events:
            by.setdefault(max(0, bisect_right(starts, e[0] // self.slot) - 1), []).append(e)
        after = [[b] for b in blocks] or [[]]
        for k, new in by.items():
            first = starts[k] if starts else min(e[0] for e in new) // self.slot
            old = json.loads(self.waiting.getValue((first,))[0]) if starts else []
            whole = old + new
            parts = list(self.pieces(whole)) if len(whole) > self.limit else [whole]
            after[k] = []
            for part in parts:
                least = min(e[0] for e in part)
                start = least // self.slot if len(parts) > 1 else first
                self.waiting.updateValue((start,), (json.dumps(part),))
                after[k].append([start, least])
            if starts and all(b[0] != first for b in after[k]):
                self.waiting.removeKey((first,))
        return [b for some in after for b in some]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        calls, events, blocks, timer = self.state()
        for some in batched(rows, self.limit):
            events += [[r.ms, r.event_id, r.tool, r.kind, r.args, r.elapsed_ms] for r in some]
            if blocks or len(events) > self.limit:
                blocks, events = self.put(blocks, events), []
        self.keep(calls, events, blocks, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // self.slot * self.slot
        calls, events, blocks, timer = self.state()
        running: dict = {}
        for tool, *call in calls:
            running.setdefault(tool, deque()).append(call)

        def unfinished(tool, before: int) -> Iterator[Row]:
            own = running.get(tool)
            while own and own[0][1] + self.timeout < before:
                start, _, args = own.popleft()
                yield Row(session=key[0], tool=tool, start_id=start, end_id=None, status="unfinished", args=args, elapsed_ms=None)

        def folded(due: list) -> Iterator[Row]:
            for ms, event, tool, kind, args, took in sorted(due, key=lambda e: e[:2]):
                yield from unfinished(tool, ms)
                own = running.setdefault(tool, deque())
                if kind == "tool_start":
                    own.append((event, ms, args))
                    continue
                start, began, given = own.pop() if own else (None, None, None)
                lasted = took if took is not None else float(ms - began) if began is not None else None
                yield Row(session=key[0], tool=tool, start_id=start, end_id=event, status="done" if kind == "tool_done" else "error", args=args if args is not None else given, elapsed_ms=lasted)

        if not blocks:
            yield from folded([e for e in events if e[0] < now])
            events = [e for e in events if e[0] >= now]
        while blocks and blocks[0][1] < now:
            first = (blocks[0][0],)
            block = json.loads(self.waiting.getValue(first)[0])
            yield from folded([e for e in block if e[0] < now])
            if rest := [e for e in block if e[0] >= now]:
                self.waiting.updateValue(first, (json.dumps(rest),))
                blocks[0][1] = min(e[0] for e in rest)
            else:
                self.waiting.removeKey(first)
                del blocks[0]
        for tool in running:
            yield from unfinished(tool, now)
        self.keep([(tool, *c) for tool, own in running.items() for c in own], events, blocks, timer if timer is not None and timer > now else None)

    def close(self) -> None:
        pass


def stream_traces(events: DataFrame, watermark: str = "10 minutes", timeout_ms: int = 3_600_000, slot_ms: int = 600_000) -> DataFrame:
    """Traces as an append-only stream, the same however the events are cut into triggers and ordered in them: a call is given out when the watermark has
    passed the slot of event time in which it ended, or in which its time-out ran out. Events behind the watermark are late and dropped. Times are in milliseconds."""
    took = F.nanvl(F.col("elapsed_ms").cast("double"), F.lit(None).cast("double"))
    timed = events.withWatermark("ts", watermark).select("session", "tool", "event_id", "ts", F.unix_millis("ts").alias("ms"), "kind", "args", took.alias("elapsed_ms"))
    return timed.groupBy("session").transformWithState(CallsOfASession(slot_ms, timeout_ms, LIMIT), TRACE, "Append", "EventTime")


def recent(events: DataFrame, keep: int = 100, by: str = "session") -> DataFrame:
    """The newest events of each session."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("__n", n).where(F.col("__n") <= keep).drop("__n")


class NewestEvents(StatefulProcessor):
    """The newest `keep` events of a key, in a list; what enters and leaves it is given out."""

    def __init__(self, keep: int, fields: list[str]) -> None:
        self.keep, self.fields = keep, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", "us bigint, event_id bigint, row string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(x) for x in self.newest.get()] if self.newest.exists() else []
        now = set(before) | set(heapq.nlargest(self.keep, ((r.us, r.event_id, r.row) for r in rows)))
        now = set(heapq.nlargest(self.keep, now))
        self.newest.put(sorted(now))
        change = [(x, 1) for x in now.difference(before)] + [(x, -1) for x in set(before) - now]
        return iter([Row(key=key[0], event_id=x[1], row=x[2], change=n) for x, n in change])

    def close(self) -> None:
        pass


def recent_stream(events: DataFrame, store: str, keep: int = 100, by: str = "session") -> DataFrame:
    """The newest events of each session, kept up by a stream; ties in ts go by event_id, and repeated events count once.

    The state of a session is a list of `keep` events; a trigger appends to the store what enters and leaves the lists, so its work goes by its new
    events, and nothing is written anew. Returns the events that are in the lists when all that has arrived is taken in.
    """
    packed = events.select(F.col(by).cast("string").alias("key"), F.unix_micros("ts").alias("us"), "event_id", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("row"))
    changes = packed.groupBy("key").transformWithState(NewestEvents(keep, events.columns), "key string, event_id bigint, row string, change int", "Update", "None")
    log = run_to_end(changes, store)
    held = log.groupBy("key", "event_id", "row").agg(F.sum("change").alias("n")).where("n > 0")
    return held.select(F.from_json("row", events.schema).alias("e")).select("e.*")


def badge(tool: str = "tool", result: str = "result") -> F.Column:
    """The short count that is shown beside a tool's result (JSON text), folded from its nested parts; null for other tools, errors and broken JSON.

    search: chunks and documents of its groups; navigate: nodes at any depth of one level of nesting; graph: links; raw: the line range; curate: edges
    added and removed; answer: citations, or that it abstained.
    """
    v = F.try_parse_json(F.col(result))

    def array(path: str, kind: str) -> F.Column:
        return F.coalesce(F.try_variant_get(v, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))

    groups = array("$.groups", "struct<doc_slug string, chunks array<struct<path string>>>")
    chunks = F.aggregate(groups, F.lit(0), lambda n, g: n + F.greatest(F.size(g["chunks"]), F.lit(0)))
    documents = F.size(F.array_distinct(F.transform(groups, lambda g: g["doc_slug"])))
    nodes = array("$.nodes", "struct<path string, children array<struct<path string>>>")
    count = F.aggregate(nodes, F.lit(0), lambda n, x: n + 1 + F.greatest(F.size(x["children"]), F.lit(0)))
    links = F.aggregate(array("$.steps", "struct<targets array<string>>"), F.lit(0), lambda n, x: n + F.greatest(F.size(x["targets"]), F.lit(0)))
    first, last = F.try_variant_get(v, "$.start_line", "bigint"), F.try_variant_get(v, "$.end_line", "bigint")
    added, removed = F.size(array("$.added", "variant")), F.size(array("$.removed", "variant"))
    abstained = F.coalesce(F.try_variant_get(v, "$.abstained", "boolean"), F.lit(False))
    cited = F.size(array("$.citations", "variant"))
    t, said = F.col(tool), lambda n, what: F.concat(n.cast("string"), F.lit(what))
    shown = (
        F.when(t == "search", F.concat(said(chunks, " chunks · "), said(documents, " documents")))
        .when(t == "navigate", said(count, " nodes"))
        .when(t == "graph", said(links, " links"))
        .when(t == "raw", F.concat(F.lit("lines "), said(first, "–"), last.cast("string")))
        .when(t == "curate", F.concat(F.lit("+"), said(added, " −"), removed.cast("string")))
        .when(t == "answer", F.when(abstained, "abstained").otherwise(said(cited, " citations")))
    )
    return F.when(v.isNotNull() & F.try_variant_get(v, "$.error", "string").isNull(), shown)
