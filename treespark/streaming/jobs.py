"""Streaming forms.

Watermarks bound all state but that of E6, E7 and fresh_gauges_stream: joins and windows drop what they have passed, stateful operators set event-time timers.
E6's state is the index itself, one row a path, with the last SEEN seqs of each; E7's are the open asks. fresh_gauges_stream keeps one number a session,
and forgets it by processing time only where keep_ms is given (with availableNow such a stream never ends); gauge_states_stream forgets by event time.
Where keys are many and small (E4, E7), a bucket of them is one key of state, so that what a call costs isn't paid for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.events import debounce, pair_renames
from ..operators.status import classify_health, flow_counters


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is there now through a stream, as the table name. For tests and reports; services start their own sink."""
    spark = stream.sparkSession
    out = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
    query.awaitTermination()
    return spark.table(name)


def debounce_stream(events: DataFrame, gap: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """E2 on a stream."""
    return debounce(events.withWatermark("ts", late), gap)


def flow_counters_stream(messages: DataFrame, interval: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """E8. M1 on a stream."""
    return flow_counters(messages.withWatermark("ts", late), interval)


def health_stream(messages: DataFrame, interval: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """E8. M5 over M1 on a stream; queues are 0 and errors are rejects where the messages don't carry them."""
    sums = flow_counters_stream(messages, interval, late)
    queues = {q: F.lit(0) for q in ("outbox", "pending", "pending_pulls", "pending_renames")}
    return classify_health(sums.withColumns({**queues, "errors": F.col("cas_reject")})).drop(*queues, "errors")


#: Keys of state that the paths of a stream share: a call of a stateful operator, and of its state, costs milliseconds.
BUCKETS = 1024
#: The time of rows without one.
NEVER = -(1 << 63)
ECHO_COLUMNS = ["ck", "path", "id", "us", "event", "content_hash"]
ASK_COLUMNS = ["seq", "ck", "path", "want_hash", "op"]


def _bucket(buckets: int, *names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("bucket")


def _tuples(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*[frame[c].tolist() for c in columns])


#: How many of a path's last seqs are kept, to tell repeated changes from late ones.
SEEN = 256


class FoldChanges(StatefulProcessor):
    """E6. Per path: the current node and the last seqs; a verdict for each change. A repeated seq says nothing; a change whose seq is
    below one already folded has the verdict `late` and changes nothing (so has a repeat from before the last SEEN ones)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("row", "node string, seqs array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq")
        node, seqs = self.state.get() if self.state.exists() else (None, [])
        seqs = list(seqs)
        out = []
        for c in log.itertuples():
            if c.seq in seqs:
                continue
            if seqs and c.seq < seqs[-1]:
                out.append((key[0], key[1], c.seq, "late", node))
                continue
            basis = c.basis if isinstance(c.basis, str) else None
            ok = node is None if c.op != "delete" and basis is None else node is not None and node == basis
            out.append((key[0], key[1], c.seq, "accept" if ok else "reject", node))
            if ok:
                node = None if c.op == "delete" else c.new_node
            seqs = [*seqs, c.seq][-SEEN:]
        self.state.update((node, seqs))
        yield pd.DataFrame(out, columns=["ck", "path", "seq", "verdict", "current"])

    def close(self) -> None:
        pass


def fold_changes_stream(changes: DataFrame) -> DataFrame:
    """E6. (ck, path, seq, verdict, current): accept, reject, or late for changes that come after one of a greater seq."""
    kind = "ck string, path string, seq long, verdict string, current string"
    return changes.select("ck", "path", "seq", "op", "basis", "new_node").groupBy("ck", "path").transformWithStateInPandas(FoldChanges(), kind, "Append", "None")


class FreshGauges(StatefulProcessor):
    """E9. Per (peer, generation): the largest seq so far; frames that aren't newer are dropped. State is one number for each
    session of a peer, forgotten keep_ms after its last frame."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "seq bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values(["received", "seq"])
        top = self.top.get()[0] if self.top.exists() else None
        out = []
        for g in log.itertuples():
            if top is None or g.seq > top:
                top = g.seq
                out.append((key[0], key[1], g.seq, g.received, g.stage, g.depth))
        if top is not None:
            self.top.update((top,))
        yield pd.DataFrame(out, columns=["peer", "generation", "seq", "received", "stage", "depth"])

    def close(self) -> None:
        pass


def fresh_gauges_stream(gauges: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """E9. M8's filter by seq on a stream: the accepted gauges (peer, generation, seq, received, stage, depth). A session silent for
    keep_ms is forgotten; three intervals at least, as gauges older than that are stale."""
    kind = "peer string, generation long, seq long, received timestamp, stage string, depth long"
    rows = gauges.select("peer", "generation", "seq", "received", "stage", "depth").groupBy("peer", "generation")
    return rows.transformWithStateInPandas(FreshGauges(keep_ms), kind, "Append", "ProcessingTime" if keep_ms else "None")


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class GaugeStates(StatefulProcessor):
    """E9. Per (peer, generation): the largest seq, when its frame came, and if it has gone stale since."""

    def __init__(self, stale_us: int, forget_us: int):
        self.stale, self.forget = stale_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq bigint, at bigint, stale boolean")

    def _rows(self, key, told: list) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], key[1], seq, at, state) for seq, at, state in told], columns=["peer", "generation", "seq", "at", "state"])
        return out.assign(at=pd.to_datetime(out["at"], unit="us"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, at, stale = self.last.get() if self.last.exists() else (None, None, True)
        told = []
        for g in pd.concat(list(rows)).sort_values(["received", "seq"]).itertuples():
            if seq is not None and g.seq <= seq:
                continue
            if not stale and g.received.value // 1000 - at > self.stale:
                told.append((seq, at + self.stale, "stale"))
            seq, at, stale = int(g.seq), g.received.value // 1000, False
            told.append((seq, at, "fresh"))
        if told:
            self.last.update((seq, at, stale))
            self.handle.registerTimer((at + self.stale) // 1000 + 1)
        yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = []
        if self.last.exists():
            (seq, at, stale), now = self.last.get(), expiredTimerInfo.getExpiryTimeInMs() * 1000
            if not stale and now >= at + self.stale:
                told.append((seq, at + self.stale, "stale"))
                self.last.update((seq, at, True))
                self.handle.registerTimer((at + self.forget) // 1000 + 2)
            elif stale and now >= at + self.forget:
                self.last.clear()
        yield self._rows(key, told)

    def close(self) -> None:
        pass


def gauge_states_stream(gauges: DataFrame, interval_s: int = 5, late: str = "10 seconds", forget_s: int = 3600) -> DataFrame:
    """E9. (peer, generation, seq, at, state): `fresh` for each accepted frame (M8's filter by seq), and `stale` three intervals after
    the last one, when none has come by then (15 s for an interval of 0). It goes by event time: a timer fires when the watermark, `late` behind the newest
    frame, has passed. A session silent for forget_s is forgotten."""
    stale = 3_000_000 * (interval_s or 5)
    rows = gauges.select("peer", "generation", "seq", "received").withWatermark("received", late).groupBy("peer", "generation")
    kind = "peer string, generation long, seq long, at timestamp, state string"
    return rows.transformWithStateInPandas(GaugeStates(stale, max(forget_s * 1_000_000, stale)), kind, "Append", "EventTime")


class Echoes(StatefulProcessor):
    """E4. Per bucket of paths: each path's armed write and until when, and the next timer. Writes come as rows with event `Applied`; times
    are microseconds, NEVER where there is none: such events are no echoes."""

    def __init__(self, debounce_ms: int):
        self.armed_ms = 2 * debounce_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "due bigint, cks array<string>, paths array<string>, written array<string>, until array<bigint>")

    def _load(self) -> tuple[int | None, dict]:
        due, cks, paths, written, until = self.armed.get() or (None, [], [], [], [])
        return due, dict(zip(zip(cks, paths), zip(written, until)))

    def _store(self, due: int | None, arms: dict) -> None:
        if not arms:
            self.armed.clear()
            return
        soonest = min(until for _, until in arms.values()) + 1
        if due is None or soonest < due:
            self.handle.registerTimer(soonest)
            due = soonest
        self.armed.update((due, [k[0] for k in arms], [k[1] for k in arms], [a[0] for a in arms.values()], [a[1] for a in arms.values()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, before = self._load()
        arms, out = dict(before), []
        for ck, path, id_, us, event, content_hash in sorted(_tuples(rows, ECHO_COLUMNS), key=lambda e: (e[3], e[4] != "Applied", e[2])):
            arm = arms.get((ck, path))
            if event == "Applied":
                if us != NEVER:
                    arms[ck, path] = (content_hash, us // 1000 + self.armed_ms)
                continue
            if arm and us != NEVER and us // 1000 <= arm[1]:
                if event == "Removed":
                    continue
                if content_hash == arm[0]:
                    del arms[ck, path]
                    continue
            out.append((ck, path, id_, us, event, content_hash))
        if arms != before:
            self._store(due, arms)
        yield pd.DataFrame(out, columns=ECHO_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, arms = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if due is not None and due <= now:
            self._store(None, {k: a for k, a in arms.items() if a[1] >= now})
        yield pd.DataFrame([], columns=ECHO_COLUMNS)

    def close(self) -> None:
        pass


def suppress_echo_stream(events: DataFrame, debounce_ms: int = 200, late: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """E4 on a stream of events and writes (event `Applied`, which come first of what is at one time): (ck, path, id, ts, event, content_hash). A
    write that no event follows is forgotten when the watermark, `late` behind the newest event, has passed its time. Paths share `buckets` keys of state."""
    rows = events.select("ck", "path", "id", "ts", "event", "content_hash").withWatermark("ts", late)
    rows = rows.withColumns({"us": F.coalesce(F.unix_micros("ts"), F.lit(NEVER)), "bucket": _bucket(buckets, "ck", "path")}).groupBy("bucket")
    told = rows.transformWithStateInPandas(Echoes(debounce_ms), "ck string, path string, id long, us long, event string, content_hash string", "Append", "EventTime")
    return told.select("ck", "path", "id", F.when(F.col("us") != NEVER, F.timestamp_micros("us")).alias("ts"), "event", "content_hash")


def pair_renames_stream(events: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """E3 on a stream: the two halves are joined as streams with a watermark each, so a half without partner comes out as Removed or Changed once
    the watermark is past its time and the window, and the state holds no more than that span."""
    return pair_renames(events.withWatermark("ts", late), window)


class OpenAsks(StatefulProcessor):
    """E7. Per bucket of (ck, path, want_hash): those whose ask is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "cks array<string>, paths array<string>, wants array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = set(zip(*(self.open.get() or ([], [], []))))
        is_open, out = set(before), []
        for seq, ck, path, want_hash, op in sorted(_tuples(rows, ASK_COLUMNS), key=lambda a: a[0]):
            ask = (ck, path, want_hash)
            if op != "ask":
                is_open.discard(ask)
            elif ask not in is_open:
                out.append((seq, *ask, op))
                is_open.add(ask)
        if not is_open and before:
            self.open.clear()
        elif is_open != before:
            self.open.update(tuple(map(list, zip(*is_open))))
        yield pd.DataFrame(out, columns=ASK_COLUMNS)

    def close(self) -> None:
        pass


def dedupe_asks_stream(asks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """E7 on a stream: asks (seq, ck, path, want_hash, op ask|done) without those made while an equal one is open; rows of a key come in order of seq
    from batch to batch. Keys share `buckets` keys of state."""
    rows = asks.select(*ASK_COLUMNS, _bucket(buckets, "ck", "path", "want_hash")).groupBy("bucket")
    return rows.transformWithStateInPandas(OpenAsks(), "seq long, ck string, path string, want_hash string, op string", "Append", "None")


class Limits(StatefulProcessor):
    """M13. Per address: the allowed attempts of the last window, `most` at most."""

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getValueState("hits", "at array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits, out = (list(self.hits.get()[0]) if self.hits.exists() else []), []
        for a in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            now = _ms(a.ts)
            hits = [h for h in hits if now - h < self.window_ms]
            allowed = len(hits) < self.most
            hits += [now] if allowed else []
            out.append((key[0], a.id, allowed))
        if hits:
            self.hits.update((hits,))
            self.handle.registerTimer(hits[-1] + self.window_ms)
        yield pd.DataFrame(out, columns=["ip", "id", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.hits.exists() and self.hits.get()[0][-1] + self.window_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.hits.clear()
        yield pd.DataFrame([], columns=["ip", "id", "allowed"])

    def close(self) -> None:
        pass


def rate_limit_stream(attempts: DataFrame, most: int, window_s: int = 60, late: str = "10 seconds") -> DataFrame:
    """M13 on a stream: (ip, id, allowed). An address is forgotten a window after its last allowed attempt, by the watermark."""
    rows = attempts.select("ip", "ts", F.col("id").cast("long").alias("id")).withWatermark("ts", late).groupBy("ip")
    return rows.transformWithStateInPandas(Limits(most, window_s * 1000), "ip string, id long, allowed boolean", "Append", "EventTime")


def merge_stream_into_index(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """S9. A stream of leaf changes ([ck,] path, seq, meta fields[, last_node, last_content]; kind null deletes) into the snapshot at root. A path's
    greatest seq counts, over all batches and streams: a late one changes nothing. Each micro-batch commits one delta of the rows it
    changes; the version names the stream (by an id kept in its checkpoint folder) and its batch, so a repeated batch changes nothing, and
    any number of streams can feed one index. Without ck the changes are of the namespace ''. Other columns of the index stay with their paths."""
    from ..sources.snapshots import latest_manifest, stream_id
    from ..sources.tree_index import update_index

    own = stream_id(changes.sparkSession, checkpoint)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        if latest_manifest(spark, root)["streams"].get(own, -1) < batch_id:
            update_index(spark, root, batch if "ck" in batch.columns else batch.withColumn("ck", F.lit("")), {own: batch_id})

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
