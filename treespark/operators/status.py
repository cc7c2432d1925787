"""Status of a fleet from its message log, queues and gauges."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import decide, null_safe
from .ordered import by_part, continued, in_parts

#: Messages that each counter counts.
COUNTED = {
    "cas_accept": ["CasAccept"], "cas_reject": ["CasReject"], "apply_ok": ["ApplyOk"], "apply_fail": ["ApplyFail"], "bulk_in": ["BulkIn"], "bulk_out": ["BulkOut"],
    "dir_list": ["DirListRequest", "DirList"], "root": ["RootReport", "RootAck"], "local": ["Local"], "rescan": ["Rescan"], "flushed": ["Flushed"], "fanout_dropped": ["FanoutDropped"],
}
COUNTERS = ["in_msgs", "out_msgs", "cas_accept", "cas_reject", "apply_ok", "apply_fail", "bulk_in", "bulk_out", "bytes_in", "bytes_out", "dir_list", "root", "local", "rescan", "flushed", "fanout_dropped"]
ADVANCING = ["cas_accept", "apply_ok", "bulk_in", "bulk_out", "dir_list", "root", "local", "rescan", "flushed"]
QUEUES = ["pending", "outbox", "pending_pulls", "pending_renames", "parked", "sending"]


def counters() -> list[Column]:
    msg, size = F.col("msg"), F.coalesce("bytes", F.lit(0)).cast("bigint")
    found = {name: F.count_if(msg.isin(*kinds)) for name, kinds in COUNTED.items()}
    found |= {"in_msgs": F.count_if(F.col("direction") == "in"), "out_msgs": F.count_if(F.col("direction") == "out")}
    found |= {f"bytes_{way}": F.sum(F.when(msg == kind, size).otherwise(0)).cast("bigint") for way, kind in (("in", "BulkIn"), ("out", "BulkOut"))}
    return [F.coalesce(found[c], F.lit(0)).alias(c) for c in COUNTERS]


def flow_counters(messages: DataFrame, interval: str = "5 seconds") -> DataFrame:
    """M1. The counters of each window (from window_start) and slave. Works on a stream with a watermark as well."""
    return messages.groupBy(F.window("ts", interval), "slave").agg(*counters()).select(F.col("window.start").alias("window_start"), "slave", *COUNTERS)


def fleet_status(messages: DataFrame, sessions: DataFrame, interval: str = "5 seconds") -> DataFrame:
    """M2. Counters by slave and, where slave is null, of the fleet; connected: the sessions (slave, connected) that are up."""
    keyed = messages.withColumn("window_start", F.window("ts", interval)["start"])
    sums = keyed.groupingSets([["window_start", "slave"], ["window_start"]], "window_start", "slave").agg(*counters(), F.grouping("slave").alias("_fleet"))
    up = sessions.where("connected").select("slave", F.lit(1).alias("_up")).distinct()
    n = sessions.where("connected").agg(F.count_distinct("slave").alias("_n"))
    rows = sums.join(up, "slave", "left").join(F.broadcast(n))  # one row
    connected = F.when(F.col("_fleet") == 1, F.col("_n")).otherwise(F.coalesce("_up", F.lit(0))).cast("bigint")
    return rows.withColumn("connected", connected).drop("_fleet", "_up", "_n").orderBy("window_start", F.col("slave").asc_nulls_first())


def counter_deltas(samples: DataFrame, names: list[str], consumer: str = "consumer") -> DataFrame:
    """M3. samples (consumer, ts, cumulative counters) as increases since the consumer's last sample, 0 at least."""
    w = Window.partitionBy(consumer).orderBy("ts")
    return samples.select(consumer, "ts", *[F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)).alias(c) for c in names])


def clean_reason(raw: Column) -> Column:
    joined = F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), " ", "_")
    return F.left(F.regexp_replace(joined, r"[^\x21-\x7E]", "_"), F.lit(160))


def last_errors(messages: DataFrame, interval: str = "5 seconds") -> DataFrame:
    """M4. For each window and slave with an error (a reason): the last reason, and how often it came in a row at the end."""
    rows = messages.where("reason is not null").select(F.window("ts", interval)["start"].alias("window_start"), "slave", "ts", clean_reason(F.col("reason")).alias("reason"))
    by = Window.partitionBy("window_start", "slave")
    back = by.orderBy(F.desc("ts"), F.desc("reason"))
    last = rows.withColumns({"last": F.first("reason").over(back), "ended": F.max(F.when(F.col("reason") != F.first("reason").over(back), 1).otherwise(0)).over(back)})
    return last.where("ended = 0").groupBy("window_start", "slave").agg(F.first("last").alias("reason"), F.count("*").alias("count"))


def health(errors: str = "errors") -> Column:
    advancing = sum((F.col(c) for c in ADVANCING), F.lit(0))
    stalled = (
        ((F.col("outbox") > 0) & (F.col("flushed") == 0))
        | ((F.col("pending") > 0) & (F.col("bulk_in") == 0) & (F.col("apply_ok") == 0))
        | ((F.col("pending_pulls") > 0) & (F.col("dir_list") == 0) & (F.col("in_msgs") == 0))
        | ((F.col("pending_renames") > 0) & (F.col("cas_accept") == 0) & (F.col("cas_reject") == 0))
    )
    return decide((stalled, "stuck"), ((F.col(errors) > 0) & (advancing == 0), "failed"), (advancing > 0, "busy"), otherwise="idle")


def classify_health(status: DataFrame) -> DataFrame:
    """M5. status (counters, queues, errors) with health."""
    return status.withColumn("health", health())


def queue_waits(events: DataFrame) -> DataFrame:
    """M6. (stage, peer, since, depth) of queues from events (ts, stage, peer, key, op insert|remove): a key waits from its
    first insert after its last remove."""
    last = events.where("op = 'remove'").groupBy("stage", "peer", "key").agg(F.max("ts").alias("_gone"))
    rows = null_safe(events.where("op = 'insert'"), last, ["stage", "peer", "key"], "left").where("_gone is null or ts > _gone")
    keys = rows.groupBy("stage", "peer", "key").agg(F.min("ts").alias("since"))
    return keys.groupBy("stage", "peer").agg(F.min("since").alias("since"), F.count("*").alias("depth"))


REFINES = ["fulfill_parked", "fulfill_read", "uplink", "hashing"]


def bottleneck(waits: DataFrame, now: Column, by: list[str] = ()) -> DataFrame:
    """M7. Of each group by, the wait (stage, peer, since, depth, source) that holds it up, with age_ms at now."""
    by = list(by)
    shade = waits.where(F.col("stage").isin("fulfill_parked", "fulfill_read")).select(*by, "peer", F.lit(True).alias("_shade")).distinct()
    rows = null_safe(waits, shade, [*by, "peer"], "left").where((F.col("stage") != "reconcile") | F.col("_shade").isNull()).drop("_shade")
    wait, order = F.struct("stage", "peer", "since", "depth", "source"), F.struct("since", "peer", "stage", "depth")  # null peers first

    def top(df: DataFrame) -> DataFrame:
        return df.groupBy(*by).agg(F.min_by(wait, order).alias("w")).where("w is not null").select(*by, "w.*")

    winner = top(rows)
    finer = null_safe(waits.where(F.col("stage").isin(*REFINES)), winner.where("stage = 'origin_bytes'").select(*by, "peer"), [*by, "peer"])
    best = top(finer)
    if by:
        chosen = null_safe(winner, best.select(*by, F.struct("stage", "peer", "since", "depth", "source").alias("_b")), by, "left")
    else:
        chosen = winner.join(best.select(F.struct("stage", "peer", "since", "depth", "source").alias("_b")), F.lit(True), "left")  # one row each
    pick = F.coalesce("_b", F.struct("stage", "peer", "since", "depth", "source"))
    out = chosen.select(*by, pick.alias("p")).select(*by, "p.stage", "p.peer", "p.since", "p.depth", "p.source")
    return out.withColumn("age_ms", F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis("since")))


def accepted_gauges(gauges: DataFrame) -> DataFrame:
    """Gauges whose seq is above all before it of their peer and generation."""
    before = Window.partitionBy("peer", "generation").orderBy("received", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return gauges.withColumn("_top", F.max("seq").over(before)).where("_top is null or seq > _top").drop("_top")


def fresh_gauges(gauges: DataFrame, peers: DataFrame, now: Column, interval_s: int = 5) -> DataFrame:
    """M8. For each of peers (peer): state fresh, stale or absent of the last accepted gauge of its last generation; where
    fresh, its stage, since_ms (when its wait began) and queues."""
    newest = accepted_gauges(gauges).groupBy("peer").agg(F.max_by(F.struct(*[c for c in gauges.columns if c != "peer"]), F.struct("generation", "received", "seq")).alias("g"))
    limit = 3 * (interval_s or 5) * 1000
    rows = peers.select("peer").distinct().join(newest, "peer", "left")
    age = F.unix_millis(now) - F.unix_millis("g.received")
    state = decide((F.col("g").isNull(), "absent"), (age > limit, "stale"), otherwise="fresh")
    fresh = lambda c: F.when(F.col("state") == "fresh", c)
    rows = rows.withColumn("state", state)
    return rows.select(
        "peer", "state",
        decide((F.col("state") != "fresh", "unobserved"), otherwise=None).alias("_none"),
        *[fresh(F.col(f"g.{c}")).alias(c) for c in ("stage", "depth", "parked", "sending", "pending")],
        fresh(F.unix_millis("g.received") - F.col("g.age_ms")).alias("since_ms"),
    ).withColumn("stage", F.coalesce("_none", "stage")).drop("_none")


def peer_board(reports: DataFrame, sessions: DataFrame, acl: DataFrame, now: Column, fresh_s: int = 15) -> DataFrame:
    """M9. For each id of acl (peer): connected, fresh, pace and depth, from reports (peer, generation, seq, at, pace, depth)
    of the current non-zero generation in sessions (peer, generation, connected)."""
    current = reports.join(sessions.select("peer", "generation").where("generation <> 0"), ["peer", "generation"], "left_semi")
    before = Window.partitionBy("peer", "generation").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = current.withColumn("_top", F.max("seq").over(before)).where("_top is null or seq > _top")
    last = kept.groupBy("peer").agg(F.max_by(F.struct("at", "pace", "depth"), F.struct("at", "seq")).alias("r"))
    rows = acl.select("peer").distinct().join(sessions.select("peer", "connected"), "peer", "left").join(last, "peer", "left")
    connected = F.coalesce("connected", F.lit(False))
    heard = F.coalesce(F.unix_millis(now) - F.unix_millis("r.at") < fresh_s * 1000, F.lit(False))
    return rows.select("peer", connected.alias("connected"), (connected & heard).alias("fresh"), F.coalesce("r.pace", F.lit("idle")).alias("pace"), F.coalesce("r.depth", F.lit(0).cast("bigint")).alias("depth"))


def peer_views(board: DataFrame) -> DataFrame:
    """M10. What each peer sees: every other peer. The result itself has all pairs; a board has one row a configured peer."""
    viewers = board.select(F.col("peer").alias("viewer"))
    return viewers.join(board, F.col("viewer") != F.col("peer"))


def self_reports(status: DataFrame) -> DataFrame:
    """M11. pace and depth that a peer (slave) reports of itself: the sum of its six queues, up to 2^32 - 1."""
    pace = decide((F.col("health").isin("stuck", "failed"), "stuck"), (F.col("health") == "busy", "busy"), otherwise="idle")
    return status.select("slave", pace.alias("pace"), F.least(F.lit(2**32 - 1), sum((F.col(c) for c in QUEUES), F.lit(0))).cast("bigint").alias("depth"))


def idle_reasks(pending: DataFrame, gauges: DataFrame, now: Column, interval_s: int = 5) -> DataFrame:
    """M12. Pending rows (peer, path, asked) last asked an interval ago or more, of peers whose fresh gauge shows nothing
    to do."""
    state = fresh_gauges(gauges, pending, now, interval_s).where("state = 'fresh' and stage is null and sending = 0 and parked = 0").select("peer")
    return pending.where(F.unix_millis(now) - F.unix_millis("asked") >= interval_s * 1000).join(state, "peer", "left_semi")


#: Rounds of guessed starts before what is still open of a hot address is walked in one task.
GUESSES = 6


def rate_limit(attempts: DataFrame, most: int, window_s: int = 60, part_rows: int | None = None) -> DataFrame:
    """M13. attempts (ip, ts, id) with allowed: fewer than `most` allowed ones of that address in the window before.

    Attempts are sorted by address and time and cut into parts of bounded size (operators/ordered.py); the state is the allowed ones of the window, `most` at
    most. A part that continues an address starts from the part before: first as if nothing was allowed there, then from what that part ended with,
    again for those whose start has changed. A pause of a window, or a stretch below the limit, makes a part's end independent of its
    start, so this mostly settles at once; what hasn't after GUESSES rounds (an address far beyond the limit without pause, whose
    allowed attempts hang on each other all the way) is walked in order by one task, with one small state a part.
    """

    def walk(ip, hits: deque, ips: list, ats: list) -> tuple[object, list[bool]]:
        allowed = []
        for own, at in zip(ips, ats):
            if own != ip:
                ip = own
                hits.clear()
            while hits and at - hits[0] >= window_s * 1000:
                hits.popleft()
            allowed.append(len(hits) < most)
            if allowed[-1]:
                hits.append(at)
        return ip, allowed

    def ends(starts: dict[int, list], chained: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, ip, hits, out = None, None, deque(), []
            for batch in batches:
                for p, rows in batch.groupby("_part", sort=False):
                    if p != part:
                        out += [] if part is None else [(part, list(hits))]
                        if not chained or p in starts or part is None:
                            hits = deque(starts.get(p, ()))
                            ip = rows["ip"].iloc[0]
                        part = p
                    ip, _ = walk(ip, hits, rows["ip"].tolist(), rows["seq"].tolist())
            yield pd.DataFrame(out + ([] if part is None else [(part, list(hits))]), columns=["_part", "hits"])

        return run

    table = in_parts(attempts.select("ip", "id", F.unix_millis("ts").alias("seq")), ["ip"], ["seq", "id"], part_rows)
    prev = continued(table, ["ip"])
    starts: dict[int, list] = {p: [] for p in prev}
    ended: dict[int, list] = {}
    todo = sorted({*prev, *[p - 1 for p in prev]})
    for _ in range(GUESSES):
        if not todo:
            break
        rows = table.where(F.col("_part").isin(todo)).select("_part", "_pos", "ip", "seq")
        ended |= {r["_part"]: list(r["hits"]) for r in by_part(rows, ends(starts, False), "_part int, hits array<long>").collect()}  # a small row a part
        todo = [p for p in prev if starts[p] != ended[p - 1]]
        starts |= {p: ended[p - 1] for p in todo}
    if todo:  # from the first open part of each address on, its parts in order
        open_parts, p0 = [], {}
        for p in sorted(prev):
            head = p0.get(p - 1, p) if p - 1 in prev else p
            p0[p] = head
        heads = {p0[p] for p in todo}
        first = {h: min(p for p in todo if p0[p] == h) for h in heads}
        open_parts = [p for p in sorted(prev) if p0[p] in heads and p >= first[p0[p]]]
        rows = table.where(F.col("_part").isin(open_parts)).select("_part", "_pos", "ip", "seq")
        chain = F.create_map(*[F.lit(x) for p in open_parts for x in (p, p0[p])])
        own = {first[h]: starts[first[h]] for h in heads}
        in_order = rows.withColumn("_head", F.element_at(chain, F.col("_part"))).repartition("_head").sortWithinPartitions("_part", "_pos").drop("_head")
        ended |= {r["_part"]: list(r["hits"]) for r in in_order.mapInPandas(ends(own, True), "_part int, hits array<long>").collect()}
        starts |= {p: ended[p - 1] for p in open_parts if p - 1 in ended}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ip, hits = None, None, deque()
        for batch in batches:
            for p, rows in batch.groupby("_part", sort=False):
                if p != part:
                    part, ip, hits = p, rows["ip"].iloc[0], deque(starts.get(p, ()))
                ip, allowed = walk(ip, hits, rows["ip"].tolist(), rows["seq"].tolist())
                yield rows[["ip", "id"]].assign(allowed=allowed)

    kinds = dict(attempts.dtypes)
    return by_part(table, judge, f"ip {kinds['ip']}, id {kinds['id']}, allowed boolean")
