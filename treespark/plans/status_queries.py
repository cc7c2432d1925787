"""Queries of status, events, transfer and streams (M, S, E, T)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..common import shared_dir, written
from ..operators import events as E
from ..operators import status as M
from ..operators import chunks as CH
from ..operators import transfer as T
from ..schema import META_FIELDS
from ..sources import files, sinks, snapshots
from ..streaming import jobs
from .log_queries import FOLD
from .registry import Registry

R = Registry()
DAY = "date_trunc('day', ts)"
SUMS = """count(*) filter (where direction='in') in_msgs, count(*) filter (where direction='out') out_msgs, count(*) filter (where msg='CasAccept') cas_accept, count(*) filter (where msg='CasReject') cas_reject,
    0 apply_ok, 0 apply_fail, count(*) filter (where msg='BulkIn') bulk_in, 0 bulk_out, cast(coalesce(sum(case when msg='BulkIn' then bytes end),0) as bigint) bytes_in, 0 bytes_out,
    count(*) filter (where msg='DirListRequest') dir_list, count(*) filter (where msg='RootReport') root, 0 local, 0 rescan, 0 flushed, 0 fanout_dropped"""
FLOW = f"select {DAY} window_start, slave, {SUMS} from messages group by 1,2"


@R.add("m1_flow_counters", FLOW)
def m1(f):
    return M.flow_counters(f("messages"), "1 day")


SESSIONS = "select distinct slave, slave<>'s3' connected from messages"


@R.add("m2_fleet_status", f"select w.*, case when w.slave is null then (select count(*) from ({SESSIONS}) s where connected) when w.slave='s3' then 0 else 1 end connected from (select {DAY} window_start, slave, {SUMS} from messages group by grouping sets ((1,2),(1))) w")
def m2(f):
    return M.fleet_status(f("messages"), f.sql(SESSIONS), "1 day")


SAMPLES = "select slave consumer, ts, event_id*3%500 a, event_id*2 b from messages"


@R.add("m3_counter_deltas", f"select consumer, ts, greatest(a-coalesce(lag(a) over w,0),0) a, greatest(b-coalesce(lag(b) over w,0),0) b from ({SAMPLES}) s window w as (partition by consumer order by ts)")
def m3(f):
    return M.counter_deltas(f.sql(SAMPLES), ["a", "b"])


@R.add("m4_last_errors", f"""with e as (select {DAY} window_start, slave, ts, replace(reason,' ','_') reason from messages where reason is not null),
    g as (select *, row_number() over (partition by window_start, slave order by ts desc) n, first_value(reason) over (partition by window_start, slave order by ts desc) lastr from e)
    select window_start, slave, lastr reason, coalesce(min(case when reason<>lastr then n end)-1, count(*)) count from g group by 1,2,3""")
def m4(f):
    return M.last_errors(f("messages"), "1 day")


STATE = "select *, in_msgs%3 outbox, cas_accept%2 pending, dir_list%2 pending_pulls, root%2 pending_renames, 0 parked, 1 sending, cas_reject errors, cas_accept%3 flushed_now"
HEALTH = """case when (outbox>0 and flushed_now=0) or (pending>0 and bulk_in=0 and apply_ok=0) or (pending_pulls>0 and dir_list=0 and in_msgs=0) or (pending_renames>0 and cas_accept=0 and cas_reject=0) then 'stuck'
    when errors>0 and cas_accept+bulk_in+dir_list+root+flushed_now=0 then 'failed' when cas_accept+bulk_in+dir_list+root+flushed_now>0 then 'busy' else 'idle' end"""


def state(f):
    sums = M.flow_counters(f("messages"), "1 day")
    cols = {"outbox": "in_msgs%3", "pending": "cas_accept%2", "pending_pulls": "dir_list%2", "pending_renames": "root%2", "parked": "0L", "sending": "1L", "errors": "cas_reject", "flushed": "cas_accept%3"}
    return M.classify_health(sums.withColumns({k: F.expr(v) for k, v in cols.items()}))


@R.add("m5_classify_health", f"select window_start, slave, {HEALTH} health from ({STATE} from ({FLOW}) s) x")
def m5(f):
    return state(f).select("window_start", "slave", "health")


QUEUE = "select event_id, ts, case when user_id%3=0 then null else 's'||cast(user_id%3 as string) end peer, 'fanout' stage, cast(user_id as string) `key`, case when event_type='purchase' then 'remove' else 'insert' end op from {events}"


@R.add("m6_queue_waits", """with q as (select ts, case when user_id%3=0 then null else 's'||cast(user_id%3 as string) end peer, user_id, event_type='purchase' gone from {events}),
    g as (select peer, user_id, max(ts) filter (where gone) last from q group by 1,2), k as (select q.peer, q.user_id, min(q.ts) since from q join g on g.user_id=q.user_id where not q.gone and (g.last is null or q.ts>g.last) group by 1,2)
    select 'fanout' stage, peer, min(since) since, count(*) depth from k group by 2""")
def m6(f):
    return M.queue_waits(f.sql(QUEUE).withColumn("ts", F.col("ts").cast("timestamp")))


NOW = "timestamp '2024-02-01 00:00:00'"


@R.add("m7_bottleneck", f"""with r as (select * from waits w where not (stage='reconcile' and exists(select 1 from waits o where o.grp=w.grp and o.peer is not distinct from w.peer and o.stage in ('fulfill_parked','fulfill_read')))),
    w1 as (select * from (select *, row_number() over (partition by grp order by since, peer nulls first, stage, depth) n from r) x where n=1),
    f1 as (select * from (select w.*, row_number() over (partition by w.grp order by w.since, w.stage, w.depth) m from waits w join w1 on w1.grp=w.grp and w1.peer is not distinct from w.peer and w1.stage='origin_bytes' where w.stage in ('fulfill_parked','fulfill_read','uplink','hashing')) y where m=1)
    select w1.grp, coalesce(f1.stage,w1.stage) stage, case when f1.stage is null then w1.peer else f1.peer end peer, coalesce(f1.since,w1.since) since, coalesce(f1.depth,w1.depth) depth, 'own' source,
    greatest(0, (epoch_us({NOW})//1000)-(epoch_us(coalesce(f1.since,w1.since))//1000)) age_ms from w1 left join f1 on f1.grp=w1.grp""")
def m7(f):
    return M.bottleneck(f("waits"), F.expr(NOW), by=["grp"])


ACCEPTED = "select * from (select *, max(seq) over (partition by peer, generation order by received, seq rows between unbounded preceding and 1 preceding) top from gauges) g where top is null or seq>top"
END = "timestamp '2024-01-30 20:00:00'"


@R.add("m8_fresh_gauges", f"""with g as (select * from ({ACCEPTED}) a qualify row_number() over (partition by peer order by generation desc, received desc, seq desc)=1),
    s as (select p.peer, case when g.peer is null then 'absent' when (epoch_us({END})//1000)-(epoch_us(g.received)//1000)>3*86400000 then 'stale' else 'fresh' end state, g.* exclude (peer) from (select distinct peer from gauges union select 's9') p left join g on g.peer=p.peer)
    select peer, state, case when state<>'fresh' then 'unobserved' else stage end stage, case when state='fresh' then depth end depth, case when state='fresh' then parked end parked, case when state='fresh' then sending end sending,
    case when state='fresh' then pending end pending, case when state='fresh' then (epoch_us(received)//1000)-age_ms end since_ms from s""")
def m8(f):
    return M.fresh_gauges(f("gauges"), f.sql("select distinct peer from gauges union all select 's9'"), F.expr(END), 86400)


REPORTS = "select peer, generation, seq, received, case when seq%3=0 then 'busy' else 'idle' end pace, depth from gauges"
PEERS = "select 's'||cast(n as string) peer, cast(case when n%4=3 then 0 else 2 end as bigint) generation, n%3<>1 connected from (select distinct user_id%8 n from {events}) u"


@R.add("m9_peer_board", f"""with s as ({PEERS}), r as (select r.* from ({REPORTS}) r join s on s.peer=r.peer and s.generation=r.generation and s.generation<>0),
    k as (select * from (select *, max(seq) over (partition by peer order by received, seq rows between unbounded preceding and 1 preceding) top from r) x where top is null or seq>top),
    l as (select * from k qualify row_number() over (partition by peer order by received desc, seq desc)=1)
    select a.peer, coalesce(s.connected,false) connected, coalesce(s.connected,false) and coalesce((epoch_us({END})//1000)-(epoch_us(l.received)//1000)<86400000*10,false) fresh, coalesce(l.pace,'idle') pace, coalesce(l.depth,0) depth
    from (select peer from s where peer<>'s0' union select 's9') a left join s on s.peer=a.peer left join l on l.peer=a.peer""")
def m9(f):
    return board(f)


def board(f):
    sessions = f.sql(PEERS)
    acl = sessions.where("peer <> 's0'").select("peer").union(f.sql("select 's9' peer"))
    return M.peer_board(f.sql(REPORTS).withColumnRenamed("received", "at"), sessions, acl, F.expr(END), fresh_s=86400 * 10)


@R.add("m10_peer_views", f"with s as ({PEERS}), a as (select peer from s where peer<>'s0' union select 's9') select v.peer viewer, a.peer from a v join a on a.peer<>v.peer")
def m10(f):
    return M.peer_views(board(f)).select("viewer", "peer")


@R.add("m11_self_reports", f"select slave, case when health in ('stuck','failed') then 'stuck' else health end pace, least(4294967295, pending+outbox+pending_pulls+pending_renames+parked+sending) depth from (select *, {HEALTH} health from ({STATE} from ({FLOW}) s) x) y")
def m11(f):
    return M.self_reports(state(f))


@R.add("m12_idle_reasks", f"""with g as (select * from ({ACCEPTED}) a qualify row_number() over (partition by peer order by generation desc, received desc, seq desc)=1)
    select m.event_id, m.slave peer from messages m join g on g.peer=m.slave where (epoch_us({END})//1000)-(epoch_us(m.ts)//1000)>=86400000 and (epoch_us({END})//1000)-(epoch_us(g.received)//1000)<=3*86400000 and g.stage is null and g.sending=0 and g.parked=0""")
def m12(f):
    pending = f("messages").select("event_id", F.col("slave").alias("peer"), F.col("ts").alias("asked"))
    return M.idle_reasks(pending, f("gauges"), F.expr(END), 86400).select("event_id", "peer")


LIMITED = """with recursive o as (select id, ip, (epoch_us(ts)//1000) t, row_number() over (partition by ip order by (epoch_us(ts)//1000), id) n from attempts),
    w as (select ip, n, id, true allowed, [t] hits from o where n=1 union all
        select o.ip, o.n, o.id, len(list_filter(w.hits, lambda h: o.t-h<86400000))<3, case when len(list_filter(w.hits, lambda h: o.t-h<86400000))<3 then list_append(list_filter(w.hits, lambda h: o.t-h<86400000), o.t) else list_filter(w.hits, lambda h: o.t-h<86400000) end
        from w join o on o.ip=w.ip and o.n=w.n+1) select ip, id, allowed from w"""


@R.add("m13_rate_limit", LIMITED)
def m13(f):
    return M.rate_limit(f("attempts"), 3, 86400)


@R.add("m12_reasks_of_idle_peers", f"""with g as (select * from ({ACCEPTED.replace("gauges", "idle_gauges")}) a qualify row_number() over (partition by peer order by generation desc, received desc, seq desc)=1)
    select m.event_id, m.slave peer from messages m join g on g.peer=m.slave where (epoch_us({END})//1000)-(epoch_us(m.ts)//1000)>=86400000 and (epoch_us({END})//1000)-(epoch_us(g.received)//1000)<=3*86400000 and g.stage is null and g.sending=0 and g.parked=0""")
def m12b(f):
    pending = f("messages").select("event_id", F.col("slave").alias("peer"), F.col("ts").alias("asked"))
    return M.idle_reasks(pending, f("idle_gauges"), F.expr(END), 86400).select("event_id", "peer")


# --- sources and sinks

@R.add("s1_scan_objects")
def s1(f):
    """The given tables' own files as objects."""
    return files.scan_objects(f.spark, f.sf_dir)


@R.add("s2_snapshot_round_trip", "select path, kind, size, mtime_ns, mode, content_hash from tree_master where path='/src1' or path like '/src1/%'")
def s2(f):
    root = f"{shared_dir(f.spark)}/treespark/snapshot-{uuid.uuid4().hex}"
    snapshots.write_snapshot(f("tree_local").withColumn("ck", F.lit("")), root)
    snapshots.write_snapshot(f("tree_master").withColumn("ck", F.lit("")), root)
    return snapshots.read_snapshot(f.spark, root, ck="", prefix="/src1").select("path", *META_FIELDS)


@R.add("s3_read_changes", "select seq, path, op, new_node, basis from changes")
def s3(f):
    root = f"{shared_dir(f.spark)}/treespark/changes-{uuid.uuid4().hex}"
    f("changes").write.parquet(root)
    return files.read_changes(f.spark, root).select("seq", "path", "op", "new_node", "basis")


LINES = f"""select window_start, slave, 'status slave='||slave||' health=busy bottleneck=none connected=1 in='||in_msgs||' out='||out_msgs||' cas_ok='||cas_accept||' cas_rej='||cas_reject||' apply_ok='||apply_ok||' apply_fail='||apply_fail||' bulk_in='||bulk_in||' bulk_out='||bulk_out
    ||' bytes_in='||bytes_in||' bytes_out='||bytes_out||' dir_list='||dir_list||' root='||root||' local='||local||' rescan='||rescan||' flushed='||flushed||' pending='||in_msgs%4||' outbox=0 writable=1 fanout_dropped='||fanout_dropped||' last_error='||case when cas_reject=0 then '-' when cas_reject=1 then 'bad' else 'bad*'||cas_reject end line from ({FLOW}) x"""


def lines(f):
    sums = M.flow_counters(f("messages"), "1 day")
    extra = {"health": F.lit("busy"), "bottleneck": F.lit("none"), "connected": F.lit(1), "pending": F.expr("in_msgs%4"), "outbox": F.lit(0), "writable": F.lit(1), "last_error": F.expr("case when cas_reject>0 then 'bad' end"), "error_count": F.col("cas_reject")}
    return sinks.format_status_lines(sums.withColumns(extra))


@R.add("s5_format_status_lines", LINES)
def s5(f):
    return lines(f).select("window_start", "slave", "line")


@R.add("s4_parse_status_lines", f"select slave, in_msgs, cas_accept, cas_reject, bytes_in, in_msgs%4 pending, case when cas_reject>0 then 'bad' end last_error, cas_reject error_count, true parsed from ({FLOW}) x union all select null,null,null,null,null,null,null,null,false from messages where event_id%100=0")
def s4(f):
    junk = f.sql("select 'not a status line '||cast(event_id as string) value from messages where event_id%100=0")
    rows = files.parse_status_lines(lines(f).select(F.col("line").alias("value")).unionByName(junk))
    return rows.select("slave", "in_msgs", "cas_accept", "cas_reject", "bytes_in", "pending", "last_error", "error_count", "parsed")


FRAME = "select seq, age_ms, depth, parked, sending, pending, event_id, stage_code from (select event_id, event_id*7 seq, event_id%11+case when event_id%40=0 then 5 else 0 end stage_code, event_id*13 age_ms, event_id%70000 depth, event_id%60000 parked, event_id%3 sending, event_id*3 pending from {events}) e"


@R.add("s6_decode_gauges", f"""select event_id, ok valid, case when ok then case stage_code when 1 then 'hashing' when 2 then 'uplink' when 3 then 'origin_bytes' when 4 then 'fulfill_read' when 5 then 'fulfill_parked' when 6 then 'apply_write' when 7 then 'fanout' when 8 then 'fanout_dropped' when 9 then 'reconcile' when 10 then 'unobserved' end end stage,
    case when ok then seq end seq, case when ok then age_ms end age_ms, case when ok then depth end depth, case when ok then parked end parked, case when ok then sending end sending, case when ok then pending end pending
    from (select *, stage_code<=10 and event_id%17<>0 ok from ({FRAME}) x) y""")
def s6(f):
    def le(c, size):
        return F.concat(*[F.lpad(F.hex(F.shiftright(F.col(c), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])

    frame = F.concat(F.lit("61736731"), le("seq", 4), le("stage_code", 1), le("age_ms", 4), le("depth", 4), le("parked", 2), le("sending", 2), le("pending", 4))
    raw = f.sql(FRAME).select("event_id", F.unhex(F.when(F.col("event_id") % 34 == 0, F.concat(frame, F.lit("00"))).when(F.col("event_id") % 17 == 0, F.concat(F.lit("00"), F.substring(frame, 3, 48))).otherwise(frame)).alias("frame"))
    return files.decode_gauges(raw).drop("frame")


# --- events

EVENTS = """select id, ck, ts, case when kind='Rename' then case when oldin and newin then 'Renamed' when oldin then 'Removed' when newin then 'Changed' end when not oldin then null when kind in ('Create','Write') then 'Changed' when kind='Metadata' then 'Metadata' else 'Removed' end event, kind, path, to_path, oldin, newin
    from (select *, coalesce(path like '/w/%',false) oldin, coalesce(to_path like '/w/%',false) newin from raw_events) x"""


@R.add("e1_to_local_events", f"select ck, ts, event, case when kind='Rename' and not oldin then substr(to_path,3) else substr(path,3) end path, case when event='Renamed' then substr(to_path,3) end to_path, false need_rescan from ({EVENTS}) y where event is not null")
def e1(f):
    return E.to_local_events(f("raw_events"), "/w")


BURST = """with s as (select *, case when ts-lag(ts) over (partition by path order by ts)<interval 6 hours then 0 else 1 end fresh from (select path, ts, kind event from raw_events where path is not null) r),
    g as (select *, sum(fresh) over (partition by path order by ts) n from s) select '' ck, path, arg_max(event, ts) event, min(ts) first_ts, max(ts) last_ts, count(*) n from g group by path, g.n"""


@R.add("e2_debounce", BURST)
def e2(f):
    return E.debounce(f("raw_events").where("path is not null").withColumnRenamed("kind", "event"), "6 hours")


HALVES = "select id, ck, cookie, half, ts, coalesce(path,to_path) path from raw_events where kind='Rename' and coalesce(path,to_path) is not null"


@R.add("e3_pair_renames", f"""with h as ({HALVES}), a as (select * from h where half='from'), b as (select * from h where half='to')
    select coalesce(a.ck,b.ck) ck, coalesce(a.cookie,b.cookie) cookie, case when a.path is null then 'Changed' when b.path is null then 'Removed' else 'Renamed' end event, coalesce(a.path,b.path) path, case when a.path is not null then b.path end to_path
    from a full join b on a.ck=b.ck and a.cookie=b.cookie and b.ts between a.ts-interval 1 hour and a.ts+interval 1 hour""")
def e3(f):
    return E.pair_renames(f.sql(HALVES), "1 hour")


ECHO = "select id, ck, path, ts, case when kind='Remove' then 'Removed' else 'Changed' end event, cast(user_id%3 as string) content_hash from raw_events where path is not null"
ARMED = "select ck, path, ts, cast(id%3 as string) content_hash from raw_events where path is not null and id%7=0"


@R.add("e4_suppress_echo", f"""with e as ({ECHO}), a as (select *, lead(ts) over (partition by path order by ts) nxt from ({ARMED}) r), n as (select e.*, a.ts armed, a.content_hash w from e join a on a.path=e.path and e.ts>=a.ts and e.ts<=least(coalesce(a.nxt, timestamp '9999-12-31'), a.ts+interval 48 hours)),
    f as (select *, min(case when event<>'Removed' and content_hash=w then ts end) over (partition by path, armed) hit from n)
    select id, ck, path, ts, event, content_hash from e where id not in (select id from f where (event<>'Removed' and ts=hit) or (event='Removed' and (hit is null or ts<hit)))""")
def e4(f):
    return E.suppress_echo(f.sql(ECHO), f.sql(ARMED), debounce_ms=24 * 3600 * 1000)


HERE = "select distinct path from raw_events where path is not null and user_id%3=0"
PLAIN = "select id, path, case when kind='Remove' then 'Removed' when kind='Metadata' then 'Metadata' else 'Changed' end event from raw_events where path is not null"


@R.add("e5_resolve_removes", f"select id, p.path, case when event='Removed' and h.path is not null then 'Changed' when event='Changed' and h.path is null then 'Removed' else event end event from ({PLAIN}) p left join ({HERE}) h on h.path=p.path")
def e5(f):
    return E.resolve_removes(f.sql(PLAIN), f.sql(HERE))


ASKS = "select seq, ck, path, cast(seq%2 as string) want_hash, case when op='delete' then 'done' else 'ask' end op from changes"


@R.add("e7_dedupe_asks", f"select seq, ck, path, want_hash, op from (select *, lag(op) over (partition by path, want_hash order by seq) last from ({ASKS}) a) x where op='ask' and coalesce(last,'done')='done'")
def e7(f):
    return E.dedupe_asks(f.sql(ASKS))


NEWDIRS = "select distinct '' ck, 'Changed' event, '/'||source||'/'||lang path from leaf where source in ('src1','src2')"


@R.add("e10_expand_created_dirs", f"select * from ({NEWDIRS}) a union select '', 'Changed', l.path from tree_local l where l.path not in (select path from tree_master) and (starts_with(l.path,'/src1/') or starts_with(l.path,'/src2/')) and exists(select 1 from ({NEWDIRS}) d where starts_with(l.path,d.path||'/'))")
def e10(f):
    return E.expand_created_dirs(f.sql(NEWDIRS), f("tree_local"), f("tree_master"))


# --- streams, run to the end of what is there

def streamed(f, df):
    """df written as files and read again as a stream."""
    root = f"{shared_dir(f.spark)}/treespark/stream-{uuid.uuid4().hex}"
    df.write.parquet(root)
    return f.spark.readStream.schema(df.schema).parquet(root)


def in_batches(f, df, order, n=4):
    """df as a stream of n micro-batches, each with the rows of a span of order (a column of numbers or times)."""
    root = f"{shared_dir(f.spark)}/treespark/stream-{uuid.uuid4().hex}"
    at = F.unix_micros(order) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order)
    df = written(df, "rows")
    cuts = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)])).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        rows = df if low is None else df.where(at > low)
        (rows if high is None else rows.where(at <= high)).repartition(1).write.mode("append").parquet(root)
    return f.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)


def drained(f, stream, mode="append"):
    """A stream's rows after all input, from a file sink."""
    name = uuid.uuid4().hex
    root, mark = (f"{shared_dir(f.spark)}/treespark/{kind}-{name}" for kind in ("sink", "mark"))
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", root).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return f.spark.read.schema(stream.schema).parquet(root)


LATE = "2 days"
SHUT = "(select date_trunc('day', max(ts)-interval 2 days) from messages)"


@R.add("e8_flow_counters_stream", f"select * from ({FLOW}) x where window_start < {SHUT}")
def e8(f):
    return drained(f, jobs.flow_counters_stream(streamed(f, f("messages")), "1 day", LATE))


@R.add("e8_health_stream", f"select window_start, slave, case when cas_reject>0 and cas_accept+bulk_in+dir_list+root=0 then 'failed' when cas_accept+bulk_in+dir_list+root>0 then 'busy' else 'idle' end health from ({FLOW}) x where window_start < {SHUT}")
def e8b(f):
    return drained(f, jobs.health_stream(streamed(f, f("messages")), "1 day", LATE).select("window_start", "slave", "health"))


@R.add("e2_debounce_stream", BURST.replace("select '' ck, path, arg_max", "select * from (select '' ck, path, arg_max") + ") z where last_ts + interval 6 hours < (select max(ts)-interval 2 days from raw_events where path is not null)")
def e2b(f):
    rows = f("raw_events").where("path is not null").withColumnRenamed("kind", "event").select("ck", "path", "ts", "event")
    return drained(f, jobs.debounce_stream(streamed(f, rows), "6 hours", LATE))


def stateful(f, make, df, source=None):
    """make(stream of df), drained under the state store that stateful processors need."""
    conf, key = f.spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, jobs.ROCKS)
    try:
        return drained(f, make(source or streamed(f, df)))
    finally:
        conf.set(key, before)


@R.add("e6_fold_changes_stream", FOLD + "select '' ck, path, seq, verdict, current from w")
def e6(f):
    return stateful(f, jobs.fold_changes_stream, f("changes"))


@R.add("e9_fresh_gauges_stream", f"select peer, generation, seq, received, stage, depth from ({ACCEPTED}) a")
def e9(f):
    return stateful(f, jobs.fresh_gauges_stream, f("gauges"))


@R.add("e9_gauge_states_stream", f"""with a as ({ACCEPTED}), n as (select *, lead(received) over (partition by peer, generation order by seq) nxt from a)
    select peer, generation, seq, received "at", 'fresh' state from n union all select peer, generation, seq, received+interval 30 minutes, 'stale' from n
    where case when nxt is not null then nxt-received>interval 30 minutes else received+interval 30 minutes<=(select max(received) from gauges)-interval 1 day end""")
def e9b(f):
    return stateful(f, lambda g: jobs.gauge_states_stream(g, 600, "1 day", 60 * 86400), None, in_batches(f, f("gauges"), "received"))


@R.add("e3_pair_renames_stream", f"""with h as ({HALVES}), a as (select * from h where half='from'), b as (select * from h where half='to')
    select coalesce(a.ck,b.ck) ck, coalesce(a.cookie,b.cookie) cookie, case when a.path is null then 'Changed' when b.path is null then 'Removed' else 'Renamed' end event, coalesce(a.path,b.path) path, case when a.path is not null then b.path end to_path
    from a full join b on a.ck=b.ck and a.cookie=b.cookie and b.ts between a.ts-interval 1 hour and a.ts+interval 1 hour
    where (a.path is not null and b.path is not null) or coalesce(a.ts,b.ts)+interval 1 hour<(select max(ts) from h)-interval 1 day""")
def e3b(f):
    return drained(f, jobs.pair_renames_stream(in_batches(f, f.sql(HALVES), "ts"), "1 hour", "1 day"))


@R.add("e4_suppress_echo_stream", f"""with e as ({ECHO}), a as (select *, lead(ts) over (partition by path order by ts) nxt from ({ARMED}) r), n as (select e.*, a.ts armed, a.content_hash w from e join a on a.path=e.path and e.ts>=a.ts and e.ts<=a.ts+interval 48 hours and (a.nxt is null or e.ts<a.nxt)),
    f as (select *, min(case when event<>'Removed' and content_hash=w then ts end) over (partition by path, armed) hit from n)
    select id, ck, path, ts, event, content_hash from e where id not in (select id from f where (event<>'Removed' and ts=hit) or (event='Removed' and (hit is null or ts<hit)))""")
def e4b(f):
    applied = f.sql(ARMED).select("ck", "path", F.lit(-1).cast("bigint").alias("id"), "ts", F.lit("Applied").alias("event"), "content_hash")
    rows = f.sql(ECHO).select("ck", "path", F.col("id").cast("bigint").alias("id"), "ts", "event", "content_hash").unionByName(applied)
    return stateful(f, lambda e: jobs.suppress_echo_stream(e, 24 * 3600 * 1000, "1 day"), None, in_batches(f, rows, "ts"))


@R.add("e7_dedupe_asks_stream", f"select seq, ck, path, want_hash, op from (select *, lag(op) over (partition by path, want_hash order by seq) last from ({ASKS}) a) x where op='ask' and coalesce(last,'done')='done'")
def e7b(f):
    rows = f.sql(ASKS).withColumn("seq", F.col("seq").cast("bigint"))
    return stateful(f, jobs.dedupe_asks_stream, None, in_batches(f, rows, "seq"))


@R.add("m13_rate_limit_stream", LIMITED)
def m13b(f):
    return stateful(f, lambda a: jobs.rate_limit_stream(a, 3, 86400, "1 day"), None, in_batches(f, f("attempts"), "ts"))


@R.add("s9_merge_stream_into_index", """select 'a' ck, l.path, l.kind, l.node, l.dir_node, m.node last_node from index_local l left join index_master m on m.path=l.path
    union all select 'b', path, kind, node, dir_node, node from index_master""")
def s9(f):
    from .tree_queries import to_local

    name = uuid.uuid4().hex
    root, mark = (f"{shared_dir(f.spark)}/treespark/{kind}-{name}" for kind in ("index", "mark"))
    before = f("index_master").withColumn("last_node", F.col("node"))  # of two namespaces, one is changed
    snapshots.write_snapshot(before.withColumn("ck", F.lit("a")).unionByName(before.withColumn("ck", F.lit("b"))), root)
    changes = to_local(f).withColumns({"ck": F.lit("a"), "seq": F.lit(1).cast("bigint")})
    jobs.merge_stream_into_index(streamed(f, changes), root, mark).awaitTermination()
    return snapshots.read_snapshot(f.spark, root).select("ck", "path", "kind", "node", "dir_node", "last_node")


# --- transfer

@R.add("t1_transfer_plan", """select m.path, case when m.kind=1 and l.kind=1 and l.size>=4096 then 'Delta' when m.kind in (1,3) then 'Whole' else 'None' end mode, case when m.kind=2 then 0 else m.size end transfer_bytes, m.size>=16777216 large
    from tree_master m left join tree_local l on l.path=m.path""")
def t1(f):
    return T.transfer_plan(f("tree_master"), f("tree_local")).select("path", "mode", "transfer_bytes", "large")


def _blocks(col: str, size: int = 512) -> str:
    """DuckDB: (path, block, h) with h the hex of each block of a text column's bytes."""
    return f"select path, i block, substr(h, i*{2 * size}+1, {2 * size}) h from (select path, h, unnest(range(0, cast(ceil(length(h)/{2 * size}.0) as bigint))) i from (select path, hex(encode({col})) h from bodies) a) b"


@R.add("t2_block_signatures", f"select path, block, length(h)//2 length, sha256(unhex(h)) strong from ({_blocks('body')}) x")
def t2(f):
    return T.block_signatures(f("bodies"), 512)


@R.add("t3_block_delta", f"with s as ({_blocks('edited')}), o as (select path, h, min(block) f from ({_blocks('body')}) x group by 1,2) select s.path, s.block, o.f \"from\", case when o.f is null then s.h end literal, o.f is not null reused from s left join o on o.path=s.path and o.h=s.h")
def t3(f):
    rows = f("bodies")
    return T.block_delta(rows.select("path", F.col("edited").alias("body")), T.block_signatures(rows, 512), 512)


@R.add("t3_rolling_delta")
def t3b(f):
    rows = f("bodies")
    return T.rolling_delta(rows.select("path", F.col("edited").alias("body")), rows.select("path", "body"), 512).drop("literal")


@R.add("t3_chunk_delta", "select path, sha256(edited) body_hash, cast(strlen(edited)-512*(strlen(body)//512) as bigint) literal_bytes from bodies where edited<>''")
def t3c(f):
    rows = f("bodies")
    new, old = (written(CH.chunked(rows, 4096, c), "chunks") for c in ("edited", "body"))
    ops = written(CH.chunk_delta(new, old, 512), "ops")
    sent = ops.groupBy("path").agg(F.coalesce(F.sum(F.when(F.col("basis_at").isNull(), F.col("length"))), F.lit(0)).cast("bigint").alias("literal_bytes"))
    return CH.rebuilt(ops, new, old, 4096).join(sent, "path")


@R.add("t4_apply_delta", "select path, sha256(edited) body_hash, case when sha256(edited)=want_hash then 'accept' else 'retry_whole' end verdict from bodies where edited<>''")
def t4(f):
    rows = written(f("bodies"), "bodies")
    ops = T.block_delta(rows.select("path", F.col("edited").alias("body")), T.block_signatures(rows, 512), 512)
    built = T.apply_delta(ops, rows, 512).join(rows.select("path", "want_hash"), "path")
    return T.verify_bodies(built).select("path", F.sha2("body", 256).alias("body_hash"), "verdict")


@R.add("t5_chunk_reassemble", "select path, case when strlen(body)>1000 and path like '%3.txt' then null else sha256(body) end body_hash, case when strlen(body)>1000 and path like '%3.txt' then 'total' end problem from bodies")
def t5(f):
    chunks = T.chunk_bodies(f("bodies"), 1000)
    last = F.ceil(F.col("total") / 1000) - 1
    lost = (F.col("total") > 1000) & F.col("path").endswith("3.txt") & (F.col("chunk") == last)
    return T.reassemble(chunks.where(~lost), 1000).select("path", F.sha2("body", 256).alias("body_hash"), "problem")


WRITTEN_TREE = "select path, kind, cast(case when kind=2 then 0 else size end as bigint) size, mode, content_hash from (select path, kind, size, mode%4096 mode, content_hash from tree_master where path<>'/') t"


def local_tree(f) -> str:
    """The master tree written by the sink below a fresh folder that all executors mount."""
    from ..sources import posix

    posix.register(f.spark)
    shared = shared_dir(f.spark)
    if not shared.startswith(("file:", "/")):
        raise RuntimeError("a POSIX tree needs a shared folder that is mounted")
    root = f"/{shared.split(':', 1)[-1].strip('/')}/treespark/tree-{uuid.uuid4().hex}"
    leaves = f.sql("select path, kind, mtime_ns, mode, content_hash, cast(content as binary) body from leaf").unionByName(f.sql("select path, kind, mtime_ns, mode, content_hash, cast(null as binary) body from dirs where path<>'/'"))
    leaves.write.format("tree_files").mode("append").option("path", root).save()
    return root


@R.add("s7_tree_files_sink", WRITTEN_TREE.replace("mode, content_hash from (", "case when kind=3 then 511 else mode end mode, content_hash from ("))
def s7(f):
    rows = f.spark.read.format("tree").option("path", local_tree(f)).load()
    return rows.where("problem is null").select("path", "kind", "size", F.expr("mode & 4095").alias("mode"), "content_hash")


@R.add("s1_scan_tree", "select path, kind, content_hash from tree_master where path like '/src1/%'")
def s1_tree(f):
    rows = f.spark.read.format("tree").option("path", local_tree(f)).load()
    return rows.where(F.col("path").startswith("/src1/")).select("path", "kind", "content_hash")


@R.add("s8_conflict_sink", "select '/.tree-conflicts'||l.path||'--'||substr(l.content_hash,1,16) conflict_path from tree_local l left join tree_master m on m.path=l.path where l.kind<>2 and l.content_hash<>coalesce(m.content_hash,repeat('0',64))")
def s8(f):
    from ..operators.cas import conflicts

    root = f"{shared_dir(f.spark)}/treespark/conflicts-{uuid.uuid4().hex}"
    for _ in range(2):  # a second time adds nothing
        sinks.write_conflicts(conflicts(f("tree_local"), f("tree_master")), root)
    return f.spark.read.parquet(root).select("conflict_path")

