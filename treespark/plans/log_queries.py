"""Queries of change logs, fan-out and access (C, A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import written
from ..operators import access as A
from ..operators import cas as C
from ..operators.tree import tree_hash
from ..schema import META_FIELDS
from .registry import Registry

R = Registry()
ANNOUNCES = """select l.doc_id, l.path, case when l.doc_id%4=3 then 'delete' else 'announce' end op, case when l.doc_id%4=0 then null when l.doc_id%4=1 then m.node when l.doc_id%4=3 and l.doc_id%8=3 then m.node else t.node end basis,
    t.node new_node, t.content_hash, t.kind from (select doc_id, path from leaf union all select doc_id, path||'.new' from leaf where doc_id%19=0) l left join tree_master m on m.path=l.path left join tree_local t on t.path=l.path"""


@R.add("c1_decide_cas", f"""select a.path, m.node current, case when case when op<>'delete' and basis is null then m.node is null else coalesce(m.node=basis,false) end then 'accept' else 'reject' end verdict from ({ANNOUNCES}) a left join tree_master m on m.path=a.path""")
def c1(f):
    return C.decide_cas(f.sql(ANNOUNCES), f("tree_master")).select("path", "current", "verdict")


FOLD = """with recursive o as (select path, seq, op, basis, new_node, row_number() over (partition by path order by seq) n from changes),
    w as (select path, n, seq, cast(null as varchar) current, case when case when op<>'delete' and basis is null then true else false end then 'accept' else 'reject' end verdict,
            case when op<>'delete' and basis is null then new_node end node from o where n=1
        union all select o.path, o.n, o.seq, w.node, case when case when o.op<>'delete' and o.basis is null then w.node is null else coalesce(w.node=o.basis,false) end then 'accept' else 'reject' end,
            case when case when o.op<>'delete' and o.basis is null then w.node is null else coalesce(w.node=o.basis,false) end then case when o.op='delete' then null else o.new_node end else w.node end
        from w join o on o.path=w.path and o.n=w.n+1) """


@R.add("c2_fold_changes", FOLD + "select path, seq, verdict, current from w")
def c2(f):
    return C.fold_changes(f("changes")).select("path", "seq", "verdict", "current")


@R.add("c2_final_state", FOLD + "select path, arg_max(struct_pack(x:=node), n).x node from w group by 1 having arg_max(struct_pack(x:=node), n).x is not null")
def c2b(f):
    return C.final_state(f("changes")).select("path", "node")


def tree_log(f):
    """All events as leaf changes, and directory changes over whole user groups between them."""
    log = f("changes").selectExpr("seq*2 seq", "op", "path", "kind", "basis", "new_node")
    dirs = f.sql("""select event_id*2+1 seq, case when event_id%3=0 then 'delete' else 'announce' end op, '/u'||cast(user_id%10 as string) path, cast(case when event_id%3=1 then 1 else 2 end as int) kind,
        case when event_id%3=0 then '' end basis, case when event_id%3>0 then sha2(cast(event_id as string),256) end new_node from {events}""")
    index = f.sql("select distinct '/u'||cast(user_id%10 as string) path, 2 kind, '' node from {events}")
    return C.fold_tree_changes(log.unionByName(dirs), index)


@R.add("c3_fold_tree_changes")
def c3(f):
    return tree_log(f)[0]


@R.add("c3_final_tree")
def c3b(f):
    return tree_log(f)[1]


FINISH = "select a.doc_id finish_seq, a.path, case when a.doc_id%6=5 then m.content_hash else coalesce(a.content_hash,'-') end want_hash, a.doc_id%9<>0 body_ok from ({0}) a left join tree_master m on m.path=a.path where a.op='announce'"
PENDING = "select doc_id seq, path, op, basis, new_node, coalesce(content_hash,'-') want_hash from ({0}) p where op='announce' and doc_id%6<>5"


@R.add("c4_two_phase_cas", f"""select f.finish_seq, f.path, f.want_hash, case when p.path is null then case when m.content_hash=f.want_hash then 'accept' else 'unknown_transfer' end
    when not f.body_ok then 'retry_whole' when case when p.basis is null then m.node is null else coalesce(m.node=p.basis,false) end then 'accept' else 'reject' end verdict
    from ({FINISH.format(ANNOUNCES)}) f left join ({PENDING.format(ANNOUNCES)}) p on p.path=f.path and p.want_hash=f.want_hash left join tree_master m on m.path=f.path""")
def c4(f):
    return C.two_phase_cas(f.sql(PENDING.format(ANNOUNCES)), f.sql(FINISH.format(ANNOUNCES)), f("tree_master")).select("finish_seq", "path", "want_hash", "verdict")


INCOMING = "select m.path, m.kind, m.content_hash, m.node, s.last_node basis from tree_master m left join synced s on s.path=m.path"


@R.add("c5_decide_incoming", f"""select i.path, case when l.node is null then 'Apply' when l.node=i.node then 'NoopRefresh' when l.node is not distinct from i.basis then 'Apply' when l.kind<>i.kind or l.content_hash<>i.content_hash then 'ConflictThenApply' else 'MetaOnly' end action
    from ({INCOMING}) i left join tree_local l on l.path=i.path""")
def c5(f):
    return C.decide_incoming(f.sql(INCOMING), f("tree_local")).select("path", "action")


@R.add("c6_decide_incoming_delete", """select m.path, case when l.node is null then 'AlreadyGone' when l.node=m.node or l.node=s.last_node then 'Remove' when l.kind=2 then 'Remove' when l.content_hash=s.last_content then 'Remove' else 'ConflictThenRemove' end action
    from tree_master m left join tree_local l on l.path=m.path left join synced s on s.path=m.path""")
def c6(f):
    return C.decide_incoming_delete(f.sql("select path, node basis from tree_master"), f("tree_local"), f("synced")).select("path", "action")


RENAMES = "select l.path, l.path||'.new' to_path, case when l.doc_id%2=0 then s.last_node else m.node end basis, case when l.doc_id%3=0 then n.node else m.node end node from leaf l join tree_master m on m.path=l.path left join synced s on s.path=l.path left join tree_local n on n.path=l.path||'.new'"


@R.add("c7_decide_incoming_rename", f"""select r.path, case when l.node is null and t.node=r.node then 'NoopRefresh' when l.node is null then 'CreateAtTo' when l.node=r.basis or l.node=s.last_node or l.kind=2 then 'Apply' else 'ConflictThenApply' end action
    from ({RENAMES}) r left join tree_local l on l.path=r.path left join tree_local t on t.path=r.to_path left join synced s on s.path=r.path""")
def c7(f):
    return C.decide_incoming_rename(f.sql(RENAMES), f("tree_local"), f("synced")).select("path", "action")


@R.add("c8_conflicts", "select l.path, '/.tree-conflicts'||l.path||'--'||substr(l.content_hash,1,16) conflict_path from tree_local l left join tree_master m on m.path=l.path where l.kind<>2 and l.content_hash<>coalesce(m.content_hash,repeat('0',64))")
def c8(f):
    return C.conflicts(f("tree_local"), f("tree_master")).select("path", "conflict_path")


COMMITS = "select doc_id seq, path, case when doc_id%5=0 then 'delete' else 'announce' end op, case when doc_id%3=0 then null else content_hash end previous, 's'||cast(doc_id%5 as string) slave, source checkout from leaf"
COVERS = "({0}=s.central or s.central='/' or starts_with({0},s.central||'/'))"


@R.add("c9_fanout", f"""select c.seq, s.slave to_slave, s.checkout to_checkout, case when op='delete' then 'Remove' else 'Announce' end msg, c.path, c.previous basis
    from ({COMMITS}) c join subscr s on {COVERS.format("c.path")} where not (c.slave=s.slave and c.checkout=s.checkout)""")
def c9(f):
    return C.fanout(f.sql(COMMITS), f("subscr"))


MOVES = "select doc_id seq, path, case when doc_id%3=0 then '/src1/en/moved' when doc_id%3=1 then '/elsewhere' else '/'||source||'/moved' end||cast(doc_id as string) to_path, 's'||cast(doc_id%5 as string) slave, source checkout from leaf"


@R.add("c10_fanout_renames", f"""select c.seq, c.path, c.to_path, s.slave to_slave, s.checkout to_checkout, case when {COVERS.format("c.path")} and {COVERS.format("c.to_path")} then 'Rename' when {COVERS.format("c.path")} then 'Remove' else 'Announce' end msg
    from ({MOVES}) c join subscr s on ({COVERS.format("c.path")} or {COVERS.format("c.to_path")}) where not (c.slave=s.slave and c.checkout=s.checkout)""")
def c10(f):
    return C.fanout_renames(f.sql(MOVES), f("subscr"))


ASKED = "select l.doc_id, l.path, case when l.doc_id%4=0 then '/'||l.source||'/.tree-state' when l.doc_id%4=1 then '/none/x' when l.doc_id%4=2 then '/'||l.source||'/empty' else l.path||'.moved' end to_path, case when l.doc_id%6=0 then 'old' else m.node end basis, s.slave, s.checkout from leaf l join tree_master m on m.path=l.path join subscr s on s.checkout=l.source"


@R.add("c11_check_renames", f"""select r.doc_id, case when not ({COVERS.format("r.path")}) or not ({COVERS.format("r.to_path")}) then 'outside_central' when split_part(substr(r.to_path,length(s.central)+1),'/',2) in ('.tree-conflicts','.tree-state') then 'reserved_name' when t.path is not null or coalesce(m.node<>r.basis,true) then 'cas_reject' else 'accept' end verdict,
    case when not ({COVERS.format("r.path")}) then r.path when not ({COVERS.format("r.to_path")}) then r.to_path when split_part(substr(r.to_path,length(s.central)+1),'/',2) in ('.tree-conflicts','.tree-state') then r.to_path when t.path is not null then r.to_path when coalesce(m.node<>r.basis,true) then r.path end failing
    from ({ASKED}) r join subscr s on s.slave=r.slave and s.checkout=r.checkout left join tree_master t on t.path=r.to_path left join tree_master m on m.path=r.path""")
def c11(f):
    return C.check_renames(f.sql(ASKED), f("tree_master"), f("subscr")).select("doc_id", "verdict", "failing")


@R.add("c12_rename_prefix", "select case when path='/src1' or path like '/src1/%' then '/renamed'||substr(path,6) else path end path, kind, content_hash from tree_master")
def c12(f):
    return C.rename_prefix(f("tree_master"), f.sql("select '/src1' path, '/renamed' to_path")).select("path", "kind", "content_hash")


JUDGED = "select path, case when doc_id%6=0 then 'delete' else 'announce' end op, case when doc_id%4=0 then 'reject' else 'accept' end verdict, case when doc_id%6=0 then null when doc_id%5=1 then 'other' else node end node from (select l.doc_id, l.path, t.node from leaf l join tree_local t on t.path=l.path) v"


@R.add("c14_advance_synced", f"""select i.path, case when v.op='delete' then null when v.op is not null then v.node else s.last_node end last_node, case when v.op='delete' then null when v.op is not null then case when i.node=v.node then i.content_hash end else s.last_content end last_content
    from tree_local i left join synced s on s.path=i.path left join (select * from ({JUDGED}) j where verdict='accept') v on v.path=i.path""")
def c14(f):
    return C.advance_synced(f("tree_local").join(f("synced"), "path", "left"), f.sql(JUDGED)).select("path", "last_node", "last_content")


@R.add("c15_stage_announces", "select l.path, l.node, s.last_node basis from tree_local l left join synced s on s.path=l.path where l.node is distinct from s.last_node and (l.path,l.node) not in (select path, node from tree_master where kind=3)")
def c15(f):
    return C.stage_announces(f("tree_local"), f("synced"), f("tree_master").where("kind = 3")).select("path", "node", "basis")


@R.add("c16_stage_deletes", "select m.path, coalesce(s.last_node,m.node) basis from tree_master m left join synced s on s.path=m.path where m.path not in (select path from tree_local)")
def c16(f):
    gone = f("tree_master").join(f("tree_local").select("path"), "path", "left_anti").select("path")
    return C.stage_deletes(gone.unionByName(f.sql("select '/nothing' path")), f("tree_master"), f("synced"))


@R.add("c17_match_bodies", "select m.path, case when m.content_hash in (select content_hash from tree_local) then 'held' else 'ask' end source from tree_master m where kind<>2")
def c17(f):
    return C.match_bodies(f("tree_master").where("kind <> 2"), f("tree_local")).select("path", "source")


REQUESTS = "select slave, checkout, central from subscr union all select 'x9','a','/a' union all select 'bak','all','/src5' union all select 's4','again','/src4' union all select 's4','again','/src4/en'"
ALLOWED = f"select r.*, exists(select 1 from acl a where a.slave=r.slave and (a.allowed_prefix='/' or r.central=a.allowed_prefix or starts_with(r.central,a.allowed_prefix||'/'))) ok from ({REQUESTS}) r"


@R.add("a1_audit_subscriptions", f"""select slave, verdict, case when verdict='denied' then denied end denied from (select slave, case when slave not in (select slave from acl) then 'unknown_key' when count(*)>8 then 'too_many'
    when count(distinct checkout) filter (where ok) < count(*) filter (where ok) then 'duplicate' when count(*) filter (where not ok)>0 then 'denied' else 'accept' end verdict,
    array_to_string(list_sort(list_distinct(list(central) filter (where not ok))),',') denied from ({ALLOWED}) x group by slave) y""")
def a1(f):
    return A.audit_subscriptions(f.sql(REQUESTS), f("acl"), max_checkouts=8)


@R.add("a2_retry_subscriptions", f"select slave, count(*) filter (where ok) checkouts, case when count(*) filter (where ok)=0 then 'hangup' else 'retry' end next from ({ALLOWED}) x group by 1")
def a2(f):
    asked = f.sql(REQUESTS)
    return A.retry_subscriptions(asked, A.allowed(asked, f("acl")).where("not allowed"))


CALLS = """select doc_id, s.slave, case when doc_id%9=0 then 'gone' else s.checkout end checkout, case when doc_id%5=0 then 'delete' when doc_id%5=1 then 'rename' else 'announce' end op,
    case when doc_id%7=0 then '/other' when doc_id%7=1 then '/'||source||'/.tree-state' when doc_id%7=2 and doc_id%5=0 then '/'||source else '' end||case when doc_id%7=2 and doc_id%5=0 then '' else path end path0, path, source, case when doc_id%5=1 then path||'.moved' end to_path
    from leaf l join subscr s on s.checkout=l.source"""
CALLS = f"select doc_id, slave, checkout, op, case when doc_id%7=1 then '/'||source||'/.tree-state/x' else path0 end path, to_path from ({CALLS}) c0"
WIPES = "select '/src2/en' prefix union all select '/src3'"
HIT = "exists(select 1 from ({0}) w where {1}=w.prefix or starts_with({1},w.prefix||'/'))"


@R.add("a3_authorize_changes", f"""select doc_id, case when op='delete' and (under or above) then 'later' when central is null then 'not_subscribed' when not inside then 'outside_central' when op='rename' and under then 'wiping' when reserved then 'reserved_name' when under then 'wiping' else 'ok' end verdict from (
    select c.doc_id, c.op, s.central, {HIT.format(WIPES, "c.path")} or coalesce({HIT.format(WIPES, "c.to_path")},false) under, exists(select 1 from ({WIPES}) w where starts_with(w.prefix,c.path||'/')) above,
    coalesce({COVERS.format("c.path")} and (c.op<>'rename' or {COVERS.format("c.to_path")}),false) inside, coalesce(split_part(substr(c.path,length(s.central)+1),'/',2) in ('.tree-conflicts','.tree-state'),false) reserved
    from ({CALLS}) c left join subscr s on s.slave=c.slave and s.checkout=c.checkout) x""")
def a3(f):
    return A.authorize_changes(f.sql(CALLS), f("subscr"), f.sql(WIPES)).select("doc_id", "verdict")


BAD_ACL = "select slave, public_key, allowed_prefix from acl union all select 's1','key-s0','/src1/' union all select 'b d','','/a/../b'"
BAD_SUBS = "select slave, checkout, central, local from subscr union all select 's1','src1','/src1','data' union all select 's1','a b','/x','/y'"


@R.add("a4_validate_dimensions", f"""with a as ({BAD_ACL}), c as ({BAD_SUBS}), k as (select distinct slave, public_key from a)
    select 'slave' entity, slave id, 'several_keys' problem from k group by slave having count(*)>1 union select 'key', public_key, 'duplicate_pin' from k where public_key<>'' group by 2 having count(*)>1
    union select 'slave', slave, 'empty_pin' from k where public_key='' union select 'slave', slave, 'bad_id' from k where not regexp_full_match(slave,'[A-Za-z0-9._:-]+')
    union select 'slave', slave, 'bad_prefix' from a where allowed_prefix not like '/%' or allowed_prefix like '_%/' or allowed_prefix like '%/../%'
    union select 'checkout', checkout, 'duplicate_id' from c group by slave, 2 having count(*)>1 union select 'checkout', checkout, 'bad_id' from c where not regexp_full_match(checkout,'[A-Za-z0-9._:-]+')
    union select 'checkout', checkout, 'bad_path' from c where local not like '/%' union select 'slave', slave, 'too_many_checkouts' from c group by 2 having count(*)>5""")
def a4(f):
    return A.validate_dimensions(f.sql(BAD_ACL), f.sql(BAD_SUBS), max_checkouts=5)


LOCALS = "select slave, checkout, local from subscr union all select 's0','twin','/data/src5' union all select 's1','root','/data'"


@R.add("a5_overlapping_locals", f"with l as ({LOCALS}) select i.slave, o.checkout outer, i.checkout inner from l i join l o on o.slave=i.slave and o.checkout<>i.checkout and (starts_with(i.local,o.local||'/') or (i.local=o.local and o.checkout<i.checkout))".replace(" outer,", ' "outer",').replace(" inner from", ' "inner" from'))
def a5(f):
    return A.overlapping_locals(f.sql(LOCALS))


NEW_SUBS = "select slave, checkout, case when checkout='src2' then '/moved' else central end central, local from subscr where checkout<>'src3' union all select 's7','new','/new','/data/new'"


@R.add("a6_diff_dimensions", f"""with n as ({NEW_SUBS}), m as (select *, 'added' change from (select * from n except select * from subscr) a union all select *, 'removed' from (select * from subscr except select * from n) b)
    select m.*, exists(select 1 from n join subscr s on s.slave=n.slave and s.checkout=n.checkout where n.central<>s.central and n.slave=m.slave and n.checkout=m.checkout) needs_restart from m""")
def a6(f):
    return A.diff_dimensions(f("subscr"), f.sql(NEW_SUBS), ["slave", "checkout"], ["central"])


CONNECTS = "select event_id session, ts, 's'||cast(user_id%8 as string) slave, 'key-'||cast((user_id+case when event_id%50=0 then 1 else 0 end)%8 as string) public_key from (select event_id, ts, cast(substr(slave,2) as int) user_id from messages) m"


@R.add("a7_live_sessions", f"""select session, slave, public_key, row_number() over (partition by slave order by ts, session) generation, session=max(session) over (partition by slave) and session=max(session) over (partition by public_key) live from ({CONNECTS}) c""")
def a7(f):
    return A.live_sessions(f.sql(CONNECTS))


@R.add("c12_renamed_tree_hash", "select case when path='/src1' then '/renamed' else path end path, dir_node, true moved from index_master where path in ('/src1','/src2')")
def c12b(f):
    """C12 followed by H4: a subtree's hash doesn't depend on where it is."""
    moved = C.rename_prefix(f("tree_master").select("path", *META_FIELDS), f.sql("select '/src1' path, '/renamed' to_path"))
    return written(tree_hash(moved), "moved").where("path in ('/renamed', '/src2')").select("path", "dir_node", F.lit(True).alias("moved"))
