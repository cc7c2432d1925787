"""Queries of differences, reconciling and restores (D)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..common import shared_dir, written

from ..operators import diff as D

from .registry import Registry
from .tree_queries import CENTRALS

R = Registry()
OTHER = "(s.kind,s.size,s.mtime_ns,s.mode,s.content_hash) is distinct from (t.kind,t.size,t.mtime_ns,t.mode,t.content_hash)"
PLAN = f"select * from (select coalesce(s.path,t.path) path, case when t.path is null then 'Copy' when s.path is null then 'Delete' when {OTHER} then 'Replace' end action from tree_master s full join tree_local t on s.path=t.path) x where action is not null"


def plan(f):
    return D.diff_trees(f("tree_master"), f("tree_local"))


@R.add("d1_diff_trees", PLAN)
def d1(f):
    return plan(f)


@R.add("d2_preview_pulls", """select * from (select t.path, case when s.path is null then 'delete' when s.child<>t.child and not (s.kind=2 and t.kind=2) then 'replace' end action
    from index_local t left join index_master s on s.path=t.path) x where action is not null""")
def d2(f):
    return D.preview_pulls(f("index_master"), f("index_local"))


@R.add("d3_compare_roots", f"""select c.central checkout, c.central, coalesce(l.child,sha256('')) left_root, coalesce(r.child,sha256('')) right_root, coalesce(l.child,sha256(''))=coalesce(r.child,sha256('')) matched
    from ({CENTRALS}) c left join index_local l on l.path=c.central left join index_master r on r.path=c.central""")
def d3(f):
    return D.compare_roots(f("index_local"), f("index_master"), f.sql(CENTRALS).withColumn("checkout", F.col("central")))


REPORTED = f"select c.central checkout, c.central, case when c.central='/src2/en' then '/src2' when c.central='/src1' then '/src1/fr' else c.central end path from ({CENTRALS}) c"


@R.add("d3_reported_paths", f"""select c.checkout, c.path, case when ok then coalesce(l.child,sha256('')) end left_root, case when ok then coalesce(r.child,sha256('')) end right_root, cast(case when ok then coalesce(l.child,sha256(''))=coalesce(r.child,sha256('')) end as integer) matched, case when not ok then 'EscapesRoot' end path_error
    from (select *, central='/' or path=central or starts_with(path,central||'/') ok from ({REPORTED}) x) c left join index_local l on l.path=c.path left join index_master r on r.path=c.path""")
def d3b(f):
    return D.compare_roots(f("index_local"), f("index_master"), f.sql(REPORTED)).select("checkout", "path", "left_root", "right_root", F.col("matched").cast("int").alias("matched"), "path_error")


@R.add("d4_prune_diff", """select coalesce(l.path,r.path) path, l.kind left_kind, l.child left_node, r.kind right_kind, r.child right_node from (select * from index_local where path<>'/') l
    full join (select * from index_master where path<>'/') r on r.path=l.path where l.kind is distinct from r.kind or l.child is distinct from r.child""")
def d4(f):
    return D.prune_diff(f("index_local"), f("index_master"))


def walked(f):
    """The two indexes stored, and the walk over them."""
    from ..sources import snapshots, tree_index

    roots = [f"{shared_dir(f.spark)}/treespark/index-{uuid.uuid4().hex}" for _ in range(2)]
    for root, name in zip(roots, ("index_local", "index_master")):
        snapshots.write_snapshot(f(name).withColumn("ck", F.lit("")), root)
    return tree_index.prune_walk(f.spark, *roots)


DIFFERING = """select coalesce(l.path,r.path) path, l.kind left_kind, l.child left_node, r.kind right_kind, r.child right_node, coalesce(l.depth,r.depth) depth from (select * from index_local where path<>'/') l
    full join (select * from index_master where path<>'/') r on r.path=l.path where l.kind is distinct from r.kind or l.child is distinct from r.child"""


@R.add("d4_prune_walk", f"select path, left_kind, left_node, right_kind, right_node from ({DIFFERING}) d")
def d4b(f):
    return walked(f)[0]


@R.add("d4_walk_levels", f"""with o as (select path, depth from ({DIFFERING}) d where left_kind=2 or right_kind=2 union all select '/', 0), v as (select distinct path, parent from (select path, parent from index_local union all select path, parent from index_master) x where path<>'/')
    select cast(o.depth as integer) "level", count(distinct o.path) opened, count(v.path) visited from o left join v on v.parent=o.path group by 1""")
def d4c(f):
    return walked(f)[1].select("level", "opened", "visited")


SIDES = "select coalesce(l.path,r.path) path, l.kind lk, l.child lc, l.node ln, r.kind rk, r.child rc, s.last_node last from index_local l full join index_master r on r.path=l.path left join synced s on s.path=coalesce(l.path,r.path)"
THREE = """case when lk=rk and lc=rc then 'Matched' when lk=2 and rk=2 then 'Recurse' when lk<>rk then case when last is null or ln=last then 'Pull' else 'AnnounceCas' end
    when lk is null then 'Pull' when rk is null then case when last is not null and ln<>last then 'AnnounceCas' else 'AnnounceCreate' end when last is not null and ln=last then 'Pull' else 'AnnounceCas' end"""


@R.add("d5_reconcile", f"select path, {THREE} action from ({SIDES}) x")
def d5(f):
    return D.reconcile(f("index_local"), f("index_master"), f("synced"))


UNAPPLIED = "select e.prefix, e.generation from epochs e left join applied a on a.prefix=e.prefix where a.generation is null or e.generation>a.generation"


@R.add("d6_reconcile_under", f"""select path, case when exists(select 1 from ({UNAPPLIED}) e where x.path=e.prefix or starts_with(x.path,e.prefix||'/'))
    then case when lk is not distinct from rk and lc is not distinct from rc then 'Matched' when rk is null then 'DropLocal' when lk=2 and rk=2 then 'Recurse' else 'Pull' end else {THREE} end action from ({SIDES}) x""")
def d6(f):
    return D.reconcile_under(f("index_local"), f("index_master"), f("synced"), D.unapplied_epochs(f("epochs"), f("applied")))


BLIND = "select path from leaf where doc_id%14=0"
SINCE = "select path from leaf where doc_id%31=0"


@R.add("d7_survey", f"""select * from (select coalesce(s.path,t.path) path, case when s.path is null then 'create' when t.path is null and b.path is not null then 'keep' when t.path is null then 'delete' when {OTHER} then 'update' end verdict
    from tree_master s full join tree_local t on s.path=t.path left join ({BLIND}) b on b.path=coalesce(s.path,t.path)) x where verdict is not null and path not in ({SINCE})""")
def d7(f):
    return D.survey(f("tree_master"), f("tree_local"), f.sql(BLIND), f.sql(SINCE))


COUNTS = "count(*) filter (where action='Copy') copied, count(*) filter (where action='Replace') replaced, count(*) filter (where action='Delete') deleted"


@R.add("d8_plan_summary", f"select *, prefix||': copied '||copied||', replaced '||replaced||', deleted '||deleted line from (select '/'||split_part(path,'/',2) prefix, {COUNTS} from ({PLAN}) p group by 1) x")
def d8(f):
    return D.plan_summary(plan(f))


@R.add("d8_restore_summary", f"select 'restored /src1 at generation 3, copied '||copied||', replaced '||replaced||', deleted '||deleted line from (select {COUNTS} from ({PLAN}) p where path='/src1' or path like '/src1/%') x")
def d8b(f):
    return D.restore_summary(plan(f), "/src1", 3, False)


@R.add("d9_plan_steps", f"select *, row_number() over (order by action<>'Delete', case when action='Delete' then -1 else 1 end*(length(path)-length(replace(path,'/',''))-case when path='/' then 1 else 0 end), path) step from ({PLAN}) p")
def d9b(f):
    return D.number_plan(plan(f))


@R.add("d9_order_plan", PLAN)
def d9(f):
    return D.order_plan(plan(f))


@R.add("d10_patch_index", """select i.path, i.dir_node, case when i.path='/src1' or i.path like '/src1/%' then i.node else s.last_node end last_node from (
    select path, node, dir_node from index_mixed) i left join synced s on s.path=i.path""")
def d10(f):
    index = written(f("index_local").join(f("synced").select("path", "last_node"), "path", "left"), "index")
    return D.patch_index(index, f("tree_master"), "/src1").select("path", "dir_node", "last_node")


MARKS = "select '/src0' prefix, 'Sealed' state, cast(4 as bigint) generation, (select dir_node from index_master where path='/src0') dir_node union all select '/src1', 'Replacing', 7, null union all select '/src2', 'Sealed', 2, 'x'"


@R.add("d11_seal_epochs", f"""select m.prefix, 'Sealed' state, cast(case when k.state='Sealed' and k.dir_node=m.root or k.state='Replacing' then k.generation when k.generation is null then 1 else k.generation+1 end as bigint) generation, m.root dir_node,
    coalesce(k.state='Sealed' and k.dir_node=m.root, false) already_matched from (select path prefix, dir_node root from index_master where path in ('/src0','/src1','/src2','/src3')) m left join ({MARKS}) k on k.prefix=m.prefix""")
def d11(f):
    index = f("index_master")
    roots = index.where("path in ('/src0','/src1','/src2','/src3')").select(F.col("path").alias("prefix"), F.col("dir_node").alias("root"), F.lit(0).alias("changes"))
    marks = f.sql("select '/src0' prefix, 'Sealed' state, cast(4 as bigint) generation union all select '/src1', 'Replacing', 7 union all select '/src2', 'Sealed', 2")
    own = roots.where("prefix = '/src0'").select("prefix", F.col("root").alias("dir_node"))
    marks = marks.join(own, "prefix", "left").withColumn("dir_node", F.coalesce("dir_node", F.when(F.col("prefix") == "/src2", "x")))
    return D.seal_epochs(marks, roots)


@R.add("d12_unapplied_epochs", UNAPPLIED)
def d12(f):
    return D.unapplied_epochs(f("epochs"), f("applied"))


@R.add("d12_ack_epochs", "select prefix, max(generation) generation from (select * from applied union all select prefix, generation from epochs where prefix<>'/src1') x group by 1")
def d12b(f):
    return D.ack_epochs(f("applied"), f("epochs").withColumn("matched", F.col("prefix") != "/src1"))


@R.add("d13_judge_trees", """select * from (select coalesce(e.path,o.path) path, case when o.path is null then 'missing' when e.path is null then 'unexpected' when e.kind<>o.kind then 'kind'
    when e.kind=2 then case when e.path like '/src1%' and (e.mode<>o.mode or e.mtime_ns<>o.mtime_ns) then 'meta' end when e.kind=3 and e.content_hash<>o.content_hash then 'target'
    when e.content_hash<>o.content_hash or e.size<>o.size then 'bytes' when e.kind<>3 and e.mode<>o.mode then 'mode' when e.kind<>3 and e.mtime_ns<>o.mtime_ns then 'mtime' end finding
    from tree_master e full join tree_local o on o.path=e.path) x where finding is not null""")
def d13(f):
    return D.judge_trees(f("tree_master").withColumn("authoritative", F.startswith("path", F.lit("/src1"))), f("tree_local"))


@R.add("d14_guard_stale_deletes", """select d.path, coalesce(a.last>d.requested,false) or d.scanning suppressed from (select path, source ck, doc_id%1000 requested, doc_id%13=0 scanning from leaf) d
    left join (select source ck, max(doc_id%1000) last from leaf where source<>'src3' group by 1) a on a.ck=d.ck""")
def d14(f):
    gone = f.sql("select path, source ck, doc_id listing_id from leaf")
    listings = f.sql("select doc_id listing_id, source ck, doc_id%1000 requested, doc_id%13=0 scanning from leaf")
    accepts = f.sql("select source ck, doc_id%1000 `at` from leaf where source<>'src3'")
    return D.guard_stale_deletes(gone, listings, accepts).select("path", "suppressed")


