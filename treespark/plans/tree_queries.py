"""Queries of paths, hashes and index (P, H, I, C13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..common import shared_dir

from ..functions import paths as P
from ..functions.hashing import content_hash, with_file_node
from ..operators import index as I
from ..operators import tree as H
from ..schema import META_FIELDS
from .fixtures import Duck, Spark
from .registry import Registry

R = Registry()
RESERVED_SQL = "('.tree-conflicts','.tree-state')"

NORMAL = "'/'||array_to_string(list_filter(string_split(raw,'/'), lambda x: x<>''),'/')"


@R.add("p1_canonicalize_paths", f"""select page_id, e path_error, case when e is null then {NORMAL} end path from (select *, case when raw is null or raw not like '/%' then 'NotAbsolute'
    when list_contains(string_split(raw,'/'),'.') or list_contains(string_split(raw,'/'),'..') then 'DotComponent' when {NORMAL}<>raw then 'NonCanonical' end e from pages_raw) x""")
def p1(f):
    return P.canonicalize_paths(f("pages_raw"), "raw").select("page_id", "path_error", "path")


@R.add("p2_path_parts", "select path, parent, name, depth, split_part(path,'/',2) top from index_master_p")
def p2(f):
    return P.with_path_parts(f("tree_master").select("path")).withColumn("depth", F.col("depth").cast("bigint"))


ANCESTORS = "select path, case when i=0 then '/' else array_to_string(list_slice(string_split(path,'/'),1,i+1),'/') end ancestor from (select path, unnest(range(0,depth)) i from {0}_p) x"


@R.add("p3_ancestors", ANCESTORS.format("index_master"))
def p3(f):
    return P.explode_ancestors(f("tree_master").select("path"))


@R.add("p3_path_ancestors_udtf", "select path, ancestor, row_number() over (partition by path order by length(ancestor) desc) distance from (" + ANCESTORS.format("index_master") + ") a")
def p3b(f):
    P.register_path_ancestors(f.spark)
    f("tree_master").createOrReplaceTempView("treespark_paths")
    return f.spark.sql("select t.path, a.ancestor, a.distance from treespark_paths t, lateral path_ancestors(t.path) a")


@R.add("p4_filter_prefix", "select path, size from tree_master where path='/src1' or path like '/src1/%'")
def p4(f):
    return P.filter_prefix(f("tree_master").select("path", "size"), "/src1")


MIXED = "select case when size%5=0 then '/.tree-conflicts' when size%5=1 then '/src1/.tree-state' else '' end||path path from tree_master where path<>'/'"


@R.add("p5_drop_reserved", f"select path from ({MIXED}) x where split_part(path,'/',2) not in {RESERVED_SQL}")
def p5(f):
    return P.drop_reserved(f.sql(MIXED))


@R.add("p6_rebase_paths", """select l.source checkout, l.p path, case when l.p=s.central or l.p like s.central||'/%' then s.local||substr(l.p,length(s.central)+1) end rebased,
    case when l.p=s.central or l.p like s.central||'/%' then null else 'EscapesRoot' end path_error
    from (select source, case when doc_id%10=0 then '/other'||path else path end p from leaf) l join subscr s on s.checkout=l.source""")
def p6(f):
    return P.rebase_paths(f.sql("select source checkout, case when doc_id%10=0 then '/other'||path else path end path from leaf"), f("subscr"))


@R.add("p7_conflict_path", "select path, '/.tree-conflicts'||path||'--'||substr(content_hash,1,16) conflict_path from leaf")
def p7(f):
    return P.conflict_path(f("leaf")).select("path", "conflict_path")


LINKED = "select path, kind, case when kind=3 then case when doc_id%2=0 then '/src1/x' else '/src2/x' end end target from leaf union all select path||'/x', 1, null from leaf where doc_id%3=0"


@R.add("p8_escaping_links", f"with t as ({LINKED}) select t.path, t.kind, coalesce(l.target='/src2/x',false) escapes from t left join t l on l.kind=3 and l.path<>t.path and regexp_replace(t.path,'/x$','')=l.path")
def p8(f):
    return P.flag_escaping_links(f.sql(LINKED), "/src1").select("path", "kind", "escapes")


@R.add("h1_content_hash", "select doc_id, sha256(text) content_hash from {documents}")
def h1(f):
    return content_hash(f.table("documents"), "text").select("doc_id", "content_hash")


@R.add("h2_plan_rehash", """select l.path, case when ok then 'reuse' else 'hash' end rehash, case when ok then m.content_hash end content_hash from tree_local l left join tree_master m on m.path=l.path
    cross join lateral (select coalesce(l.kind=1 and m.kind=1 and l.size=m.size and l.mtime_ns=m.mtime_ns, false) ok) o""")
def h2(f):
    return H.plan_rehash(f("tree_local"), f("tree_master")).select("path", "rehash", "content_hash")


@R.add("h3_file_node", "select path, node from tree_local")
def h3(f):
    return with_file_node(f("tree_local").drop("node")).select("path", "node")


@R.add("h4_tree_hash", "select path, kind, node, dir_node from index_master")
def h4(f):
    return f("index_master").select("path", "kind", "node", "dir_node")


def to_local(f):
    """The changes that turn the master inventory into the local one."""
    old, new = f("tree_master").select("path", *META_FIELDS), f("tree_local").select("path", *META_FIELDS)
    gone = old.join(new, "path", "left_anti").select("path", *[F.lit(None).cast(t).alias(n) for n, t in old.select(*META_FIELDS).dtypes])
    return new.exceptAll(old).unionByName(gone)


@R.add("h5_tree_hash_incremental", "select path, kind, node, dir_node from index_local")
def h5(f):
    return H.tree_hash_incremental(f("index_master"), to_local(f)).select("path", "kind", "node", "dir_node")


@R.add("h5_update_stored_index", "select path, kind, node, dir_node from index_local")
def h5b(f):
    from ..sources import snapshots, tree_index

    root = f"{shared_dir(f.spark)}/treespark/index-{uuid.uuid4().hex}"
    snapshots.write_snapshot(f("index_master").withColumn("ck", F.lit("")), root)
    tree_index.update_index(f.spark, root, to_local(f).withColumns({"ck": F.lit(""), "seq": F.lit(1).cast("bigint")}))
    return snapshots.read_snapshot(f.spark, root).select("path", "kind", "node", "dir_node")


CENTRALS = "select '/' central union all select '/src1' union all select '/src2/en' union all select '/none' union all select path from leaf"


@R.add("h6_subtree_roots", f"select c.central, coalesce(i.child, sha256('')) root from ({CENTRALS}) c left join index_local i on i.path=c.central")
def h6(f):
    return H.subtree_roots(f("index_local"), f.sql(CENTRALS))


BROKEN = "case when path in ('/src1','/src2/en','/src3/empty') then {0} else dir_node end"
BROKEN_DUCK = f"broken as (select * replace ({BROKEN.format(Duck.sha(chr(39) + 'wrong' + chr(39) + '||path'))} as dir_node) from index_master)"
LISTED = """listed as (select d.path, sha256(unhex(coalesce(string_agg(printf('%02x',c.kind)||printf('%08x',strlen(c.name))||hex(encode(c.name))||coalesce(c.dir_node,c.node),'' order by c.name) filter (where c.name is not null),''))) listed
    from broken d left join broken c on c.parent=d.path where d.kind=2 group by 1)"""


def broken(f):
    return f("index_master").withColumn("dir_node", F.expr(BROKEN.format(Spark.sha("'wrong'||path"))))


@R.add("h7_verify_tree", f"with {BROKEN_DUCK}, {LISTED} select b.path, b.dir_node, l.listed from broken b join listed l on l.path=b.path where b.dir_node<>l.listed")
def h7(f):
    return H.verify_tree(broken(f)).select("path", "dir_node", "listed")


@R.add("h8_repair_tree", f"""with {BROKEN_DUCK}, {LISTED}, own as (select b.path from broken b join listed l on l.path=b.path join index_master i on i.path=b.path where b.dir_node<>l.listed and b.dir_node is distinct from i.dir_node),
    r as (select b.path, i.dir_node, case when o.path is not null and b.kind<>2 then null else s.last_node end last_node,
        b.dir_node is distinct from i.dir_node or (o.path is not null and b.kind<>2 and s.last_node is not null) changed
        from broken b join index_master i on i.path=b.path left join synced s on s.path=b.path left join own o on o.path=b.parent) select * from r""")
def h8(f):
    rows = broken(f).join(f("synced").select("path", "last_node"), "path", "left")
    return H.repair_tree(rows).select("path", "dir_node", "last_node", "changed")


@R.add("i1_range_meta", "select path, kind, size, mtime_ns, mode, content_hash from tree_master where path='/src1' or path like '/src1/%'")
def i1(f):
    return I.range_meta(f("tree_master").withColumn("ck", F.lit("")), "", "/src1")


@R.add("i2_list_children", "select parent dir, name, kind, child node from index_master where parent in ('/','/src1','/src2/en')")
def i2(f):
    return I.list_children(f("index_master"), f.sql("select '/' dir union all select '/src1' union all select '/src2/en'"))


WANTED = "select path from leaf union all select '/none'||path from leaf union all select '/src1'"


@R.add("i3_lookup", f"select w.path, i.kind, i.node, i.dir_node, s.last_node, s.last_content from ({WANTED}) w left join index_master i on i.path=w.path left join synced s on s.path=w.path")
def i3(f):
    rows = f("index_master").join(f("synced"), "path", "left")
    return I.lookup(rows, f.sql(WANTED)).select("path", "kind", "node", "dir_node", "last_node", "last_content")


PAGE = """select dir, name, used, more from (select *, count(*) over (partition by dir) < total more from (
    select parent dir, name, sum(strlen(name)+37) over (partition by parent order by name) used, row_number() over (partition by parent order by name) n, count(*) over (partition by parent) total
    from index_master where path<>'/' and name>'1') x where used<=600 or n=1) y"""


@R.add("i4_page_listing", PAGE)
def i4(f):
    rows = f("index_master").where("path <> '/'").select(F.col("parent").alias("dir"), "name")
    return I.page_listing(rows, "1", 600).select("dir", "name", "used", "more")


@R.add("i5_merge_pages", f"""with page as ({PAGE}), e as (select dir, max(name) stop, bool_or(more) more from page group by dir),
    l as (select parent dir, name, child node from index_local where path<>'/'), r as (select p.dir, p.name, m.child node from page p join index_master m on m.parent=p.dir and m.name=p.name)
    select dir, name, l.node local_node, r.node right_node from l full join r using (dir, name) left join e using (dir) where (not coalesce(e.more,false) or name<=e.stop) and name>'1'""")
def i5(f):
    child = F.coalesce("dir_node", "node").alias("node")
    rows = f("index_master").where("path <> '/'").select(F.col("parent").alias("dir"), "name", "kind", child)
    local = f("index_local").where("path <> '/'").select(F.col("parent").alias("dir"), "name", "kind", child)
    return I.merge_pages(local, I.page_listing(rows, "1", 600), "1").select("dir", "name", "local_node", "right_node")


@R.add("i6_drift_report", """select coalesce(d.path,i.path) path, case when d.node is null then 'index_only' when i.node is null then 'disk_only' when d.node=i.node then 'match' else 'differ' end disk_index,
    case when i.node is null then 'no_index' when i.last_node is null then 'unset' when i.node=i.last_node then 'match' else 'differ' end index_last_synced
    from tree_local d full join (select m.path, m.node, s.last_node from tree_master m left join synced s on s.path=m.path) i on i.path=d.path""")
def i6(f):
    return I.drift_report(f("tree_local"), f("tree_master").join(f("synced"), "path", "left"))


@R.add("i7_delete_prefix", "select path from tree_master where not (path='/src1' or path like '/src1/%' or path='/src2/en' or path like '/src2/en/%')")
def i7(f):
    return I.delete_prefix(f("tree_master"), f.sql("select '/src1' prefix union all select '/src2/en'")).select("path")


@R.add("i8_overlaps_prefixes", """select path, 'covered' overlap from tree_master where path='/src1/en' or path like '/src1/en/%' or path='/src2' or path like '/src2/%'
    union all select path, 'covering' from tree_master where path in ('/','/src1')""")
def i8(f):
    return I.overlaps_prefixes(f("tree_master").select("path"), f.sql("select '/src1/en' prefix union all select '/src2'"))


@R.add("c13_fill_ancestors", "select path, kind from tree_master where path not like '%/empty'")
def c13(f):
    return H.fill_ancestors(f("leaf").select("path", *META_FIELDS)).select("path", "kind")
