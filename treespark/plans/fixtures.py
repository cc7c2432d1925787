"""Inventories, logs and dimensions derived from the given tables. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..common import written
from ..operators.tree import tree_hash

TABLES = ["documents", "events", "pages"]


class Spark:
    sha = staticmethod(lambda x: f"sha2({x},256)")
    octets = staticmethod(lambda x: f"octet_length({x})")
    ts = staticmethod(lambda x: f"cast({x} as timestamp)")
    days = staticmethod(lambda x: f"dayofmonth({x})")
    idiv = staticmethod(lambda a, b: f"({a} div {b})")

    @staticmethod
    def node(kind, content, size, mtime, mode):
        h = lambda x, n: f"lpad(hex(cast({x} as bigint)),{n},'0')"
        return f"sha2(unhex(concat({h(kind, 2)},{content},{h(size, 16)},{h(mtime, 16)},{h(mode, 8)})),256)"


class Duck:
    sha = staticmethod(lambda x: f"sha256({x})")
    octets = staticmethod(lambda x: f"strlen({x})")
    ts = staticmethod(lambda x: f"cast({x} as timestamp)")
    days = staticmethod(lambda x: f"day({x})")
    idiv = staticmethod(lambda a, b: f"({a} // {b})")

    @staticmethod
    def node(kind, content, size, mtime, mode):
        return f"sha256(unhex(printf('%02x',cast({kind} as bigint))||{content}||printf('%016x',cast({size} as bigint))||printf('%016x',cast({mtime} as bigint))||printf('%08x',cast({mode} as bigint))))"


def _texts(d) -> dict[str, str]:
    row_node = d.node("kind", "content_hash", "size", "mtime_ns", "mode")
    event_node = d.node("1", d.sha("'c'||cast(event_id as string)"), "event_id%5000", "event_id*1000000", "33188")
    zero = "repeat('0',64)"
    return {
        "leaf": f"""select doc_id, source, lang, path, kind, cast({d.octets("content")} as bigint) size,
            1700000000000000000-(doc_id%1000)*4000000000000000 mtime_ns,
            cast(case when kind=3 then 41471 when doc_id%10=0 then 33261 else 33188 end as bigint) mode,
            {d.sha("content")} content_hash, content
            from (select doc_id, source, lang, '/'||source||'/'||lang||'/'||cast(doc_id as string)||'.txt' path,
                case when doc_id%17=3 then 3 else 1 end kind,
                case when doc_id%17=3 then '/'||source||'/'||lang||'/target' else text end content from {{documents}}) x""",
        "dirs": f"""select distinct path, 2 kind, cast(0 as bigint) size, cast(0 as bigint) mtime_ns, cast(16877 as bigint) mode, {zero} content_hash
            from (select '/' path union all select '/'||source from {{documents}} union all select '/'||source||'/'||lang from {{documents}}
                union all select '/'||source||'/empty' from {{documents}}) d""",
        "tree_master": f"""select path,kind,size,mtime_ns,mode,content_hash, {row_node} node
            from (select path,kind,size,mtime_ns,mode,content_hash from leaf union all select * from dirs) m""",
        "tree_local": f"""select path,kind,size,mtime_ns,mode,content_hash, {row_node} node from (
            select path, case when doc_id%23=0 then 2 else kind end kind,
                case when doc_id%23=0 then 0 when doc_id%11=0 then size+1 else size end size,
                case when doc_id%23=0 then 0 else mtime_ns end mtime_ns,
                cast(case when doc_id%23=0 then 16877 when doc_id%13=0 then 33152 else mode end as bigint) mode,
                case when doc_id%23=0 then {zero} when doc_id%11=0 then {d.sha("content_hash||'!'")} else content_hash end content_hash
                from leaf where doc_id%7<>0
            union all select path||'.new',1,size,mtime_ns,cast(33188 as bigint),content_hash from leaf where doc_id%19=0
            union all select * from dirs
            union all select distinct '/'||source||'/localonly',2,cast(0 as bigint),cast(0 as bigint),cast(16877 as bigint),{zero} from {{documents}}) t""",
        "synced": f"""select l.path, case when l.doc_id%3=0 then coalesce(t.node,m.node) when l.doc_id%3=1 then m.node else {d.sha("l.path||'older'")} end last_node,
            case when l.doc_id%2=0 then l.content_hash end last_content
            from leaf l left join tree_master m on m.path=l.path left join tree_local t on t.path=l.path where l.doc_id%5<>0""",
        "changes": f"""select seq, ts, actor, ck, op, path, kind, size, mtime_ns, mode, content_hash, new_node,
            case when event_type='signup' then null
                when event_type='error' then lag(new_node,2) over (partition by path order by seq)
                else lag(new_node,1) over (partition by path order by seq) end basis
            from (select event_id seq, {d.ts("ts")} ts, 's'||cast(user_id%8 as string) actor, '' ck, event_type,
                case when event_type='purchase' then 'delete' else 'announce' end op,
                '/u'||cast(user_id%10 as string)||'/f'||cast(user_id as string)||'.txt' path,
                1 kind, event_id%5000 size, event_id*1000000 mtime_ns, cast(33188 as bigint) mode, {d.sha("'c'||cast(event_id as string)")} content_hash,
                case when event_type='purchase' then null else {event_node} end new_node from {{events}}) e""",
        "pages_raw": "select page_id, case when page_id%9=4 then '' else '/' end||regexp_extract(url,'^https?://([^/?#]+)([^?#]*)',1)||case when page_id%7=2 then '/..' else '' end||regexp_extract(url,'^https?://([^/?#]+)([^?#]*)',2) raw from {pages}",
        "sources": "select distinct source, cast(substr(source,4) as int) n from {documents}",
        "subscr": """select 's'||cast(n%5 as string) slave, source checkout, '/'||source central, '/data/'||source local from sources
            union all select 'bak','all','/','/backup' union all select 's0','deep','/src1/en','/data/src1/en'""",
        "acl": """select slave, 'key-'||slave public_key, prefix allowed_prefix from (select 'bak' slave, '/' prefix
            union all select 's'||cast(n%5 as string), '/'||source from sources where n%2=0) a""",
        "messages": f"""select event_id, {d.ts("ts")} ts, 's'||cast(user_id%8 as string) slave, case when event_id%2=0 then 'in' else 'out' end direction,
            case event_type when 'click' then 'CasAccept' when 'error' then 'CasReject' when 'view' then 'DirListRequest' when 'signup' then 'RootReport' else 'BulkIn' end msg,
            case when event_type='error' then 'cas_reject:/u '||cast(user_id%3 as string) end reason,
            case when event_type='purchase' then event_id%1000*100 end bytes from {{events}}""",
        "waits": f"""select event_id%4 grp, case when user_id%8=7 then null else 's'||cast(user_id%8 as string) end peer,
            case event_type when 'error' then 'origin_bytes' when 'click' then 'fulfill_parked' when 'view' then 'reconcile' when 'signup' then 'hashing' else 'fanout' end stage,
            {d.ts("ts")} since, event_id%20+1 depth, 'own' source from {{events}}""",
        "gauges": f"""select 's'||cast(user_id%8 as string) peer, cast(case when {d.days(d.ts("ts"))}>=16 then 2 else 1 end as bigint) generation, event_id%200 seq, {d.ts("ts")} received,
            case when event_id%4=0 then null else event_type end stage, event_id%5000 age_ms, event_id%20 depth, event_id%2 parked, event_id%3 sending, event_id%7 pending
            from {{events}}""",
        "idle_gauges": f"""select 's'||cast(user_id%8 as string) peer, cast(1 as bigint) generation, event_id seq, {d.ts("ts")} received, case when user_id%8%2=0 then null else event_type end stage,
            event_id%5000 age_ms, event_id%20 depth, case when user_id%8=2 then 1 else 0 end parked, cast(0 as int) sending, event_id%7 pending from {{events}}""",
        "raw_events": f"""select event_id id, '' ck, {d.ts("ts")} ts, case event_type when 'signup' then 'Create' when 'view' then 'Write' when 'click' then 'Metadata' when 'purchase' then 'Remove' else 'Rename' end kind,
            {d.idiv("event_id", 10)} cookie, case when event_type='error' and event_id%2=1 then null else '/w/u'||cast(user_id%10 as string)||'/f'||cast(user_id as string) end path,
            case when event_type='error' and event_id%3>0 then case when event_id%5=0 then '/else' else '/w' end||'/u'||cast(user_id%10 as string)||'/g'||cast(user_id as string) end to_path,
            case when event_id%2=0 then 'from' else 'to' end half, event_type, user_id from {{events}}""",
        "attempts": f"select event_id id, '10.0.0.'||cast(user_id%16 as string) ip, {d.ts('ts')} ts from {{events}}",
        "epochs": "select '/'||source prefix, cast(2+max(doc_id)%3 as bigint) generation from {documents} where source is not null group by source",
        "applied": "select '/'||source prefix, cast(1+max(doc_id)%4 as bigint) generation from {documents} where source<>'src2' group by source",
        "bodies": f"""select path, content body, case when doc_id%29=0 then {d.sha("'bad'")} else content_hash end want_hash,
            case when doc_id%11=0 then 'XX'||content else content end edited from leaf""",
    }


def _levels(tree: str, name: str, deepest: int = 3) -> dict[str, str]:
    """DuckDB: the hashed index of a tree, level by level."""
    out = {
        f"{name}_p": f"""select *, case when path='/' then null when regexp_replace(path,'/[^/]*$','')='' then '/' else regexp_replace(path,'/[^/]*$','') end parent,
            case when path='/' then '/' else regexp_extract(path,'[^/]*$') end name, length(path)-length(replace(path,'/',''))-case when path='/' then 1 else 0 end depth from {tree}"""
    }
    entry = "printf('%02x',kind)||printf('%08x',strlen(name))||hex(encode(name))||child"
    for k in range(deepest, -1, -1):
        below = f" union all select parent,name,2,dir_node from {name}_d{k + 1}" if k < deepest else ""
        out[f"{name}_d{k}"] = f"""select d.path, d.parent, d.name, sha256(unhex(coalesce(string_agg({entry}, '' order by c.name) filter (where c.name is not null),''))) dir_node
            from {name}_p d left join (select parent,name cname,name,kind,node child from {name}_p where depth={k + 1} and kind<>2
            {below.replace("parent,name,2", "parent,name,name,2")}) c on c.parent=d.path where d.kind=2 and d.depth={k} group by 1,2,3""".replace("strlen(name)", "strlen(c.name)").replace("encode(name)", "encode(c.name)").replace("printf('%02x',kind)", "printf('%02x',c.kind)")
    dirs = " union all ".join(f"select path, dir_node from {name}_d{k}" for k in range(deepest + 1))
    out[name] = f"select p.*, d.dir_node, coalesce(d.dir_node, p.node) child from {name}_p p left join ({dirs}) d on d.path=p.path"
    return out


MIXED = "select * from tree_local where not (path='/src1' or path like '/src1/%') union all select * from tree_master where path='/src1' or path like '/src1/%'"
DUCK = _texts(Duck) | {"tree_mixed": MIXED} | _levels("tree_master", "index_master") | _levels("tree_local", "index_local") | _levels("tree_mixed", "index_mixed")
SPARK = _texts(Spark)


def _chain(sql: str, texts: dict[str, str]) -> list[str]:
    """The fixtures that sql needs, each after those it needs itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in texts:
            if name not in found and re.search(rf"(from|join)\s+{name}\b", text):
                visit(texts[name])
                found.append(name)

    visit(sql)
    return found


def _with(sql: str, texts: dict[str, str]) -> str:
    chain = ", ".join(f"{n} as ({texts[n]})" for n in _chain(sql, texts))
    return f"with {chain} {sql}" if chain else sql


def duck_sql(sql: str) -> str:
    """sql with the fixtures it names, for DuckDB."""
    recursive = "recursive" in sql.split("(")[0].lower()
    if sql.lstrip().lower().startswith("with "):
        own = re.sub(r"^\s*with\s+(recursive\s+)?", "", sql, flags=re.I)
        chain = ", ".join(f"{n} as ({DUCK[n]})" for n in _chain(sql, DUCK))
        sql = f"with {'recursive ' if recursive else ''}{chain + ', ' if chain else ''}{own}"
    else:
        sql = _with(sql, DUCK)
    return sql.format(**{t: t for t in TABLES})


class Fixtures:
    """fixtures("name") as DataFrames over the tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        text = _with(sql, SPARK)
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})

    def __call__(self, name: str) -> DataFrame:
        if name in ("index_master", "index_local"):
            return written(tree_hash(self(name.replace("index", "tree")).drop("node")), name)
        return self.sql(f"select * from {name}")
