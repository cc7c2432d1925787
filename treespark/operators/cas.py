"""Compare-and-swap over change logs, conflict copies and fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import Scratch, decide, keys, small_side, written
from ..functions.paths import ancestors_of, conflict_name, covers, top_of
from ..schema import DIR, RESERVED, ZERO_HASH
from .ordered import FALL, MAKE, NEVER, edges, fold, fold_parts, in_parts, last_in_parts, placed, spanned, steps_in_parts


def _accepts(op: Column, basis: Column, current: Column) -> Column:
    return F.when((op != "delete") & basis.isNull(), current.isNull()).otherwise(F.coalesce(current == basis, F.lit(False)))


def decide_cas(announces: DataFrame, index: DataFrame) -> DataFrame:
    """C1. announces (path, op, basis) with verdict and current: a create needs an absent row, else basis must be current."""
    ks = keys(announces, "path")
    rows = announces.join(index.select(*ks, F.col("node").alias("current")), ks, "left")
    return rows.withColumn("verdict", F.when(_accepts(F.col("op"), F.col("basis"), F.col("current")), "accept").otherwise("reject"))


def _log(changes: DataFrame, index: DataFrame | None) -> DataFrame:
    """changes with ck and start: the kind's digit and node that index has for the path."""
    ks = keys(changes, "path")
    kind = "kind" if "kind" in changes.columns else F.lit(1).alias("kind")
    log = changes.select(*ks, "seq", "op", kind, "basis", "new_node")
    if index is None:
        log = log.withColumn("start", F.lit(None).cast("string"))
    else:
        own = F.coalesce(F.col("kind"), F.lit(1)) if "kind" in index.columns else F.lit(1)
        named = index if "ck" in index.columns or "ck" not in ks else index.withColumn("ck", F.lit(""))
        log = log.join(named.select(*ks, F.concat(own.cast("string"), F.col("node")).alias("start")), ks, "left")
    log = log if "ck" in ks else log.withColumn("ck", F.lit(""))
    return log.withColumns({c: F.col(c).cast("string") for c in ("ck", "path")})


def fold_changes(changes: DataFrame, index: DataFrame | None = None, part_rows: int | None = None) -> DataFrame:
    """C2. (ck, path, seq, verdict, current, final): each path's log of leaf changes, folded in order of seq by C1.

    Logs are cut into parts of bounded size (operators/ordered.py): a hot path's log is folded by many tasks. final comes by a join with each path's
    last change, whose hot keys Spark splits.
    """
    ks = keys(changes, "path")
    judged = written(fold(_log(changes, index), part_rows), "judged")
    last = judged.groupBy("ck", "path").agg(F.max_by(F.substr("after", F.lit(2)), "seq").alias("final"))
    return judged.select("ck", "path", "seq", "verdict", "current").join(last, ["ck", "path"]).select(*ks, "seq", "verdict", "current", "final")


def final_state(changes: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """C2. (ck, path, node) that exist after the log."""
    done = fold_changes(changes, index)
    return done.groupBy(*keys(done, "path")).agg(F.max("final").alias("node")).where("node is not null")


def _above(df: DataFrame, *more: str) -> DataFrame:
    """(ck, dir, ...): a row for each directory above the path, but `/`."""
    return df.select("ck", F.explode(F.filter(ancestors_of(F.col("path")), lambda a: a != "/")).alias("dir"), *more)


def _falls(judged: DataFrame) -> DataFrame:
    """Accepted changes that drop what is below: deletes, and anything but a directory over a directory."""
    over = (F.col("before_kind") == DIR) & ~F.startswith("after", F.lit(str(DIR)))
    return judged.where((F.col("verdict") == "accept") & (F.col("after").isNull() | over)).select("ck", F.col("path").alias("dir"), "seq")


def _makes(judged: DataFrame) -> DataFrame:
    """Directories that accepted changes below them make, where these are absent."""
    return _above(judged.where("verdict = 'accept' and after is not null"), "seq").select("ck", F.col("dir").alias("path"), "seq")


def _short(node: Column) -> Column:
    """A node of over 23 characters by 128 bits of its SHA-256, in 24 characters; others as they are."""
    return F.when(F.length(node) < 24, node).otherwise(F.base64(F.substr(F.unhex(F.sha2(node, 256)), F.lit(1), F.lit(16))))


def _asks(table: DataFrame, rows: list) -> DataFrame:
    """(ck, dir, path, seq, since, start): each step of a table in parts by each directory above, with the seq of the path's step before."""
    prev = spanned(rows)
    heads = [x for r in rows if r["_part"] in prev for x in (F.lit(r["_part"]), F.lit(prev[r["_part"]]).cast("bigint"))]
    before = F.lag("seq").over(Window.partitionBy("_part", "ck", "path").orderBy("_pos"))
    carried = F.when(F.col("_pos") == 0, F.element_at(F.create_map(*heads), F.col("_part"))) if heads else F.lit(None)
    return _above(table.withColumn("since", F.coalesce(before, carried, F.lit(NEVER))), "path", "seq", "since", "start")


def _judged_tree(changes: DataFrame, index: DataFrame, part_rows: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The log with verdicts, its nodes in short; and (ck, path, id, node): what these stand for."""
    log = _log(changes, index)
    start = F.concat(F.substr("start", F.lit(1), F.lit(1)), _short(F.substr("start", F.lit(2))))
    whole = lambda c: F.when(F.length(c) > 23, c)
    log = log.withColumns({"put": whole(F.col("new_node")), "had": whole(F.substr("start", F.lit(2))), "basis": _short(F.col("basis")), "new_node": _short(F.col("new_node")), "start": start})
    log = scratch.written(log, "tree_log")
    table, rows = steps_in_parts(log, part_rows, scratch, True)  # sorted once: rounds differ in effects only
    asks = in_parts(_asks(table, rows), ["ck", "dir"], ["seq"], part_rows, scratch)
    asked = edges(asks, ["ck", "dir"])
    # directories that have a log and something below them that has one
    dirs = scratch.written(asks.select("ck", F.col("dir").alias("path")).distinct().join(table.select("ck", "path", "start").distinct(), ["ck", "path"]), "dirs")
    effects = None
    while True:
        steps = table if effects is None else table.unionByName(effects, allowMissingColumns=True)
        judged = scratch.written(fold_parts(steps, rows, scratch), "judged")
        falls = scratch.written(_falls(judged).join(asks.select("ck", "dir").distinct(), ["ck", "dir"], "left_semi"), "falls")
        told = last_in_parts(asks, asked, falls, ["ck", "dir"], "fall").where("fall > since").select("ck", "path", F.col("fall").alias("seq"), "start", F.lit(FALL).alias("op"))
        made = _makes(judged).join(small_side(dirs), ["ck", "path"]).select("ck", "path", "seq", "start", F.lit(MAKE).alias("op"))
        now = scratch.written(placed(told.unionByName(made).withColumn("kind", F.lit(0)), rows, ["ck", "path"]), "effects")
        scratch.drop(falls)
        n = now.count()
        # as many, and none is new: the changes are told the same as before, and so have the same verdicts
        same = n == 0 if effects is None else n == effects.count() and now.exceptAll(effects).isEmpty()
        if effects is not None:
            scratch.drop(effects)
        if same:
            break
        scratch.drop(judged)
        effects = now
    scratch.drop(now, asks, dirs, table)
    put = small_side(judged.where("verdict = 'accept' and length(after) > 24").select("ck", "path", "seq", F.substr("after", F.lit(2)).alias("id")))
    nodes = log.where("put is not null").select("ck", "seq", F.col("put").alias("node")).join(put, ["ck", "seq"]).select("ck", "path", "id", "node")
    had = log.where("had is not null").select("ck", "path", F.substr("start", F.lit(2)).alias("id"), F.col("had").alias("node"))
    nodes = scratch.written(nodes.unionByName(had).distinct(), "nodes")
    scratch.drop(log)
    return judged, nodes


def fold_tree_changes(changes: DataFrame, index: DataFrame, part_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C3. ((ck, seq, path, verdict, current), (ck, path, kind, node)): the verdicts of a log with directory changes, and the rows there are after it.

    A delete, or anything but a directory put over a directory, drops what is below; a new entry makes its missing
    ancestors as directories (with an empty node). Verdicts go by C1 on the path's own state. Seqs are unique in a namespace, and 0 at least; `/` is no row.

    Method: each path's log is folded by itself (operators/ordered.py), which sorts the log once; accepted changes then act on other paths: a fall on all below its
    directory from its seq on, a making on all above. A path is told of the last fall between two of its own changes (by running maxima over (directory, seq)) and of
    makings, as further steps of its log, and logs are folded again, until all are told the same as before. A verdict hangs on smaller seqs only, so there is one such state, and each
    round settles at least one more link of the longest chain of changes that decide one another across paths. Nothing is grouped by
    top component: hot directories and paths are cut into parts.

    Rounds carry long nodes as 128 bits of their SHA-256, and drop what the round before wrote; nodes are put back at the end, by a join with the accepted changes.
    """
    ks = keys(changes)
    with Scratch(changes.sparkSession, "zstd") as scratch:
        judged, nodes = _judged_tree(changes, index, part_rows, scratch)
    kept = index.where("path <> '/'").select(*keys(index, "path"), "kind", "node")
    kept = (kept if "ck" in kept.columns else kept.withColumn("ck", F.lit(""))).select("ck", "path", F.concat(F.col("kind").cast("string"), "node").alias("state"), F.lit(-1).cast("bigint").alias("at"))
    own = judged.groupBy("ck", "path").agg(F.max_by("after", "seq").alias("state"), F.max("seq").alias("at"))
    own = _whole(own, F.substr("state", F.lit(2)), nodes).withColumn("state", F.concat(F.substr("state", F.lit(1), F.lit(1)), "node")).drop("node")
    made = _makes(judged).groupBy("ck", "path").agg(F.max("seq").alias("made"))
    last = written(_falls(judged).groupBy("ck", "dir").agg(F.max("seq").alias("dropped")), "falls")
    rows = kept.join(own.select("ck", "path"), ["ck", "path"], "left_anti").unionByName(own)
    rows = written(rows.join(made, ["ck", "path"], "full"), "ends")
    dropped = _above(rows, "path").join(small_side(last), ["ck", "dir"]).groupBy("ck", "path").agg(F.max("dropped").alias("dropped"))
    since = F.coalesce("at", F.lit(-1))
    rows = rows.join(dropped, ["ck", "path"], "left")
    fell = F.coalesce(F.col("dropped") > since, F.lit(False))
    rose = F.coalesce(F.col("made") > F.when(fell, F.col("dropped")).otherwise(since), F.lit(False))
    state = F.when(rose & (fell | F.col("state").isNull()), "2").when(~fell, F.col("state"))
    final = rows.withColumn("_s", state).where("_s is not null").select(*ks, "path", F.substr("_s", F.lit(1), F.lit(1)).cast("int").alias("kind"), F.substr("_s", F.lit(2)).alias("node"))
    long = F.coalesce(F.length("current") == 24, F.lit(False))
    verdicts = _whole(judged.where(long), F.col("current"), nodes).withColumn("current", F.col("node")).select(judged.columns).unionByName(judged.where(~long))
    return verdicts.select(*ks, "seq", "path", "verdict", "current"), final


def _whole(df: DataFrame, node: Column, nodes: DataFrame) -> DataFrame:
    """df (ck, path, ...) with the whole node that each short one stands for."""
    return df.withColumn("id", node).join(small_side(nodes), ["ck", "path", "id"], "left").withColumn("node", F.coalesce("node", "id")).drop("id")


def two_phase_cas(announces: DataFrame, finishes: DataFrame, index: DataFrame) -> DataFrame:
    """C4. A verdict for each finish (finish_seq, path, want_hash, body_ok), decided again when it comes.

    announces: seq, path, op, basis, new_node, want_hash. A finish whose body failed asks for it whole the first time
    and keeps the live row from the second on. Without a pending announce it is accepted if the live row already has
    the wanted content (index: path, node, content_hash), else unknown_transfer.
    """
    pend = announces.select("path", "want_hash", "op", "basis", "new_node", F.col("seq").alias("announce_seq"))
    first = pend.groupBy("path", "want_hash").agg(F.min_by(F.struct("op", "basis", "new_node"), "announce_seq").alias("p"))
    rows = finishes.join(first, ["path", "want_hash"], "left").join(index.select("path", F.col("content_hash").alias("live")), "path", "left")
    failed = F.row_number().over(Window.partitionBy("path", "want_hash", "body_ok").orderBy("finish_seq"))
    rows = rows.withColumn("nth", failed)
    known = F.col("p").isNotNull()
    bodies = decide((~known & F.coalesce(F.col("live") == F.col("want_hash"), F.lit(False)), "accept"), (~known, "unknown_transfer"), (~F.col("body_ok") & (F.col("nth") == 1), "retry_whole"), (~F.col("body_ok"), "keep_live"), otherwise="cas")
    rows = rows.withColumn("verdict", bodies)
    log = rows.where("verdict = 'cas'").select("path", F.col("finish_seq").alias("seq"), "p.op", "p.basis", "p.new_node")
    judged = fold_changes(log, index).select(F.col("seq").alias("finish_seq"), "path", F.col("verdict").alias("_cas"))
    out = rows.join(judged, ["finish_seq", "path"], "left")
    return out.select("finish_seq", "path", "want_hash", F.coalesce("_cas", "verdict").alias("verdict"))


def decide_incoming(announces: DataFrame, local: DataFrame) -> DataFrame:
    """C5. announces (path, kind, content_hash, node, basis) with action at a replica that holds local."""
    mine = local.select("path", F.col("kind").alias("_kind"), F.col("content_hash").alias("_content"), F.col("node").alias("_node"))
    other = (F.col("_kind") != F.col("kind")) | (F.col("_content") != F.col("content_hash"))
    action = decide((F.col("_node").isNull(), "Apply"), (F.col("_node") == F.col("node"), "NoopRefresh"), (F.col("_node").eqNullSafe(F.col("basis")), "Apply"), (other, "ConflictThenApply"), otherwise="MetaOnly")
    return announces.join(mine, "path", "left").withColumn("action", action).drop("_kind", "_content", "_node")


def decide_incoming_delete(deletes: DataFrame, local: DataFrame, synced: DataFrame) -> DataFrame:
    """C6. deletes (path, basis) with action."""
    mine = local.select("path", F.col("kind").alias("_kind"), F.col("content_hash").alias("_content"), F.col("node").alias("_node"))
    last = synced.select("path", F.col("last_node").alias("_last"), F.col("last_content").alias("_last_content"))
    node = F.col("_node")
    action = decide(
        (node.isNull(), "AlreadyGone"), ((node == F.col("basis")) | (node == F.col("_last")), "Remove"), (F.col("_kind") == DIR, "Remove"),
        (F.col("_content") == F.col("_last_content"), "Remove"), otherwise="ConflictThenRemove",
    )
    return deletes.join(mine, "path", "left").join(last, "path", "left").withColumn("action", action).drop("_kind", "_content", "_node", "_last", "_last_content")


def decide_incoming_rename(renames: DataFrame, local: DataFrame, synced: DataFrame) -> DataFrame:
    """C7. renames (path, to_path, basis, node: the row's node at its new place) with action."""
    old = local.select("path", F.col("kind").alias("_kind"), F.col("node").alias("_from"))
    new = local.select(F.col("path").alias("to_path"), F.col("node").alias("_to"))
    last = synced.select("path", F.col("last_node").alias("_last"))
    live = F.col("_from")
    action = decide(
        (live.isNull() & (F.col("_to") == F.col("node")), "NoopRefresh"), (live.isNull(), "CreateAtTo"),
        ((live == F.col("basis")) | (live == F.col("_last")), "Apply"), (F.col("_kind") == DIR, "Apply"), otherwise="ConflictThenApply",
    )
    return renames.join(old, "path", "left").join(new, "to_path", "left").join(last, "path", "left").withColumn("action", action).drop("_kind", "_from", "_to", "_last")


def conflicts(losers: DataFrame, winners: DataFrame) -> DataFrame:
    """C8. Copies to keep of losing versions (path, kind, size, content_hash) that aren't directories and differ in content
    from the version coming in (a removal counts as the zero hash)."""
    rows = losers.join(winners.select("path", F.col("content_hash").alias("_new")), "path", "left")
    kept = rows.where((F.col("kind") != DIR) & (F.col("content_hash") != F.coalesce("_new", F.lit(ZERO_HASH)))).drop("_new")
    return kept.withColumn("conflict_path", conflict_name(F.col("path"), F.col("content_hash")))


def fanout(commits: DataFrame, subscr: DataFrame) -> DataFrame:
    """C9. A message for each subscription whose central covers a commit (seq, path, op, previous, slave, checkout), the
    origin's own excepted; basis is the node before, null on a create."""
    near = commits.withColumn("central", F.explode(ancestors_of(F.col("path"), include_self=True)))
    to = small_side(subscr.select("central", F.col("slave").alias("to_slave"), F.col("checkout").alias("to_checkout")))
    own = F.col("slave").eqNullSafe(F.col("to_slave")) & F.col("checkout").eqNullSafe(F.col("to_checkout"))
    rows = near.join(to, "central").where(~own)
    return rows.select("seq", "to_slave", "to_checkout", F.when(F.col("op") == "delete", "Remove").otherwise("Announce").alias("msg"), "path", F.col("previous").alias("basis"))


def fanout_renames(renames: DataFrame, subscr: DataFrame) -> DataFrame:
    """C10. Renames (seq, path, to_path, slave, checkout) for each subscription: Rename if both ends are covered, else Remove or Announce."""
    rows = renames.withColumn("_ends", F.array(F.struct(F.lit("from").alias("end"), F.col("path").alias("at")), F.struct(F.lit("to").alias("end"), F.col("to_path").alias("at"))))
    ends = rows.select("seq", "path", "to_path", "slave", "checkout", F.explode("_ends").alias("e"))
    near = ends.withColumn("central", F.explode(ancestors_of(F.col("e.at"), include_self=True)))
    to = small_side(subscr.select("central", F.col("slave").alias("to_slave"), F.col("checkout").alias("to_checkout")))
    own = F.col("slave").eqNullSafe(F.col("to_slave")) & F.col("checkout").eqNullSafe(F.col("to_checkout"))
    hit = near.join(to, "central").where(~own).groupBy("seq", "path", "to_path", "to_slave", "to_checkout")
    seen = hit.agg(F.bool_or(F.col("e.end") == "from").alias("f"), F.bool_or(F.col("e.end") == "to").alias("t"))
    return seen.select("seq", "path", "to_path", "to_slave", "to_checkout", decide((F.col("f") & F.col("t"), "Rename"), (F.col("f"), "Remove"), otherwise="Announce").alias("msg"))


def check_renames(renames: DataFrame, index: DataFrame, subscr: DataFrame) -> DataFrame:
    """C11. renames (path, to_path, basis, slave, checkout) with verdict and failing: both ends inside the checkout and not
    reserved, to_path absent, then basis current."""
    rows = renames.join(small_side(subscr.select("slave", "checkout", "central")), ["slave", "checkout"], "left")
    rows = rows.join(index.select("path", F.col("node").alias("_from")), "path", "left").join(index.select(F.col("path").alias("to_path"), F.col("node").alias("_to")), "to_path", "left")
    reserved = lambda p: F.coalesce(top_of(F.substr(F.col(p), F.when(F.col("central") == "/", 1).otherwise(F.length("central") + 1))).isin(*RESERVED), F.lit(False))
    outside = lambda p: ~F.coalesce(covers(F.col("central"), F.col(p)), F.lit(False))
    steps = [(outside("path"), "outside_central", "path"), (outside("to_path"), "outside_central", "to_path"), (reserved("path"), "reserved_name", "path"), (reserved("to_path"), "reserved_name", "to_path"),
             (F.col("_to").isNotNull(), "cas_reject", "to_path"), (~F.coalesce(F.col("_from") == F.col("basis"), F.lit(False)), "cas_reject", "path")]
    verdict = decide(*[(c, v) for c, v, _ in steps], otherwise="accept")
    failing = reduce(lambda chain, s: F.when(s[0], F.col(s[2])).otherwise(chain), reversed(steps), F.lit(None).cast("string"))
    return rows.withColumn("verdict", verdict).withColumn("failing", failing).drop("central", "_from", "_to")


def rename_prefix(meta: DataFrame, renames: DataFrame) -> DataFrame:
    """C12. meta with each subtree at renames.path moved to to_path; nothing else changes."""
    moves = small_side(renames.select(F.col("path").alias("_at"), "to_path"))
    hit = meta.select(*keys(meta, "path"), F.explode(ancestors_of(F.col("path"), include_self=True)).alias("_at")).join(moves, "_at")
    deepest = hit.groupBy(*keys(meta, "path")).agg(F.max_by(F.struct("_at", "to_path"), F.length("_at")).alias("m"))
    rows = meta.join(deepest, keys(meta, "path"), "left")
    moved = F.concat(F.col("m.to_path"), F.substr(F.col("path"), F.length("m._at") + 1))
    return rows.withColumn("path", F.coalesce(moved, F.col("path"))).drop("m")


def advance_synced(index: DataFrame, verdicts: DataFrame) -> DataFrame:
    """C14. index (path, node, content_hash, last_node, last_content) after verdicts (path, op, verdict, node): an accepted
    change becomes last_node, its content last_content only if the row still has that node; an accepted delete clears."""
    v = verdicts.where("verdict = 'accept'").select("path", F.col("op").alias("_op"), F.col("node").alias("_new"))
    rows = index.join(v, "path", "left")
    live = F.col("node").eqNullSafe(F.col("_new"))
    cleared, hit = F.col("_op") == "delete", F.col("_op").isNotNull()
    return (
        rows.withColumn("last_content", F.when(cleared, None).when(hit & live, F.col("content_hash")).when(hit, None).otherwise(F.col("last_content")))
        .withColumn("last_node", F.when(cleared, None).when(hit, F.col("_new")).otherwise(F.col("last_node"))).drop("_op", "_new")
    )


def stage_announces(found: DataFrame, synced: DataFrame, inflight: DataFrame) -> DataFrame:
    """C15. Rows of found (path, node, ...) to announce: not reserved, no echo of a write in flight (path, node), not as last
    agreed; basis is what was."""
    rows = found.where(~F.coalesce(top_of(F.col("path")).isin(*RESERVED), F.lit(False)))
    rows = rows.join(inflight.select("path", "node").distinct(), ["path", "node"], "left_anti").join(synced.select("path", F.col("last_node").alias("basis")), "path", "left")
    return rows.where(~F.col("node").eqNullSafe(F.col("basis")))


def stage_deletes(gone: DataFrame, index: DataFrame, synced: DataFrame) -> DataFrame:
    """C16. A delete (path, basis) for each path of gone that has a row."""
    rows = gone.select("path").join(index.select("path", "node"), "path").join(synced.select("path", "last_node"), "path", "left")
    return rows.select("path", F.coalesce("last_node", "node").alias("basis"))


def match_bodies(wants: DataFrame, bodies: DataFrame) -> DataFrame:
    """C17. wants (path, content_hash) with source: `held` where some body has that hash, else `ask`."""
    have = bodies.select("content_hash", F.lit("held").alias("source")).distinct()
    return wants.join(have, "content_hash", "left").withColumn("source", F.coalesce("source", F.lit("ask")))


