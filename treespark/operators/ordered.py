"""Folds over sorted logs whose keys may be hot: a key's log is cut into parts that run in many tasks.

A log is sorted by key and order into parts of bounded size (one range shuffle), each row with its part and its place in it. A fold runs part
by part. Only the first key of a part can come from the part before, so only there the state to start from is unknown: at most one
for each part. A fold of compare-and-swap steps is a map from the state before to the state after, and such a map is as small as the
set of bases in its rows: the maps of a hot key's parts are made side by side, followed from part to part, and then every part is folded
from its own right start.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import Scratch

#: Rows of a part, about.
PART_ROWS = 200_000


def in_parts(df: DataFrame, keys: list[str], order: list[str], part_rows: int | None = None, scratch: Scratch | None = None, stored: bool = False) -> DataFrame:
    """df (stored: of a written table, row by row) as a table sorted by keys and order, with _part (ascending along the order) and _pos (within the part)."""
    scratch = scratch or Scratch(df.sparkSession)
    log = df if stored else scratch.written(df, "log")
    parts = max(1, -(-log.count() // (part_rows or PART_ROWS)))
    row = F.monotonically_increasing_id()  # of a sorted partition: its number, and the place in it
    sorted_rows = log.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", row)
    table = scratch.written(sorted_rows.withColumns({"_part": F.shiftright("_row", 33).cast("int"), "_pos": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row"), "parts")
    if not stored:
        scratch.drop(log)
    return table


def edges(table: DataFrame, keys: list[str], *more: str) -> list:
    """(_part, first, last, since, seq, ...) for each part in order: its first and last key, the seqs there, and what else the first row has."""
    first, last = F.min_by(F.struct(*keys), "_pos").alias("first"), F.max_by(F.struct(*keys), "_pos").alias("last")
    rows = table.groupBy("_part").agg(first, last, F.min_by("seq", "_pos").alias("since"), F.max_by("seq", "_pos").alias("seq"), *[F.min_by(c, "_pos").alias(c) for c in more])
    return sorted(rows.collect(), key=lambda r: r["_part"])  # a row a part


def continued(table: DataFrame, keys: list[str]) -> dict[int, int]:
    """The parts that begin with the key that the part before ends with, and the last seq there."""
    return spanned(edges(table, keys))


def spanned(rows: list) -> dict[int, int]:
    """continued, of the table's edges."""
    return {b["_part"]: a["seq"] for a, b in zip(rows, rows[1:]) if a["last"] == b["first"]}


def placed(df: DataFrame, rows: list, keys: list[str]) -> DataFrame:
    """df (keys, seq, ...) with the _part of a table, by its edges, that each row stands in: that of the row before it, or if this has another key, of the row after it."""
    whole = lambda *key: tuple((v is not None, v) for v in key)  # noqa: E731  in Spark's order, nulls first
    starts = [whole(*r["first"], r["since"]) for r in rows]
    firsts, lasts, parts = [whole(*r["first"]) for r in rows], [whole(*r["last"]) for r in rows], [r["_part"] for r in rows]

    def place(*key) -> int:
        own, at = whole(*key[:-1]), bisect.bisect_right(starts, whole(*key)) - 1
        if at + 1 < len(parts) and firsts[at + 1] == own and (at < 0 or lasts[at] != own):
            at += 1
        return parts[max(at, 0)] if parts else 0

    @F.pandas_udf("int")
    def part(k: pd.DataFrame) -> pd.Series:
        return pd.Series([place(*row) for row in k.itertuples(index=False, name=None)], dtype="int32")

    return df.withColumn("_part", part(F.struct(*keys, "seq")))


def by_part(table: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], kind: str) -> DataFrame:
    """run over the rows of the table, whole parts in order in one task each."""
    return table.repartition("_part").sortWithinPartitions("_part", "_pos").mapInPandas(run, kind)


def by_part_in_arrow(table: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """by_part, for steps and what was placed among them: along ALONG."""
    return table.repartition("_part").sortWithinPartitions("_part", *ALONG).mapInArrow(run, kind)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's number in this order, from 1: its place in its part, after the rows of the parts before."""
    table = in_parts(df, [], order)
    sizes = sorted((r["_part"], r["count"]) for r in table.groupBy("_part").count().collect())  # a row a part
    before = dict(zip([p for p, _ in sizes], itertools.accumulate([n for _, n in sizes], initial=0)))
    first = F.create_map(*[F.lit(x) for p, n in (before or {0: 0}).items() for x in (p, n)])
    return table.withColumn(name, (F.element_at(first, F.col("_part")) + F.col("_pos") + 1).cast("bigint")).drop("_part", "_pos")


def last_before(asks: DataFrame, events: DataFrame, keys: list[str], name: str, part_rows: int | None = None) -> DataFrame:
    """asks (keys, seq, ...) with the greatest seq of the same keys' events (keys, seq) below its own, or null."""
    table = in_parts(asks, keys, ["seq"], part_rows)
    return last_in_parts(table, edges(table, keys), events, keys, name).select(*asks.columns, name)


def last_in_parts(table: DataFrame, rows: list, events: DataFrame, keys: list[str], name: str) -> DataFrame:
    """last_before of a table in parts by keys and seq, with its edges: the table is not sorted again for other events. A hot key's rows lie in
    many parts: the running maximum is taken in each, and each part's first key is told the last event in the parts before."""
    events = placed(events.select(*keys, "seq"), rows, keys)
    names = [f"_{k}" for k in keys]
    kinds = ", ".join(f"{n} {table.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))
    firsts = F.broadcast(table.sparkSession.createDataFrame([(*r["first"], r["_part"]) for r in rows], f"{kinds}, _to int"))  # a row a part
    same = F.col("_part") < F.col("_to")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    carried = events.groupBy(*keys, "_part").agg(F.max("seq").alias("seq")).join(firsts, same).groupBy(*keys, "_to").agg(F.max("seq").alias("seq"))
    told = events.unionByName(carried.withColumnRenamed("_to", "_part")).withColumn("_event", F.lit(1))
    all_rows = table.withColumn("_event", F.lit(0)).unionByName(told, allowMissingColumns=True)
    own = Window.partitionBy("_part", *keys).orderBy("seq", "_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return all_rows.withColumn(name, F.max(F.when(F.col("_event") == 1, F.col("seq"))).over(own)).where("_event = 0").drop("_event")


class Ways:
    """Where a range of compare-and-swap steps leads from every state it may start in. States are None (absent) or a kind's digit and a
    node; starts are known by their node, as their kind doesn't matter for a step."""

    OTHER = object()

    def __init__(self) -> None:
        self.starts: dict[str | None, dict[str | None, list]] = {}  # by the present node, and by the state with that node: the starts that led there
        self.seen: set[str | None] = set()
        self.settled = False  # after a reset no start is left as it was

    def step(self, basis: str | None, state: str | None) -> None:
        """What has node basis (None: what is absent) becomes state."""
        here = self._join(self.starts.pop(basis, {}).values())
        if not self.settled and basis not in self.seen:
            self.seen.add(basis)
            here.append(basis)
        if here:
            self._put(here, state)

    def reset(self, state: str | None) -> None:
        """Whatever was there becomes state."""
        here = self._join(group for states in self.starts.values() for group in states.values())
        self.starts.clear()
        self._put(here if self.settled else [*here, self.OTHER], state)
        self.settled = True

    @staticmethod
    def _join(groups) -> list:
        """One list of all, made by adding the others to the longest."""
        first, *rest = sorted(groups, key=len, reverse=True) or [[]]
        for group in rest:
            first.extend(group)
        return first

    def _put(self, here: list, state: str | None) -> None:
        states = self.starts.setdefault(None if state is None else state[1:], {})
        states[state] = self._join([here, states[state]]) if state in states else here

    def rows(self) -> list[tuple[str | None, bool, str | None]]:
        """(start, other, end): of a start by its node, or of all starts that aren't named."""
        return [(None if s is self.OTHER else s, s is self.OTHER, end) for states in self.starts.values() for end, group in states.items() for s in group]


FIELDS = ["ck", "path", "start", "seq", "op", "kind", "basis", "new_node"]
#: Steps that come from changes of other paths: the path falls with a directory above it, or is made as one (if absent) for something below it.
FALL, MAKE = "(fall)", "(make)"
ALONG = ("ck", "path", "seq", "_pos")
#: Before all seqs.
NEVER = -(1 << 63)


def _list(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def _heads(batch: pa.RecordBatch, last: tuple | None) -> tuple[list[bool], tuple]:
    """For each row, whether its part or key is another one than that of the row before (last: of the batch before); and the last row's."""
    columns = [batch.column(c) for c in ("_part", "ck", "path")]
    differs = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in columns]
    heads = _list(reduce(pc.or_, differs))
    return [tuple(c[0].as_py() for c in columns) != last, *heads], tuple(c[-1].as_py() for c in columns)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[_list(batch.column(c)) for c in ("op", "kind", "basis", "new_node")])


def _ways(rows: DataFrame) -> DataFrame:
    """The ways of each key's rows in each part."""
    kind = "_part int, ck string, path string, begin string, start string, other boolean, end string"
    kinds = pa.schema([("_part", pa.int32()), ("ck", pa.string()), ("path", pa.string()), ("begin", pa.string()), ("start", pa.string()), ("other", pa.bool_()), ("end", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = ways = last = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*at, *row) for row in ways.rows()]), kinds)] or [pa.array([], f.type) for f in kinds], schema=kinds)

        for batch in batches:
            if not batch.num_rows:
                continue
            heads, last = _heads(batch, last)
            for i, (head, (op, kind, basis, new)) in enumerate(zip(heads, _steps(batch))):
                if head:
                    if at is not None:
                        yield told()
                    at, ways = tuple(batch.column(c)[i].as_py() for c in ("_part", "ck", "path", "start")), Ways()
                if op == FALL:
                    ways.reset(None)
                elif op == MAKE:
                    ways.step(None, "2")
                elif op != "delete" or basis is not None:
                    ways.step(basis, None if op == "delete" else f"{kind}{new}")
        if at is not None:
            yield told()

    return by_part_in_arrow(rows, run, kind)


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state that each part of a key starts in, by following the ways from part to part."""
    key = part = state = named = other = None
    out = []
    for batch in batches:
        for ck, path, p, begin, start, is_other, end, real in zip(*[batch[c].tolist() for c in ("ck", "path", "_part", "begin", "start", "other", "end", "real")]):
            if (ck, path) != key:
                key, part, state, named, other = (ck, path), None, begin, None, None
            if p != part:
                way = named or other  # of the part that ends here
                state = way[0] if way else state
                part, named, other = p, None, None
                out.append((p, ck, path, state))
            if real and is_other:
                other = (end,)
            elif real and start == (None if state is None else state[1:]):
                named = (end,)
    yield pd.DataFrame(out, columns=["_part", "ck", "path", "state"])


def _starts(table: DataFrame, rows: list, scratch: Scratch) -> dict[int, str | None]:
    """For each part that continues a key: the state to start in."""
    prev, key = spanned(rows), ["ck", "path"]
    if not prev:
        return {}
    firsts = {r["_part"]: tuple(r["first"]) for r in rows if r["_part"] in prev}
    # the keys that lie in several parts, with each of these and the start, which all rows of a path have: two rows a part at most
    each = sorted({(*b["first"], p, b["start"]) for a, b in zip(rows, rows[1:]) if b["_part"] in prev for p in (a["_part"], b["_part"])}, key=lambda x: x[2])
    each = table.sparkSession.createDataFrame(each, "ck string, path string, _part int, begin string")
    border = sorted({*prev, *[a["_part"] for a, b in zip(rows, rows[1:]) if b["_part"] in prev]})
    ways = scratch.written(_ways(table.where(F.col("_part").isin(border)).join(F.broadcast(each.select(*key, "_part")), [*key, "_part"])), "ways")
    # a start is of use only if it is absence, or a node that some part leads to or the index has
    node = lambda c: F.substr(c, F.lit(2)).alias("start")
    led = ways.select(*key, node("end")).unionByName(ways.select(*key, node("begin"))).where("start is not null").distinct()
    useful = ways.where("start is null").unionByName(ways.where("start is not null").join(led, [*key, "start"], "left_semi").select(ways.columns))
    none = {"start": F.lit(None).cast("string"), "other": F.lit(False), "end": F.lit(None).cast("string"), "real": F.lit(False)}
    steps = each.withColumns(none).unionByName(useful.withColumn("real", F.lit(True))).repartition(*key).sortWithinPartitions(*key, "_part", "real")
    known = {r["_part"]: r["state"] for r in steps.mapInPandas(_chain, "_part int, ck string, path string, state string").collect() if (r["ck"], r["path"]) == firsts.get(r["_part"])}
    scratch.drop(ways)
    return known


def fold(log: DataFrame, part_rows: int | None = None) -> DataFrame:
    """(ck, path, seq, verdict, current, before_kind, after): the FIELDS folded path by path, in order of seq. start is the state the index
    has (a kind's digit and the node). current is the node before the change."""
    table, rows = steps_in_parts(log, part_rows)
    return fold_parts(table, rows)


def steps_in_parts(log: DataFrame, part_rows: int | None = None, scratch: Scratch | None = None, stored: bool = False) -> tuple[DataFrame, list]:
    """The steps as a table in parts, and its edges: what fold_parts takes."""
    table = in_parts(log.withColumn("kind", F.coalesce("kind", F.lit(0))).select(*FIELDS), ["ck", "path"], ["seq", "op", "basis", "new_node"], part_rows, scratch, stored)
    return table, edges(table, ["ck", "path"], "start")


def fold_parts(table: DataFrame, rows: list, scratch: Scratch | None = None) -> DataFrame:
    """fold, of a table made by steps_in_parts, and falls and makes (FALL, MAKE) placed in it; these have no row in the result."""
    known = _starts(table, rows, scratch or Scratch(table.sparkSession))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = part = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, last = _heads(batch, last)
            found = []
            for i, (head, (op, kind, basis, new)) in enumerate(zip(heads, _steps(batch))):
                if head:
                    p = batch.column("_part")[i].as_py()
                    state = known[p] if p != part and p in known else batch.column("start")[i].as_py()
                    part = p
                if op == FALL:
                    state = None
                    continue
                if op == MAKE:
                    state = "2" if state is None else state
                    continue
                ok = state is None if op != "delete" and basis is None else state is not None and state[1:] == basis
                current, was = (None, 0) if state is None else (state[1:], int(state[0]))
                if ok:
                    state = None if op == "delete" else f"{kind}{new}"
                found.append(("accept" if ok else "reject", current, was, state))
            if found:
                own = batch.filter(pc.invert(pc.is_in(batch.column("op"), pa.array([FALL, MAKE]))))
                told = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("ck", "path", "seq")], *told], names=["ck", "path", "seq", "verdict", "current", "before_kind", "after"])

    return by_part_in_arrow(table, follow, "ck string, path string, seq long, verdict string, current string, before_kind int, after string")
