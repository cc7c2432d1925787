"""Watch events (E1 to E5, E7, E10). E1, E5 and E10 are stateless and work on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import decide, small_side
from ..functions.paths import ancestors_of, covers, rebase


def to_local_events(raw: DataFrame, root: str = "/") -> DataFrame:
    """E1. raw (ck, ts, kind, path, to_path) as events kind, path, to_path below root, and need_rescan on an overflow.

    Create and Write say Changed; a rename with both ends inside says Renamed, with one end Removed or Changed; access
    events and what is outside root say nothing.
    """
    inside = lambda p: F.coalesce(covers(root, F.col(p)), F.lit(False))
    old, new, kind = inside("path"), inside("to_path"), F.col("kind")
    rename = kind == "Rename"
    said = decide(
        (kind == "Overflow", "Rescan"), (rename & old & new, "Renamed"), (rename & old, "Removed"), (rename & new, "Changed"), (rename | ~old, None),
        (kind.isin("Create", "Write"), "Changed"), (kind == "Metadata", "Metadata"), (kind == "Remove", "Removed"),
    )
    moved = lambda p: rebase(F.col(p), F.lit(root), F.lit("/"))
    rows = raw.withColumn("event", said).where("event is not null")
    return rows.select("ck", "ts", "event", F.when(rename & ~old, moved("to_path")).otherwise(moved("path")).alias("path"), F.when(F.col("event") == "Renamed", moved("to_path")).alias("to_path"), (F.col("event") == "Rescan").alias("need_rescan"))


def debounce(events: DataFrame, gap: str = "200 milliseconds") -> DataFrame:
    """E2. One row for each burst of a path's events: the last kind, first and last time, count. For a stream, give it a
    watermark on ts."""
    burst = events.groupBy("ck", "path", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("w")


def pair_renames(events: DataFrame, window: str = "1 second") -> DataFrame:
    """E3. From and To halves (ck, cookie, ts, path) of one cookie of one checkout within window: Renamed; alone: Removed or
    Changed. On a stream both halves need watermarks; the join is the same."""
    old = events.where("half = 'from'").select("ck", "cookie", F.col("ts").alias("from_ts"), F.col("path").alias("from_path"))
    new = events.where("half = 'to'").select(F.col("ck").alias("ck2"), F.col("cookie").alias("cookie2"), F.col("ts").alias("to_ts"), F.col("path").alias("to_path"))
    near = (F.col("ck") == F.col("ck2")) & (F.col("cookie") == F.col("cookie2")) & (F.col("to_ts") >= F.col("from_ts") - F.expr(f"interval {window}")) & (F.col("to_ts") <= F.col("from_ts") + F.expr(f"interval {window}"))
    rows = old.join(new, near, "full")
    event = decide((F.col("from_path").isNull(), "Changed"), (F.col("to_path").isNull(), "Removed"), otherwise="Renamed")
    return rows.select(F.coalesce("ck", "ck2").alias("ck"), F.coalesce("cookie", "cookie2").alias("cookie"), event.alias("event"), F.coalesce("from_path", "to_path").alias("path"), F.when(event == "Renamed", F.col("to_path")).alias("to_path"))


def suppress_echo(events: DataFrame, applied: DataFrame, debounce_ms: int = 200) -> DataFrame:
    """E4. events (id, ck, path, ts, event, content_hash) without the echoes of writes applied (ck, path, ts, content_hash).

    A write arms its path for twice the debounce time; a later write of the path replaces it. The first event with the
    written content is dropped and disarms; while armed, Removed events of the path are dropped too.
    """
    w = Window.partitionBy("ck", "path").orderBy("armed")
    arms = applied.select("ck", "path", F.col("ts").alias("armed"), F.col("content_hash").alias("written"))
    arms = arms.withColumn("until", F.least(F.coalesce(F.lead("armed").over(w), F.timestamp_millis(F.lit(253402300799000))), F.col("armed") + F.expr(f"interval {2 * debounce_ms} milliseconds")))
    near = events.join(arms, ["ck", "path"]).where("ts >= armed and ts <= until")
    echo = F.min(F.when((F.col("event") != "Removed") & F.col("content_hash").eqNullSafe(F.col("written")), F.struct("ts", "id"))).over(Window.partitionBy("ck", "path", "armed"))
    at = near.withColumn("_echo", echo)
    gone = (F.col("_echo")["id"] == F.col("id")) | ((F.col("event") == "Removed") & (F.col("_echo").isNull() | (F.struct("ts", "id") < F.col("_echo"))))
    return events.join(at.where(gone).select("id").distinct(), "id", "left_anti")


def resolve_removes(events: DataFrame, listing: DataFrame) -> DataFrame:
    """E5. A Removed path that is there is Changed; a Changed path that is gone is Removed."""
    there = listing.select("path", F.lit(True).alias("_there")).distinct()
    rows = events.join(there, "path", "left")
    event = decide(((F.col("event") == "Removed") & F.col("_there").isNotNull(), "Changed"), ((F.col("event") == "Changed") & F.col("_there").isNull(), "Removed"))
    return rows.withColumn("event", F.coalesce(event, F.col("event"))).drop("_there")


def dedupe_asks(asks: DataFrame) -> DataFrame:
    """E7. asks (seq, ck, path, want_hash, op ask|done) without asks made while an equal one is open."""
    before = Window.partitionBy("ck", "path", "want_hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("op").over(before)
    return asks.withColumn("_last", last).where("op = 'ask' and coalesce(_last, 'done') = 'done'").drop("_last")


def expand_created_dirs(events: DataFrame, listing: DataFrame, index: DataFrame) -> DataFrame:
    """E10. events, and for a Changed directory also a Changed for every row of listing below it that index lacks."""
    new = listing.select("path").join(index.select("path"), "path", "left_anti")
    below = new.select(F.col("path").alias("found"), F.explode(ancestors_of(F.col("path"))).alias("path"))
    dirs = events.where("event = 'Changed'").select("ck", "path").distinct()
    more = dirs.join(small_side(below), "path").select("ck", F.lit("Changed").alias("event"), F.col("found").alias("path")).distinct()
    return events.select("ck", "event", "path").unionByName(more).distinct()
