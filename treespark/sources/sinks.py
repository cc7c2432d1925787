"""Writing status lines, trees and conflict copies."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_of
from ..operators.status import COUNTERS
from ..schema import DIR, LINK

SHORT = {"in_msgs": "in", "out_msgs": "out", "cas_accept": "cas_ok", "cas_reject": "cas_rej"}


def format_status_lines(status: DataFrame, period_s: int = 5) -> DataFrame:
    """S5. status with line: one for the fleet (slave is null) or a slave. An error shows as `-`, its reason, or reason*n."""
    head = F.when(F.col("slave").isNull(), F.lit(f"status {period_s}s ")).otherwise(F.concat(F.lit("status slave="), F.col("slave"), F.lit(" ")))
    error = F.when(F.col("last_error").isNull(), "-").when(F.col("error_count") > 1, F.concat("last_error", F.lit("*"), F.col("error_count").cast("string"))).otherwise(F.col("last_error"))
    shown = [c for c in COUNTERS if c != "fanout_dropped"]
    fields = [F.concat(F.lit(f"{SHORT.get(c, c)}="), F.col(c).cast("string")) for c in [*shown, "pending", "outbox", "writable", "fanout_dropped"]]
    parts = [F.concat(F.lit("health="), "health"), F.concat(F.lit("bottleneck="), "bottleneck"), F.concat(F.lit("connected="), F.col("connected").cast("string")), *fields, F.concat(F.lit("last_error="), error)]
    return status.withColumn("line", F.concat(head, F.concat_ws(" ", *parts)))


def write_tree(plan: DataFrame, bodies: DataFrame, root: str) -> DataFrame:
    """S7. Carries out a plan (path, action, kind, mtime_ns, mode, content_hash) below root, which every executor mounts;
    bodies (content_hash, body) hold contents and link targets. Returns path, outcome (done, hash_mismatch, no_body, or the
    error's name). Directories come first, the shallowest first; files and links go to a temporary name, are verified
    and renamed; deletes come last, the deepest first. Doing it twice changes nothing."""

    def safe(act):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples():
                    try:
                        out.append((row.path, act(row, root.rstrip("/") + row.path)))
                    except OSError as error:
                        out.append((row.path, type(error).__name__))
                yield pd.DataFrame(out, columns=["path", "outcome"])

        return run

    def make_dir(row, at: str) -> str:
        os.makedirs(at, exist_ok=True)
        return "done"

    def put(row, at: str) -> str:
        if row.body is None:
            return "no_body"
        if hashlib.sha256(row.body).hexdigest() != row.content_hash:
            return "hash_mismatch"
        os.makedirs(os.path.dirname(at), exist_ok=True)
        temporary = f"{at}.{os.getpid()}.part"
        if row.kind == LINK:
            os.symlink(os.fsdecode(bytes(row.body)), temporary)
        else:
            with open(temporary, "wb") as out:
                out.write(row.body)
            os.chmod(temporary, int(row.mode) & 0o7777)
            os.utime(temporary, ns=(int(row.mtime_ns), int(row.mtime_ns)))
        os.replace(temporary, at)
        return "done"

    def remove(row, at: str) -> str:
        if os.path.isdir(at) and not os.path.islink(at):
            os.rmdir(at)
        elif os.path.lexists(at):
            os.remove(at)
        return "done"

    from ..common import written
    from ..functions.paths import depth_of

    kind = "path string, outcome string"
    write = plan.where("action <> 'Delete'")
    dirs = written(write.where(F.col("kind") == DIR).select("path").repartition(parent_of(F.col("path"))).mapInPandas(safe(make_dir), kind), "dirs")
    files = write.where(F.col("kind") != DIR).join(bodies.select("content_hash", F.col("body").cast("binary").alias("body")).dropDuplicates(["content_hash"]), "content_hash", "left")
    files = written(files.select("path", "kind", "mtime_ns", "mode", "content_hash", "body").repartition("path").mapInPandas(safe(put), kind), "files")
    out = dirs.unionByName(files)
    gone = written(plan.where("action = 'Delete'").select("path", depth_of(F.col("path")).alias("depth")), "gone")
    for (depth,) in gone.select("depth").distinct().orderBy(F.desc("depth")).collect():
        out = out.unionByName(written(gone.where(F.col("depth") == depth).select("path").repartition("path").mapInPandas(safe(remove), kind), "removed"))
    return out


def write_conflicts(conflicts: DataFrame, out: str) -> None:
    """S8. Appends conflict copies (conflict_path, ...) that aren't in the Parquet table at out yet."""
    spark = conflicts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        conflicts = conflicts.join(spark.read.parquet(out).select("conflict_path"), "conflict_path", "left_anti")
    conflicts.dropDuplicates(["conflict_path"]).write.mode("append").parquet(out)
