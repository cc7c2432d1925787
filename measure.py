
import json
import os
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treespark.common import shared_dir, written
from treespark.operators import cas, diff
from treespark.operators.tree import tree_hash
from treespark.plans.fixtures import Fixtures
from treespark.schema import META_FIELDS
from treespark.sources import snapshots, tree_index


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("measure").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    f, out = Fixtures(spark, sf_dir), {}
    snapshots.FILE_ROWS = 500  # as small tables have few files otherwise

    def timed(name, run):
        began = time.time()
        found = run()
        out[name] = {"s": round(time.time() - began, 2)} | (found or {})

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    tree = written(f("tree_master").select("path", *META_FIELDS), "tree")
    index = written(tree_hash(tree).withColumn("ck", F.lit("")), "index")
    fresh = lambda: f"{shared_dir(spark)}/treespark/measured-{uuid.uuid4().hex}"
    left = fresh()
    snapshots.write_snapshot(index, left)
    timed("full tree hash", lambda: done(tree_hash(tree)))
    for share in (0.001, 0.01, 0.5):
        some = F.pmod(F.xxhash64("path"), F.lit(100_000)) < share * 100_000
        changes = written(tree.where((F.col("kind") == 1) & some).withColumns({"size": F.col("size") + 1, "ck": F.lit(""), "seq": F.lit(1).cast("bigint")}), "changes")
        right = fresh()
        snapshots.write_snapshot(index, right)
        timed(f"merge of {share:.1%} into a stored index", lambda: {"version": tree_index.update_index(spark, right, changes), "changes": changes.count()})
        whole = written(snapshots.read_snapshot(spark, right), "whole")

        def walk():
            found, levels = tree_index.prune_walk(spark, left, right)
            done(found)
            return dict(zip(("opened", "visited", "rows_read"), levels.agg(F.sum("opened"), F.sum("visited"), F.sum("rows_read")).first()))

        timed(f"pruned walk, {share:.1%} differ", walk)
        timed(f"flat diff, {share:.1%} differ", lambda: done(diff.diff_trees(index, whole)))
    log = written(f("changes").limit(100_000), "log")
    timed("fold of the change log", lambda: done(cas.fold_changes(log)) or {"changes": log.count()})
    subscr = spark.range(10_000).select(F.concat(F.lit("s"), F.col("id") % 100).alias("slave"), F.col("id").cast("string").alias("checkout"), F.concat(F.lit("/src"), F.col("id") % 20, F.when(F.col("id") % 3 == 0, "/en").otherwise("")).alias("central"))
    commits = f.sql("select doc_id seq, path, 'announce' op, content_hash previous, 'x' slave, source checkout from leaf")
    timed("fan-out to 10,000 subscriptions", lambda: done(cas.fanout(commits, subscr.withColumn("local", F.lit("/")))))
    print(json.dumps(out, indent=1))


if __name__ == "__main__":
    main()
