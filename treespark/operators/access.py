"""Access rules and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import decide, small_side
from ..functions.paths import ancestors_of, covers, normal_form, top_of
from ..schema import RESERVED


def allowed(requests: DataFrame, acl: DataFrame) -> DataFrame:
    """requests (slave, central) with allowed: some prefix of the slave's rules covers central."""
    rules = small_side(acl.select("slave", F.col("allowed_prefix").alias("_rule")).distinct())
    near = requests.select("slave", "central").distinct().withColumn("_rule", F.explode(ancestors_of(F.col("central"), include_self=True)))
    ok = near.join(rules, ["slave", "_rule"], "left_semi").select("slave", "central", F.lit(True).alias("allowed")).distinct()
    return requests.join(ok, ["slave", "central"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def audit_subscriptions(requests: DataFrame, acl: DataFrame, max_checkouts: int = 100) -> DataFrame:
    """A1. One verdict for each slave's request (slave, checkout, central): unknown_key, too_many, duplicate (among the
    allowed), denied (with the denied centrals, sorted, joined by commas), or accept."""
    known = small_side(acl.select("slave", F.lit(True).alias("known")).distinct())
    rows = allowed(requests, acl)
    by = rows.groupBy("slave").agg(
        F.count("*").alias("n"),
        F.count_if("allowed").alias("n_allowed"),
        F.count_distinct(F.when(F.col("allowed"), F.col("checkout"))).alias("n_ids"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("allowed"), F.col("central")))), ",").alias("denied"),
    )
    verdict = decide((F.col("known").isNull(), "unknown_key"), (F.col("n") > max_checkouts, "too_many"), (F.col("n_ids") < F.col("n_allowed"), "duplicate"), (F.col("denied") != "", "denied"), otherwise="accept")
    return by.join(known, "slave", "left").select("slave", verdict.alias("verdict"), F.when(verdict == "denied", F.col("denied")).alias("denied"))


def retry_subscriptions(requests: DataFrame, denied: DataFrame) -> DataFrame:
    """A2. What a slave asks for after a denial: the rest of its checkouts; with none left, it hangs up."""
    left = requests.join(denied.select("slave", "central").distinct(), ["slave", "central"], "left_anti")
    return requests.select("slave").distinct().join(left.groupBy("slave").agg(F.count("*").alias("checkouts")), "slave", "left").select(
        "slave", F.coalesce("checkouts", F.lit(0)).alias("checkouts"), F.when(F.col("checkouts").isNull(), "hangup").otherwise("retry").alias("next")
    )


def authorize_changes(changes: DataFrame, subscr: DataFrame, wipes: DataFrame) -> DataFrame:
    """A3. changes (slave, checkout, op, path, to_path) with verdict. wipes: prefixes whose delete is pending.

    A delete that overlaps a wipe is `later` before all else; then not_subscribed, outside_central, and for a rename
    wiping before reserved_name, otherwise reserved_name before wiping.
    """
    pend = small_side(wipes.select("prefix").distinct())
    walk = changes.select("path", "to_path").distinct().select("path", F.explode(F.array("path", "to_path")).alias("end"), "to_path").where("end is not null")
    under = walk.withColumn("prefix", F.explode(ancestors_of(F.col("end"), include_self=True))).join(pend, "prefix", "left_semi").select("path", "to_path")
    above = pend.select(F.explode(ancestors_of(F.col("prefix"))).alias("path")).distinct().withColumn("_over", F.lit(True))
    hit = under.distinct().select(F.col("path").alias("_p"), F.col("to_path").alias("_t"), F.lit(True).alias("_under"))
    rows = changes.join(small_side(subscr.select("slave", "checkout", "central")), ["slave", "checkout"], "left")
    rows = rows.join(hit, (F.col("path") == F.col("_p")) & F.col("to_path").eqNullSafe(F.col("_t")), "left").drop("_p", "_t").join(above, "path", "left")
    inside = lambda p: F.coalesce(covers(F.col("central"), F.col(p)), F.lit(False))
    reserved = lambda p: F.coalesce(top_of(F.substr(F.col(p), F.when(F.col("central") == "/", 1).otherwise(F.length("central") + 1))).isin(*RESERVED), F.lit(False))
    wiping = F.col("_under").isNotNull()
    rename = F.col("op") == "rename"
    bad_name = reserved("path") | (rename & reserved("to_path"))
    verdict = decide(
        ((F.col("op") == "delete") & (wiping | F.col("_over").isNotNull()), "later"), (F.col("central").isNull(), "not_subscribed"),
        (~inside("path") | (rename & ~inside("to_path")), "outside_central"), (rename & wiping, "wiping"), (bad_name, "reserved_name"), (wiping, "wiping"), otherwise="ok",
    )
    return rows.withColumn("verdict", verdict).drop("central", "_under", "_over")


def validate_dimensions(acl: DataFrame, checkouts: DataFrame, max_checkouts: int = 100) -> DataFrame:
    """A4. Violations (entity, id, problem) of the tables acl (slave, public_key, allowed_prefix) and checkouts (slave,
    checkout, central, local)."""
    slaves = acl.select("slave", "public_key").distinct()
    row = lambda entity, col, problem: (F.lit(entity).alias("entity"), F.col(col).alias("id"), F.lit(problem).alias("problem"))
    bad_path = lambda p: ~F.coalesce(F.startswith(F.col(p), F.lit("/")) & (normal_form(F.col(p)) == F.col(p)) & ~F.exists(F.split(F.col(p), "/"), lambda x: x.isin(".", "..")), F.lit(False))
    found = [
        slaves.groupBy("slave").count().where("count > 1").select(*row("slave", "slave", "several_keys")),
        slaves.where("public_key <> ''").groupBy("public_key").count().where("count > 1").select(*row("key", "public_key", "duplicate_pin")),
        slaves.where("coalesce(public_key, '') = ''").select(*row("slave", "slave", "empty_pin")),
        slaves.where(~F.col("slave").rlike("^[A-Za-z0-9._:-]+$")).select(*row("slave", "slave", "bad_id")),
        acl.where(bad_path("allowed_prefix")).select(*row("slave", "slave", "bad_prefix")),
        checkouts.groupBy("slave", "checkout").count().where("count > 1").select(*row("checkout", "checkout", "duplicate_id")),
        checkouts.where(~F.col("checkout").rlike("^[A-Za-z0-9._:-]+$")).select(*row("checkout", "checkout", "bad_id")),
        checkouts.where(bad_path("central") | bad_path("local")).select(*row("checkout", "checkout", "bad_path")),
        checkouts.groupBy("slave").count().where(F.col("count") > max_checkouts).select(*row("slave", "slave", "too_many_checkouts")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def overlapping_locals(checkouts: DataFrame) -> DataFrame:
    """A5. Pairs (slave, outer, inner) of checkouts whose local paths are equal (by id) or one below the other."""
    near = checkouts.select("slave", F.col("checkout").alias("inner"), F.col("local").alias("path"), F.explode(ancestors_of(F.col("local"), include_self=True)).alias("at"))
    other = checkouts.select("slave", F.col("checkout").alias("outer"), F.col("local").alias("at"))
    pairs = near.join(other, ["slave", "at"]).where((F.col("inner") != F.col("outer")) & ((F.col("at") != F.col("path")) | (F.col("outer") < F.col("inner"))))
    return pairs.select("slave", "outer", "inner")


def diff_dimensions(old: DataFrame, new: DataFrame, key: list[str], restart: list[str] = ()) -> DataFrame:
    """A6. Rows added or removed; a changed row is both. needs_restart: some row with its key changed a column in restart."""
    moved = new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
    if not restart:
        return moved.withColumn("needs_restart", F.lit(False))
    fixed = old.select(*key, F.struct(*restart).alias("_o")).join(new.select(*key, F.struct(*restart).alias("_n")), key).where("_o <> _n").select(*key).distinct()
    return moved.join(fixed.withColumn("_r", F.lit(True)), key, "left").withColumn("needs_restart", F.coalesce("_r", F.lit(False))).drop("_r")


def live_sessions(connects: DataFrame) -> DataFrame:
    """A7. connects (ts, session, slave, public_key): each with its slave's generation, and whether it is live: the newest
    of its slave and of its key."""
    slave, public_key = Window.partitionBy("slave").orderBy("ts", "session"), Window.partitionBy("public_key").orderBy("ts", "session")
    last = F.lead("session").over(slave).isNull() & F.lead("session").over(public_key).isNull()
    return connects.select("session", "slave", "public_key", F.row_number().over(slave).cast("bigint").alias("generation"), last.alias("live"))
