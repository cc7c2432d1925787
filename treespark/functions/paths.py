"""Column expressions and row jobs on paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import decide, small_side
from ..schema import CONFLICTS, LINK, RESERVED


def normal_form(raw: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(raw, "/"), lambda x: x != ""), "/"))


def parent_of(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", F.lit(None)).when(up == "", "/").otherwise(up)


def name_of(path: Column) -> Column:
    return F.when(path == "/", "/").otherwise(F.substring_index(path, "/", -1))


def depth_of(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def top_of(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.lit(1))


def ancestors_of(path: Column, include_self: bool = False) -> Column:
    """The ancestors, nearest first, down to `/`."""
    parts = F.split(path, "/")
    last = F.size(parts) - (0 if include_self else 1)
    below = F.transform(F.filter(F.sequence(last, F.lit(2), F.lit(-1)), lambda n: last >= 2), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(path == "/", F.array(F.lit("/")) if include_self else F.array().cast("array<string>")).otherwise(
        F.when(last >= 2, F.concat(below, F.array(F.lit("/")))).otherwise(F.array(F.lit("/")))
    )


def covers(prefix: Column | str, path: Column) -> Column:
    """If path is prefix or below it."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (prefix == "/") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def canonicalize_paths(df: DataFrame, col: str, strict: bool = True) -> DataFrame:
    """P1. df with path and path_error; strict: a path that is spelled otherwise is an error, else it is rewritten."""
    raw = F.col(col)
    dots = F.exists(F.split(raw, "/"), lambda x: (x == ".") | (x == ".."))
    error = decide((raw.isNull() | ~F.startswith(raw, F.lit("/")), "NotAbsolute"), (dots, "DotComponent"), ((normal_form(raw) != raw) & F.lit(strict), "NonCanonical"))
    return df.withColumn("path_error", error).withColumn("path", F.when(F.col("path_error").isNull(), normal_form(raw)))


def with_path_parts(df: DataFrame, col: str = "path") -> DataFrame:
    """P2."""
    p = F.col(col)
    return df.withColumns({"parent": parent_of(p), "name": name_of(p), "depth": depth_of(p), "top": top_of(p)})


def explode_ancestors(df: DataFrame, include_self: bool = False, col: str = "path", out: str = "ancestor") -> DataFrame:
    """P3. A row for each ancestor: turns prefix joins into equi-joins."""
    return df.withColumn(out, F.explode(ancestors_of(F.col(col), include_self)))


@F.udtf(returnType="ancestor string, distance int")
class PathAncestors:
    """P3 as a table function for lateral joins in SQL: the ancestors of a path, nearest first, and how far each is."""

    def eval(self, path: str, include_self: bool = False):
        if path is None:
            return
        distance = 0
        if include_self:
            yield path, distance
        while path != "/":
            path, distance = path.rsplit("/", 1)[0] or "/", distance + 1
            yield path, distance


def register_path_ancestors(spark: SparkSession) -> None:
    """Makes path_ancestors(path[, include_self]) known to SQL. Column code should take explode_ancestors, which stays in the JVM."""
    spark.udtf.register("path_ancestors", PathAncestors)


def filter_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """P4. Rows at or below prefix; also prunes partitions by `top` where df has it."""
    rows = df.where(covers(prefix, F.col("path")))
    return rows.where(F.col("top") == prefix.split("/")[1]) if prefix != "/" and "top" in df.columns else rows


def drop_reserved(df: DataFrame, central: str | None = None, names: tuple[str, ...] = RESERVED) -> DataFrame:
    """P5. Without rows whose first component, of the path or of the path below central, is reserved."""
    path = F.col("path")
    first = top_of(path) if central in (None, "/") else top_of(F.substr(path, F.lit(len(central) + 1)))
    return df.where(~F.coalesce(first.isin(*names), F.lit(False)))


def rebase(path: Column, source: Column, target: Column) -> Column:
    """path moved from below source to below target; null if it is not below source."""
    rest = F.when(source == "/", path).otherwise(F.substr(path, F.length(source) + 1))
    base = F.when(target == "/", "").otherwise(target)
    whole = F.concat(base, F.when(rest == "/", "").otherwise(rest))
    return F.when(covers(source, path), F.when(whole == "", "/").otherwise(whole))


def rebase_paths(df: DataFrame, mappings: DataFrame, direction: str = "to_local") -> DataFrame:
    """P6. df (checkout, path) with rebased and path_error, by mappings (checkout, central, local)."""
    source, target = ("central", "local") if direction == "to_local" else ("local", "central")
    moved = rebase(F.col("path"), F.col(source), F.col(target))
    joined = df.join(small_side(mappings.select("checkout", "central", "local")), "checkout", "left")
    return joined.withColumn("rebased", moved).withColumn("path_error", F.when(F.col("rebased").isNull(), "EscapesRoot")).drop("central", "local")


def conflict_name(path: Column, content_hash: Column) -> Column:
    return F.concat(F.lit(f"/{CONFLICTS}"), path, F.lit("--"), F.substring(content_hash, 1, 16))


def conflict_path(df: DataFrame, central_col: str = "path") -> DataFrame:
    """P7."""
    return df.withColumn("conflict_path", conflict_name(F.col(central_col), F.col("content_hash")))


def flag_escaping_links(tree: DataFrame, root: str = "/") -> DataFrame:
    """P8. tree with escapes: some ancestor is a link whose target, resolved by spelling, is outside root.

    A link's row has its target in `target`. `..` steps are resolved; above `/` they stay at `/`.
    """
    here = F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat(parent_of(F.col("path")), F.lit("/"), F.col("target")))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(here, "/"), F.array().cast("array<string>"), step), "/"))
    links = tree.where((F.col("kind") == LINK) & ~covers(root, resolved)).select(F.col("path").alias("ancestor")).distinct()
    bad = explode_ancestors(tree.select("path")).join(links, "ancestor", "left_semi").select("path").distinct()
    return tree.join(bad.withColumn("_bad", F.lit(True)), "path", "left").withColumn("escapes", F.coalesce("_bad", F.lit(False))).drop("_bad")
