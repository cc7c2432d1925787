"""The registered queries of the library's own operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.diff import diff_trees, plan_summary
from . import diff_queries, log_queries, status_queries, tree_queries
from .fixtures import Fixtures

PARTS = [tree_queries, diff_queries, log_queries, status_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By top directory: how many entries a restore of the master inventory over the local one copies, replaces, deletes."""
    f = Fixtures(spark, sf_dir)
    return plan_summary(diff_trees(f("tree_master"), f("tree_local"))).orderBy("prefix")


def queries() -> dict:
    return {name: job for part in PARTS for name, job in part.R.jobs.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, sql in part.R.sql.items()}
