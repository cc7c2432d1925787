"""treespark: tables of paths (inventories, hash trees, diffs, change logs, fleet status) on PySpark."""
