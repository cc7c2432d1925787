"""Fixed schemas and constants. Paths are absolute, without empty, `.` or `..` components; `/` is the root."""

FILE, DIR, LINK = 1, 2, 3
ZERO_HASH = "0" * 64
#: First components that hold the engine's own files.
CONFLICTS = ".tree-conflicts"
RESERVED = (CONFLICTS, ".tree-state")
SCHEMA_VERSION = 1

META = "ck string, path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string"
META_FIELDS = ["kind", "size", "mtime_ns", "mode", "content_hash"]
CHANGE = "seq bigint, ts timestamp, actor string, ck string, op string, path string, to_path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string, new_node string, basis string"
#: Stage codes of gauge frames.
STAGES = ["hashing", "uplink", "origin_bytes", "fulfill_read", "fulfill_parked", "apply_write", "fanout", "fanout_dropped", "reconcile", "unobserved"]
GAUGE_MAGIC = "61736731"
