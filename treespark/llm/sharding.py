"""Sharding along a Hilbert curve, with DataFrame functions only.

Method: each metadata dimension is quantised to 2^BITS codes by its own quantiles over all rows (approx_percentile; a text is
ranked by the seven bytes after the prefix that all values share, which keeps its order). The codes are a cell of a grid, and the cell's place
on the grid's Hilbert curve (Skilling's transposed form, as a fold over a literal list of steps) is the row's curve index. Rows are
sorted by curve index: one shuffle, by ranges, whose sorted partitions become files, with each row's place in its file. Runs of equal length of the
whole order are the shards: a table `runs` says for each shard and file which places of the file belong to it, and the
smallest and largest value of every dimension there. So a shard is read from its own runs only (places are sorted, so Parquet skips the
rest of a file at a cut), and a filter on any of the dimensions drops runs before any file is opened.

Law `rows`: any two shards differ by one row at most. No text goes through more than one shuffle, and nothing but runs is counted globally: one row a
file and shard. Ties on the curve go by the ids given in `ties`, then by a hash of the row, so a hot cell is cut like any other; only rows that are
equal in everything stay in one file.

Defined results: a null value has code 0, below all others; rows with null ids are sharded like others; equal rows get places side by side; an empty
table gives no runs. Texts are read whole, and kept whole. Other columns are kept; added ones get names that are not taken.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clear_of, shared_dir, small_side, written

BITS = 6
#: Rows of a file, about; there are at least FILES files for each shard.
FILE_BYTES, FILES = 128 << 20, 2
ACCURACY = 10_000
#: Up to so many runs (one a file and shard) are broadcast; beyond, Spark shuffles.
MAX_BROADCAST_RUNS = 1_000_000


def _shared_prefix(low: str, high: str) -> int:
    """How many bytes all values between low and high share."""
    a, b = low.encode(), high.encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _ordered(df: DataFrame, dims: list[str]) -> dict[str, Column]:
    """Each dimension as a number that keeps its order."""
    kinds = dict(df.dtypes)
    texts = [d for d in dims if kinds[d] == "string"]
    ends = df.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in texts for f in (F.min, F.max)]).first() if texts else {}
    found: dict[str, Column] = {}
    for d in dims:
        if d in texts:
            low, high = ends[f"min_{d}"] or "", ends[f"max_{d}"] or ""
            own = F.substring(F.col(d).cast("binary"), _shared_prefix(low, high) + 1, 7)
            found[d] = F.conv(F.rpad(F.hex(own), 14, "0"), 16, 10).cast("bigint")
        elif kinds[d] in ("date", "boolean", "timestamp", "timestamp_ntz"):
            found[d] = F.unix_micros(F.col(d).cast("timestamp")) if kinds[d] != "boolean" else F.col(d).cast("bigint")
        else:
            found[d] = F.col(d)
    return found


def _edges(df: DataFrame, numbers: dict[str, Column], bits: int) -> dict[str, list]:
    """The quantiles that part each dimension's values into 2^bits codes, each once."""
    parts = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(n, parts, ACCURACY).alias(d) for d, n in numbers.items()]).first()
    return {d: sorted(set(row[d] or [])) for d in numbers}


def code_of(number: Column, edges: list) -> Column:
    """0 for null, else 1 and how many edges lie below the number; as many codes as bits allow."""
    if not edges:
        return F.when(number.isNull(), 0).otherwise(1).cast("int")
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < number))
    return F.when(number.isNull(), 0).otherwise(F.greatest(F.lit(1), below)).cast("int")


def curve_index(codes: list[Column], bits: int) -> Column:
    """The place of a cell (a code of `bits` bits for each dimension) on the Hilbert curve of the grid, below 2^(bits * dimensions)."""
    n = len(codes)
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    step = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def undo(x: Column, s: Column) -> Column:
        own, mask = F.get(x, s["i"]), s["q"] - 1
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(mask)
        low = F.when(own.bitwiseAND(s["q"]) != 0, mask).otherwise(swap)
        turned = lambda v, j: v.bitwiseXOR(F.when(j == 0, low).when((j == s["i"]) & (own.bitwiseAND(s["q"]) == 0), swap).otherwise(0))
        return F.transform(x, turned)

    def gray(x: Column) -> Column:  # each dimension takes the bits of all before it
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def spread(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        turn = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(0) for b in range(1, bits)], F.lit(0))
        bit = lambda k: F.shiftright(F.get(x, F.lit(k % n)).bitwiseXOR(turn), bits - 1 - k // n).bitwiseAND(F.lit(1)).cast("bigint")
        return sum((F.shiftleft(bit(k), bits * n - 1 - k) for k in range(bits * n)), F.lit(0).cast("bigint"))

    start = F.array(*[c.cast("int") for c in codes])
    undone = F.aggregate(step, start, undo) if steps else start
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a fold over one element evaluates the value once
    return bound(bound(undone, gray), spread)


def write_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int, root: str | None = None, bits: int = BITS, text: str = "text") -> str:
    """Writes df in curve order, with its runs, below root (a fresh folder in the shared one, if not given), and returns it.

    `rows` has df's columns and, under names kept in `about.json`, the curve index, the file's number and the place in it; `runs` has shard, file, from_place, to_place,
    first_slot, and min_ and max_ of each dimension.
    """
    spark = df.sparkSession
    root = root or f"{shared_dir(spark)}/treespark/shards-{uuid.uuid4().hex}"
    curve, file, place = (clear_of(df, name) for name in ("curve", "file", "place"))
    numbers = _ordered(df, dims)
    edges = _edges(df, numbers, bits)
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    files = max(FILES * shards, -(-size // FILE_BYTES))
    cells = df.withColumn(curve, curve_index([code_of(numbers[d], edges[d]) for d in dims], bits))
    order = [curve, *ties, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])]
    at = F.monotonically_increasing_id()  # of a sorted partition: its number, and the place in it
    placed = cells.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn(place, at)
    placed = placed.withColumn(file, F.shiftright(place, 33).cast("int")).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    placed.write.option("compression", "zstd").parquet(f"{root}/rows")
    about = spark.createDataFrame([(json.dumps({"curve": curve, "file": file, "place": place, "dims": dims, "shards": shards}),)], "value string")
    about.coalesce(1).write.text(f"{root}/about")
    rows = spark.read.parquet(f"{root}/rows")
    _runs(rows, file, place, dims, shards).write.parquet(f"{root}/runs")
    return root


def _runs(rows: DataFrame, file: str, place: str, dims: list[str], shards: int) -> DataFrame:
    """The runs of each shard: as the smaller shards have total div shards rows, the first total mod shards have one more."""
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    counted = written(rows.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("n")), "files")  # a row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    base, more = divmod(total, shards)
    cut = F.expr(f"shard * {base}L + least(shard, {more}L)")
    edge = rows.sparkSession.range(shards).select(F.col("id").alias("shard")).select("shard", cut.alias("low"), F.expr(f"(shard + 1) * {base}L + least(shard + 1, {more}L)").alias("high"))
    files = counted.select("file", "n", before.alias("first"))
    met = files.join(F.broadcast(edge), (F.col("first") < F.col("high")) & (F.col("low") < F.col("first") + F.col("n")))
    from_place = F.greatest(F.lit(0), F.col("low") - F.col("first"))
    spans = written(met.select(
        F.col("shard").cast("int").alias("shard"), "file", from_place.alias("from_place"), (F.least("n", F.col("high") - F.col("first")) - 1).alias("to_place"),
        (F.col("first") + from_place - F.col("low")).alias("first_slot"),
    ), "spans")
    own = rows.select(F.col(file).alias("file"), F.col(place).alias("_place"), *dims)
    seen = own.join(small_side(spans, MAX_BROADCAST_RUNS), "file").where(F.col("_place").between(F.col("from_place"), F.col("to_place")))
    return seen.groupBy("shard", "file", "from_place", "to_place", "first_slot").agg(F.count("*").alias("n"), *ends)


def _about(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/about").first()[0])


def read_shards(spark: SparkSession, root: str, shard: int | None = None, within: dict[str, tuple] | None = None) -> DataFrame:
    """The rows of one shard, or of all, with shard and slot (0, 1, ... along the curve). within: bounds (low, high) of dimensions; the runs
    that can't hold such rows are left out by the smallest and largest values, and the rest is filtered."""
    about = _about(spark, root)
    file, place = about["file"], about["place"]
    runs, rows = spark.read.parquet(f"{root}/runs"), spark.read.parquet(f"{root}/rows")
    if shard is not None:
        runs = runs.where(F.col("shard") == shard)
    for d, (low, high) in (within or {}).items():
        runs = runs.where((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
        rows = rows.where(F.col(d).between(low, high))
    names = {n: clear_of(rows, n) for n in ("shard", "slot")}
    kept = runs.select(F.col("file").alias(file), "from_place", "to_place", "first_slot", F.col("shard").alias(names["shard"]))
    if shard is not None or within:  # the places are sorted in each file, so these bounds let Parquet skip what no run has
        spans = kept.agg(F.min("from_place"), F.max("to_place"), F.min(file), F.max(file)).first()
        rows = rows.where(F.col(place).between(spans[0], spans[1]) & F.col(file).between(spans[2], spans[3])) if spans[0] is not None else rows.limit(0)
    met = rows.join(small_side(kept, MAX_BROADCAST_RUNS), file).where(F.col(place).between(F.col("from_place"), F.col("to_place")))
    return met.withColumn(names["slot"], F.col("first_slot") + F.col(place) - F.col("from_place")).drop("from_place", "to_place", "first_slot", file, place, about["curve"])
