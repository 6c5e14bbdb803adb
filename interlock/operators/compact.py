"""Consolidating many small files into few of a wanted size.

The rows are shuffled under a REBALANCE hint, so the adaptive planner merges
small and splits large output partitions by their measured sizes.  The planner
measures shuffled bytes; how many file bytes they make is measured on what was written, and
where the files miss the wanted size for that reason they are written once more from the staged ones.  The new files
are staged, read back, and take effect only if count, sum and xor of the row
hashes (a multiset checksum) equal those of the rows that went in.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interlock.session import data_files, exists, move, remove, scratch

TARGET_BYTES = 128 << 20
#: How far from the wanted size the mean file may be before it is written again.
_NEAR = (0.67, 1.33)


def _checksum(columns: list[str]) -> list[Column]:
    h = F.xxhash64(*columns)
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("total"),
        F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("parity"),
    ]


def checksum(df: DataFrame) -> tuple:
    """Multiset checksum of all rows: order and file layout don't matter, repeats do."""
    row = df.agg(*_checksum(df.columns)).first()
    return int(row["n"]), int(row["total"]), int(row["parity"])


@contextmanager
def _sized_by(spark: SparkSession, shuffled: int) -> Iterator[None]:
    """Output partitions of about so many shuffled bytes; by default the planner cuts smaller ones for the sake of parallelism."""
    wanted = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(max(1, shuffled)), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def compact(df: DataFrame, target: str, target_bytes: int = TARGET_BYTES, ratio: float | None = None) -> DataFrame:
    """Write ``df`` to the new folder ``target`` in files near ``target_bytes``; the table read back.

    ``ratio`` is how many file bytes a shuffled byte makes.  Without it the first staging takes it for 1, and if the
    files then miss the wanted size by more than a third they are written again, by the ratio measured.  With it there is one pass.

    The rows' checksum is taken on the way into the shuffle.  If it differs from
    that of the staged files (a retried stage may count twice), the source is
    summed again by itself; if it still differs nothing is committed.  An empty
    input gives an empty table of the same schema.  ``target`` must not exist.

    The commit is a rename, atomic where the file system's is (HDFS, local disks); on object stores readers should wait
    for the call to return.  Two planner settings of the session are changed while it writes: other threads
    of the same session plan with them meanwhile.
    """
    spark = df.sparkSession
    if exists(spark, target):
        raise FileExistsError(target)
    staging = f"{target}.staging-{uuid.uuid4().hex[:8]}"
    seen = Observation(f"compact-{uuid.uuid4().hex[:8]}")
    with _sized_by(spark, int(target_bytes / (ratio or 1.0))):
        df.observe(seen, *_checksum(df.columns)).hint("rebalance").write.parquet(staging)
    if ratio is None:
        staging = _resized(spark, df, staging, target_bytes)
    got = seen.get
    wanted = int(got["n"]), int(got["total"]), int(got["parity"])
    staged = checksum(spark.read.schema(df.schema).parquet(staging))
    if staged != wanted and staged != checksum(df):
        remove(spark, staging)
        raise RuntimeError(f"compaction of {target} lost or doubled rows: {wanted} became {staged}")
    if not move(spark, staging, target):
        raise RuntimeError(f"{target} could not be committed")
    return spark.read.schema(df.schema).parquet(target)


def _resized(spark: SparkSession, df: DataFrame, staging: str, target_bytes: int) -> str:
    """The staged folder, or a new one with files of the wanted size where the first missed it."""
    sizes = data_files(spark, staging)
    total = sum(sizes)
    mean = total / max(1, len(sizes))
    goal = min(target_bytes, total)  # less than one file's worth is one file
    if not sizes or _NEAR[0] * goal <= mean <= _NEAR[1] * goal:
        return staging
    again = f"{staging}-again"
    # the first pass cut at about ``target_bytes`` of shuffled bytes and got ``mean`` of file
    with _sized_by(spark, int(target_bytes * target_bytes / mean)):
        spark.read.schema(df.schema).parquet(staging).hint("rebalance").write.parquet(again)
    remove(spark, staging)
    return again


#: Only what makes a record is typed; every other field of an object stays in ``record``.
_FIELDS = "piece_id bigint, side_index int, is_edge boolean, vertices string, original_photo_name string, photo_width string, piece_center string"
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|[{}]')


def objects_over_lines(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of whole JSON objects that span several lines of a text that is no single object.

    An object starts with a line's first brace and ends with the line that closes it; what is cut off spoils only itself.
    """
    lines = text.split("\n")
    depth, at_depth = [0], {}
    for k, line in enumerate(lines):
        found = _TOKEN.findall(line)
        depth.append(depth[-1] + found.count("{") - found.count("}"))
        at_depth.setdefault(depth[-1], []).append(k)
    out: list[tuple[int, int, str]] = []
    at = 0
    while at < len(lines):
        end = None
        if depth[at + 1] > depth[at] and lines[at].lstrip().startswith("{"):
            later = at_depth.get(depth[at], [])
            n = bisect_left(later, at + 1)
            end = later[n] if n < len(later) else None
        part = "\n".join(lines[at : end + 1]).strip() if end is not None else ""
        if part and _is_object(part):
            out.append((at, end, part))
            at = end
        at += 1
    return out


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


_SPREAD = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("record", T.StringType())]))


@F.arrow_udf(_SPREAD)
def _over_lines(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("last", pa.int32()), ("record", pa.string())]))
    return pa.array([None if t is None else [{"line_no": a, "last": b, "record": r} for a, b, r in objects_over_lines(t)] for t in texts.to_pylist()], kind)


def _parsed(text: Column) -> Column:
    """The struct of a text that is one whole JSON object and nothing else, else null."""
    found = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{_FIELDS}>>", _STRICT)
    return F.when(F.ltrim(text).startswith("{"), F.transform(F.array(found), lambda a: F.when(F.size(a) == 1, a[0]))[0])


def side_records(files: DataFrame) -> DataFrame:
    """Every readable side record of small JSON files, one row each.

    A payload is one object in any layout, or several.  It is read as a whole if it is one object; else line by
    line, and where two or more lines can't be read by themselves, objects spread over several lines are
    looked for between those that can.  A record needs integer piece_id and side_index, two or more vertices and a
    boolean is_edge.  Null, empty or cut-off payloads and unreadable lines give no row and spoil
    no other.  ``record`` keeps the object's text unchanged, ``line_no`` its place.
    """
    text = F.trim(F.regexp_replace("payload", r"^[\s\x{FEFF}]+|\s+$", ""))
    lines = F.transform(F.split("t", r"\r?\n"), lambda s, i: F.struct(i.alias("line_no"), s.alias("record"), _parsed(s).alias("o")))
    whole = F.transform(F.array(_parsed(F.col("t"))), lambda o: F.struct(F.lit(0).alias("line_no"), F.col("t").alias("record"), o.alias("o")))
    # explode over one element keeps the planner from working a parse out for each use
    read = (
        files.select("file_path", "modified_at", text.alias("t"))
        .where(F.col("t") != "")
        .withColumn("whole", F.explode(F.array(whole)))
        .withColumn("by_line", F.explode(F.array(F.when(F.col("whole")[0]["o"].isNull() & F.col("t").contains("\n"), lines))))
    )
    unread = F.size(F.filter("by_line", lambda s: s["o"].isNull() & (F.trim(s["record"]) != "")))
    read = read.withColumn("over", F.coalesce(_over_lines(F.when(unread >= 2, F.col("t"))), F.array().cast(_SPREAD)))
    apart = F.filter("by_line", lambda s: ~F.exists("over", lambda o: s["line_no"].between(o["line_no"], o["last"])))
    spread = F.transform("over", lambda s: F.struct(s["line_no"].alias("line_no"), s["record"].alias("record"), _parsed(s["record"]).alias("o")))
    rows = read.select("file_path", "modified_at", F.explode(F.when(F.col("by_line").isNull(), F.col("whole")).otherwise(F.concat(apart, spread))).alias("r"))
    rows = rows.select("file_path", "modified_at", "r.line_no", "r.record", "r.o")
    good = F.col("o.piece_id").isNotNull() & F.col("o.side_index").isNotNull() & F.col("o.is_edge").isNotNull() & (F.json_array_length("o.vertices") >= 2)
    return rows.where(good).select(
        F.col("o.piece_id").alias("piece_id"),
        F.col("o.side_index").alias("side_index"),
        F.col("o.is_edge").alias("is_edge"),
        F.col("o.vertices").alias("vertices"),
        "file_path",
        "line_no",
        "modified_at",
        "record",
    )


def newest_file(records: DataFrame) -> DataFrame:
    """(piece_id, side_index, file_path) of the latest record of each side.

    Equal times go to the smallest path; files without a time come last.
    """
    age = F.coalesce(-F.unix_micros(F.col("modified_at").cast("timestamp")), F.lit(2**63 - 1))
    return records.groupBy("piece_id", "side_index").agg(F.min(F.struct(age.alias("age"), "file_path"))["file_path"].alias("file_path"))


def compacted_records(files: DataFrame, name: str = "side-records") -> DataFrame:
    """All readable side records, consolidated in the shared folder."""
    return compact(side_records(files), scratch(files.sparkSession, name))
