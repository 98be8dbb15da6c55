"""Feeds: NDJSON registries, JSON snapshots, key tables, files, JSON-RPC lines, guarded SQL."""

from __future__ import annotations

import re
import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.operators.catalog import glob_regex

FEED = (
    "name string, description string, url string, command string, args array<string>, env map<string,string>, transport string, trust_score int, last_release string, "
    "open_issues int, downloads int, tokens_per_turn bigint, categories array<string>"
)
RPC = "id string, method string, params string"
MAX_FILE_BYTES = 1 << 20


def parsed_feed(lines: DataFrame, schema: str = FEED) -> DataFrame:
    """One entry per line of column value, beside the other columns; blank and malformed lines, and lines over 10 MiB, are dropped."""
    kept = lines.where((F.trim("value") != "") & (F.octet_length("value") <= 10 << 20))
    rest = [c for c in lines.columns if c != "value"]
    parsed = kept.select(*rest, F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select(*rest, "r.*").where("_bad is null and name is not null").drop("_bad")


def ndjson_feed(spark: SparkSession, path: str, schema: str = FEED) -> DataFrame:
    """The entries of NDJSON files."""
    return parsed_feed(spark.read.text(path), schema)


def feed_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an index file ``{"entries": [...]}``."""
    return spark.read.option("multiLine", True).schema(f"entries array<struct<{_struct(FEED)}>>").json(path).select(F.inline("entries"))


def _struct(schema: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in schema.split(", ")))


def feed_digest(feed: DataFrame) -> DataFrame:
    """One row that changes only if some entry does; order does not count."""
    return feed.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.xxhash64(F.to_json(F.struct(*feed.columns))).cast("decimal(38,0)")).alias("digest"))


def guarded_sql(spark: SparkSession, query: str, tries: int = 3) -> DataFrame:
    """A query that begins with SELECT or EXPLAIN; others, WITH included, are refused. Analysis is tried up to three times."""
    if not query.strip().upper().startswith(("SELECT", "EXPLAIN")):
        raise ValueError("only SELECT and EXPLAIN queries are allowed")
    for n in range(tries):
        try:
            return spark.sql(query)
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(0.05 * 2**n)
    raise AssertionError


def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, type string, temporary boolean").orderBy("name")


def key_scan(keys: DataFrame, column: str, pattern: str) -> DataFrame:
    return keys.where(F.col(column).rlike(glob_regex(pattern)))


def set_keys(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Last write wins: key, value, expires_at, seq."""
    both = store.unionByName(changes)
    return both.groupBy("key").agg(F.max_by(F.struct("value", "expires_at", "seq"), "seq").alias("r")).select("key", "r.*")


def live_keys(store: DataFrame, now: datetime) -> DataFrame:
    return store.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, modified, text of up to 1 MiB, truncated, of the files whose path below the root fits the glob.

    A star does not cross folders, two stars do; a glob without a slash is of file names in any folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = lambda p: re.sub(r"^[a-z0-9]+:/*(?=/)", "", p).rstrip("/") + "/"
    below = F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/*(?=/)', ''), {len(plain(path)) + 1})")
    name = F.element_at(F.split("path", "/"), -1) if "/" not in glob else below
    return files.select(
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.make_valid_utf8(F.substring("content", 1, MAX_FILE_BYTES).cast("string")).alias("text"),
        (F.col("length") > MAX_FILE_BYTES).alias("truncated"),
    ).where(name.rlike(glob_regex(glob, crosses=False)))


def read_named(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """name, text and error of each asked file (name, below the root): an unsafe name, or a file that isn't there, is an error and no failure."""
    found = read_files(spark, root).select(F.col("path").alias("_p"), "text")
    base = re.sub(r"^[a-z0-9]+:/*(?=/)", "", root).rstrip("/")
    place = F.regexp_replace("_p", "^[a-z0-9]+:/*(?=/)", "")
    asked = names.withColumn("_safe", safe_path(F.col("name")))
    out = asked.join(found.withColumn("_p", place), F.col("_safe") & (F.col("_p") == F.concat(F.lit(base + "/"), "name")), "left")
    error = F.when(~F.coalesce("_safe", F.lit(False)), "unsafe path").when(F.col("_p").isNull(), "not found")
    return out.select(*names.columns, "text", error.alias("error"))


def safe_path(path: Column) -> Column:
    """Not empty, not absolute, without a parent step."""
    return (path != "") & ~path.rlike(r"(^/|(^|/)\.\.(/|$))")


def fresh(cached: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    return cached.where(F.col("cached_at") > F.lit(now) - F.make_interval(hours=F.lit(hours)))


def rpc_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per JSON-RPC request: a line that begins with [ is a batch; what is no JSON is dropped. tool is params.name of tools/call, else the method."""
    text = F.trim(column)
    one = F.array(F.from_json(text, RPC))
    many = F.from_json(text, f"array<struct<{_struct(RPC)}>>")
    rows = lines.select("*", F.explode(F.when(text.startswith("["), many).otherwise(one)).alias("_r")).where("_r.method is not null")
    name = F.nullif(F.get_json_object("_r.params", "$.name"), F.lit(""))
    tool = F.when(F.col("_r.method").isin("tools/call", "invoke_tool"), F.coalesce(name, "_r.method")).otherwise(F.col("_r.method"))
    return rows.select(*[c for c in lines.columns if c != column], F.col("_r.id").alias("id"), F.col("_r.method").alias("method"), F.col("_r.params").alias("params"), tool.alias("tool"))


def merge_configs(*sources: DataFrame) -> DataFrame:
    """Server settings of several programs' files in one table; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
