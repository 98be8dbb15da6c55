"""Cost attribution over a call log: tool, server, tokens, ts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tokenscope.sources.tables import since

#: Fixed value: dollars per token of the cost export.
EXPORT_COST_PER_TOKEN = 0.000002


def drilldown(log: DataFrame, parent: str, value: str, child: str, start: datetime | None = None) -> DataFrame:
    """Calls, tokens, average and last call of every child of one parent, with the parent's total; most tokens first, then by name."""
    per_child = since(log.filter(F.col(parent) == value), start).groupBy(child).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.round(F.avg("tokens"), 6).alias("avg_tokens"),
        F.max("ts").alias("last_call"),
    )
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return per_child.withColumn("total_tokens", total).orderBy(F.desc("tokens"), child)


def by(log: DataFrame, *keys: str) -> DataFrame:
    """Tokens, calls and last call per key; most tokens first."""
    out = log.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last_call"))
    return out.orderBy(F.desc("tokens"), *keys)


def breakdown(log: DataFrame) -> DataFrame:
    """One pass for tokens by tool, by server and in total: kind, name, tokens."""
    sets = log.groupingSets([["tool"], ["server"], []], "tool", "server").agg(F.sum("tokens").alias("tokens"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "tool").when(F.col("g") == 2, "server").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("tool", "server", F.lit("")).alias("name"), "tokens").orderBy("kind", F.desc("tokens"), "name")


def top(log: DataFrame, key: str, n: int) -> DataFrame:
    return log.groupBy(key).agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), key).limit(n)


def top_one(log: DataFrame, key: str) -> DataFrame:
    """The key with most tokens; of equals the first by name."""
    sums = log.groupBy(key).agg(F.sum("tokens").alias("tokens"))
    best = sums.agg(F.min_by(F.struct(key, "tokens"), F.struct(-F.col("tokens"), F.col(key))).alias("b"))
    return best.select("b.*")


def totals_text(log: DataFrame, key: str) -> DataFrame:
    """Totals of all keys as one text, ordered by key: ``a=1,b=2``. The keys are few: servers or tools."""
    sums = log.groupBy(key).agg(F.sum("tokens").alias("tokens"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(key, "tokens"))), lambda x: F.concat(x[key], F.lit("="), x["tokens"].cast("string")))
    return sums.agg(F.array_join(parts, ",").alias("totals"), F.sum("tokens").alias("grand_total"))


def prompt_hashes(log: DataFrame, request, response) -> DataFrame:
    """Tokens per prompt hash. count is 1 by definition of the model; calls counts the rows."""
    digest = F.sha2(F.concat(F.coalesce(request, F.lit("")), F.lit("|"), F.coalesce(response, F.lit(""))), 256)
    return log.groupBy(digest.alias("hash")).agg(F.sum("tokens").alias("tokens"), F.lit(1).alias("count"), F.count(F.lit(1)).alias("calls"))


def spend(log: DataFrame, unit: str) -> DataFrame:
    """Tokens and calls per calendar unit (UTC)."""
    return log.groupBy(F.date_trunc(unit, F.col("ts").cast("timestamp_ntz")).alias("period")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def export_rows(log: DataFrame) -> DataFrame:
    """Rows of the CSV export: RFC 3339 time, empty team and project, cost with six digits."""
    return log.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("").alias("team"),
        F.lit("").alias("project"),
        "server",
        "tool",
        "tokens",
        F.format_string("%.6f", F.col("tokens") * F.lit(EXPORT_COST_PER_TOKEN)).alias("estimated_cost"),
    )


def write_csv(log: DataFrame, path: str) -> None:
    export_rows(log).write.mode("overwrite").option("header", True).csv(path)


def write_json(log: DataFrame, path: str) -> None:
    """One JSON object per line, with the cost unrounded."""
    export_rows(log).withColumn("estimated_cost", F.col("tokens") * F.lit(EXPORT_COST_PER_TOKEN)).write.mode("overwrite").json(path)


def dashboard(log: DataFrame) -> DataFrame:
    """One row: totals, numbers of tools and servers, and the top of each, in one pass over the log."""
    sets = log.groupingSets([["tool"], ["server"], []], "tool", "server").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("g"))
    of = lambda g, value: F.when(F.col("g") == g, value)
    top = lambda g, name: F.min_by(F.struct(F.col(name).alias("name"), "tokens"), of(g, F.struct(-F.col("tokens"), F.col(name))))
    one = sets.agg(
        F.max(of(3, F.col("tokens"))).alias("total_tokens"),
        F.coalesce(F.max(of(3, F.col("calls"))), F.lit(0)).alias("calls"),
        F.count(of(1, F.col("tool"))).alias("tools"),
        F.count(of(2, F.col("server"))).alias("servers"),
        top(1, "tool").alias("t"),
        top(2, "server").alias("s"),
    )
    return one.select("total_tokens", "calls", "tools", "servers", *[F.col(f"{c[0]}.{x}").alias(f"top_{c}{y}") for c in ("tool", "server") for x, y in (("name", ""), ("tokens", "_tokens"))])


def error_rate(log: DataFrame, is_error) -> DataFrame:
    """Errors per hundred calls of each server, 0 where there are none."""
    out = log.groupBy("server").agg(F.count_if(is_error).alias("errors"), F.count(F.lit(1)).alias("calls"))
    return out.withColumn("error_rate", F.round(F.coalesce(F.try_divide(F.col("errors") * 100.0, F.col("calls")), F.lit(0.0)), 6))


def latency_totals(log: DataFrame, ok, latency) -> DataFrame:
    """Successes, failures and mean latency per server, and of all in the row whose server is null."""
    return log.rollup("server").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.avg(latency), 6).alias("avg_latency"))
