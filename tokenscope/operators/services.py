"""Program settings, running status, cache writes, manifests, usage and reports, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenscope.functions import jsontext, render, scalars

#: Where each program keeps its servers in its settings file (fixed values).
PROGRAMS = {"claude": "mcpServers", "cursor": "mcp_servers", "generic": "mcp_servers", "vscode": "mcpExtensions"}
#: Kinds of security events that a report counts (fixed values).
RISKS = ("api_key", "secret", "pii", "custom_pattern")
_SERVER = "struct<command:string,args:array<string>,env:array<string>>"
_STATUS = (
    "pid int, started_at timestamp, listen_addr string, servers array<struct<name:string,status:string,request_count:bigint,error_count:bigint,tool_count:int,uptime:string>>, "
    "cost_tracking struct<by_tool:map<string,bigint>,by_server:map<string,bigint>,total:bigint,enabled:boolean>"
)


def folder_of(path: Column) -> Column:
    """The folder of a command's path; a dot for a bare name or none."""
    return F.when(~F.contains(path, F.lit("/")), ".").otherwise(F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*?)/+[^/]*$", 1), F.lit("")), F.lit("/")))


def discovered_servers(files: DataFrame) -> DataFrame:
    """Servers in programs' settings files (source, text): name, source, transport, command, args, env, cwd. What is no JSON, or an unknown program's, gives none."""
    maps = F.lit(None).cast(f"map<string,{_SERVER}>")
    for program, key in PROGRAMS.items():
        maps = F.when(F.col("source") == program, F.from_json("text", f"{key} map<string,{_SERVER}>")[key]).otherwise(maps)
    rows = files.select(*[c for c in files.columns if c != "text"], F.explode(maps).alias("name", "_s"))
    command = F.coalesce("_s.command", F.lit(""))
    return rows.select(*[c for c in rows.columns if c != "_s"], F.lit("stdio").alias("transport"), command.alias("command"), F.col("_s.args").alias("args"), F.col("_s.env").alias("env"), folder_of(command).alias("cwd"))


def status_rows(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per server of status files, with its health; other columns of files are kept, what is no JSON gives none."""
    info = files.withColumn("_i", F.from_json(text, _STATUS))
    rows = info.select(*[c for c in files.columns if c != text], F.col("_i.pid").alias("pid"), F.inline("_i.servers"))
    health = F.when(F.col("status").isin("running", "error", "stopped"), F.col("status")).otherwise("unresponsive")
    return rows.withColumn("status", health)


def seconds_of(duration: Column) -> Column:
    """Seconds of a duration like 1h2m3.5s, 250ms or 90s; 0 for null and what is none."""
    part = lambda unit: F.coalesce(F.regexp_extract(duration, rf"([0-9.]+){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    total = part("h") * 3600 + part("m") * 60 + part("s") + part("ms") / 1e3 + part("(?:us|µs)") / 1e6 + part("ns") / 1e9
    return F.when(duration.rlike(r"^-?([0-9]+(\.[0-9]*)?(h|m|s|ms|us|µs|ns))+$"), F.when(duration.startswith("-"), -total).otherwise(total)).otherwise(0.0)


def error_rate(errors: Column, requests: Column) -> Column:
    """Percent of requests that failed; 0 without requests."""
    return F.coalesce(F.try_divide(F.coalesce(errors, F.lit(0)) * 100.0, F.coalesce(requests, F.lit(0))), F.lit(0.0))


def status_rates(files: DataFrame, text: str = "text") -> DataFrame:
    """status_rows with error_rate in percent and uptime_seconds."""
    return status_rows(files, text).withColumns({"error_rate": error_rate(F.col("error_count"), F.col("request_count")), "uptime_seconds": seconds_of(F.col("uptime"))})


def status_costs(files: DataFrame, text: str = "text") -> DataFrame:
    """kind (tool or server), name and tokens of the costs in status files, where tracking is on."""
    cost = files.select(*[c for c in files.columns if c != text], F.from_json(text, _STATUS)["cost_tracking"].alias("_c")).where("_c.enabled")
    rest = [c for c in cost.columns if c != "_c"]
    of = lambda kind: cost.select(*rest, F.lit(kind).alias("kind"), F.explode(f"_c.by_{kind}").alias("name", "tokens"))
    return of("tool").unionByName(of("server"))


def cache_key(tool: Column, prompt: Column) -> Column:
    """Entries of different tools never share a key."""
    return F.sha2(F.concat(tool, F.lit("\0"), prompt), 256)


def cache_store(writes: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    """What a cache holds after writes (tool, prompt, response, stored_at, seq): the last one of each key, no empty responses, nothing older than the time to live.

    The last write is found before age counts, and before the shuffle, so that an old prompt that is written again is one entry.
    """
    good = writes.where(F.octet_length("response") > 0).withColumn("key", cache_key(F.col("tool"), F.col("prompt")))
    last = good.groupBy("key").agg(F.max_by(F.struct("tool", "response", "stored_at"), "seq").alias("e")).select("key", "e.*")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("stored_at").cast("timestamp"))
    return last.withColumn("expired", age > ttl_seconds * 1_000_000)


def manifest_key(server: Column, tools: Column) -> Column:
    """Key of a server's compacted manifest: of its name and of the whole manifest as JSON."""
    return F.sha2(F.concat(server, F.lower(F.hex(F.to_json(F.struct(server.alias("name"), tools.alias("tools")))))), 256)


def compacted(manifests: DataFrame) -> DataFrame:
    """Manifests (server, tools: array of name, description, parameters) with descriptions of 50 bytes at most, their key, and the percentage of tokens saved; those without tools are left out."""
    small = F.transform("tools", lambda t: F.struct(t["name"].alias("name"), render.compact_description(t["description"]).alias("description"), t["parameters"].alias("parameters")))
    rows = manifests.where(F.size("tools") > 0).select("server", manifest_key(F.col("server"), F.col("tools")).alias("key"), F.to_json("tools").alias("before"), F.to_json(small).alias("distilled"))
    a, b = (F.floor(F.octet_length(c) / 4) for c in ("before", "distilled"))
    return rows.select("server", "key", "distilled", F.round(F.coalesce(F.try_divide((a - b) * 100, a), F.lit(0.0)), 6).alias("reduction_percent"))


def estimate_json(text: Column, chars_per_token: float = 4.0) -> Column:
    """Tokens of a JSON value written compactly with sorted keys; 0 for what is no JSON, and for null."""
    return scalars.estimate_tokens(jsontext.column_of(jsontext.compact, text), chars_per_token)


def response_usage(text: Column) -> Column:
    """(kind, tokens) of a model response's prompt-cache use: hit with the tokens read, miss if something was written, else null."""
    tokens = lambda name: F.coalesce(F.get_json_object(text, f"$.usage.{name}").try_cast("long"), F.lit(0))
    read, written = tokens("cache_read_input_tokens"), tokens("cache_creation_input_tokens")
    of = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.alias("tokens"))
    return F.when(read > 0, of("hit", read)).when(written > 0, of("miss", F.lit(0).cast("long")))


def session_report(sessions: DataFrame) -> DataFrame:
    """session and report: the head of a session's report in Markdown; sessions have session, requests, original, saved, risks."""
    percent = F.coalesce(F.try_divide(F.col("saved") * 100.0, F.col("original")), F.lit(0.0))
    name = F.when(F.coalesce("session", F.lit("")) == "", "N/A").otherwise(render.markdown_cell(F.col("session")))
    lines = [
        F.lit("# Session Report\n\n## Summary\n\n| Metric | Value |\n|--------|-------|"),
        F.format_string("| Session ID | `%s` |", name),
        F.format_string("| Total Requests | `%d` |", "requests"),
        # half to even on the number's exact value, as C and Go print it; %.2f would round its shortest decimals half up
        F.format_string("| **Total Tokens Saved** | **%d (%s%%)** |", F.col("saved"), F.call_function("format_number", percent, F.lit("0.00"))),
        F.format_string("| Security Risks Intercepted | `%d` |", "risks"),
    ]
    return sessions.select("session", F.concat_ws("\n", *lines).alias("report"))


def session_json(use: DataFrame, events: DataFrame) -> DataFrame:
    """session and body: the session's report as JSON with its savings in all and by server, and its security events by kind.

    use has session, server, original and saved; events has session and kind. Both are summed before they are joined, so a report
    holds a session's few servers and no rows. Sessions without use have no report; kinds that are not in RISKS count in all only.
    """
    percent = lambda saved, original: F.round(F.coalesce(F.try_divide(saved * 100.0, original), F.lit(0.0)), 2)
    server = use.groupBy("session", "server").agg(F.count(F.lit(1)).alias("requests"), F.sum("original").alias("original"), F.sum("saved").alias("saved"))
    row = F.struct("server", F.col("original").alias("original_tokens"), (F.col("original") - F.col("saved")).alias("optimized_tokens"), F.col("saved").alias("saved_tokens"), percent(F.col("saved"), F.col("original")).alias("savings_percentage"))
    whole = server.groupBy("session").agg(*[F.sum(c).alias(c) for c in ("requests", "original", "saved")], F.array_sort(F.collect_list(row)).alias("by_server"))
    found = events.groupBy("session").agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in RISKS])
    number = lambda c: F.coalesce(c, F.lit(0))
    both = whole.join(found.withColumnRenamed("session", "_session"), F.col("session").eqNullSafe(F.col("_session")), "left")
    summary = F.struct(F.col("requests").alias("total_requests"), F.col("saved").alias("total_tokens_saved"), percent(F.col("saved"), F.col("original")).alias("savings_percentage"), number("_all").alias("security_risks_intercepted"))
    body = F.struct(F.coalesce("session", F.lit("")).alias("session_id"), summary.alias("summary"), F.col("by_server").alias("token_savings"), F.struct(*[number(f"_{k}").alias(k) for k in RISKS]).alias("risk_summary"))
    return both.select("session", F.to_json(body).alias("body"))


def changes(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and event: added, removed or changed, of two states of a table; what is the same gives no event."""
    digest = F.xxhash64(*[F.to_json(F.struct(*columns))])
    a, b = before.select(key, digest.alias("_a")), after.select(key, digest.alias("_b"))
    event = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, event.alias("event")).where("event is not null")


def dashboard_json(log: DataFrame, now: Column) -> DataFrame:
    """One row, body: the dashboard's JSON with the tokens of each server and tool, most first, and those of now's day, its week (from Monday) and all.

    One pass over the log; servers and tools are few.
    """
    within = lambda unit: F.when((F.col("ts") >= F.date_trunc(unit, now)) & (F.col("ts") <= now), F.col("tokens"))
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in ((F.col("tokens"), "tokens"), (within("day"), "day"), (within("week"), "week"))]
    sets = log.groupingSets([["tool"], ["server"], []], "tool", "server").agg(*sums, F.grouping_id().alias("g"))
    ranked = lambda g, name: F.array_sort(F.filter(F.collect_list(F.when(F.col("g") == g, F.struct((-F.col("tokens")).alias("minus"), F.col(name).alias("name")))), lambda x: x.isNotNull()))
    whole = lambda c: F.coalesce(F.max(F.when(F.col("g") == 3, F.col(c))), F.lit(0)).alias(c)
    one = sets.agg(ranked(1, "tool").alias("t"), ranked(2, "server").alias("s"), *map(whole, ("tokens", "day", "week")))
    entries = lambda c, name: F.transform(c, lambda x: F.struct(x["name"].alias(name), (-x["minus"]).alias("tokens")))
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0))["name"], F.lit(""))
    body = F.struct(
        entries("s", "server").alias("per_server"), entries("t", "tool").alias("per_tool"), F.size("s").alias("server_count"), F.col("day").alias("today_spend"), F.size("t").alias("tool_count"),
        first("s").alias("top_server"), first("t").alias("top_tool"), F.col("tokens").alias("total_spend"), F.col("week").alias("wtd_spend"),
    )
    return one.select(F.to_json(body).alias("body"))


def with_trust(servers: DataFrame, scores: DataFrame, key: str, least: int = 40) -> DataFrame:
    """servers with the trust score of each and whether it is low; one without a score has none and is not low."""
    return servers.join(scores.select(key, "score"), key, "left").withColumn("low_trust", F.coalesce(F.col("score") < least, F.lit(False)))


class BoundedQueue:
    """A queue of at most most waiting items, served one after the other in seconds each; an item that waited over timeout is given up when its turn comes, which takes no time."""

    def __init__(self, most: int = 100, seconds: float = 1.0, timeout: float = 30.0) -> None:
        self.most, self.seconds, self.timeout, self.starts, self.free = most, seconds, timeout, [], 0.0

    def step(self, ts: float) -> str:
        self.starts = [t for t in self.starts if t > ts]
        if len(self.starts) >= self.most:
            return "full"
        start = max(ts, self.free)
        self.starts.append(start)
        if start - ts > self.timeout:
            return "timeout"
        self.free = start + self.seconds
        return "done"


class MicroBatcher:
    """Numbers of batches: one takes most items at most and closes wait seconds after its first."""

    def __init__(self, most: int = 10, wait: float = 1.0) -> None:
        self.most, self.wait, self.batch, self.opened, self.size = most, wait, 0, 0.0, 0

    def step(self, ts: float) -> str:
        if self.batch == 0 or self.size >= self.most or ts - self.opened > self.wait:
            self.batch, self.opened, self.size = self.batch + 1, ts, 0
        self.size += 1
        return str(self.batch)
