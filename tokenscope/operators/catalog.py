"""Joins, searches and set operations over tool and server catalogues."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def left_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Every parent with its number of children, 0 included; children are counted before the join."""
    return parents.join(children.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").fillna(0, [name])


def route(methods: DataFrame, tools: DataFrame) -> DataFrame:
    """status and server per method ``namespace.tool``: invalid (no dot, or over 100 characters), not_found, ambiguous, or ok."""
    known = tools.groupBy(F.concat("namespace", F.lit("."), "tool").alias("method")).agg(F.min("server").alias("server"), F.count_distinct("server").alias("n"))
    bad = (F.length("method") > 100) | ~F.contains(F.col("method"), F.lit("."))
    status = F.when(bad, "invalid").when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return methods.join(known, "method", "left").select("event_id", "method", status.alias("status"), F.when(F.col("n") == 1, F.col("server")).alias("server"))


def resolve(asked: DataFrame, tools: DataFrame) -> DataFrame:
    """The tool of the server whose name is the asked one, or ends with it behind a dot; the first by name."""
    fits = (F.col("tool") == F.col("asked")) | F.endswith(F.col("tool"), F.concat(F.lit("."), "asked"))
    return asked.join(tools, "server").where(fits).groupBy("server", "asked").agg(F.min("tool").alias("tool"))


def first_of(cases: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first condition that holds: a lookup in a small ordered table that keeps every row, without join or grouping."""
    return F.coalesce(*[F.when(fits, F.lit(value)) for fits, value in cases], F.lit(default))


def match_hosts(urls: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Provider of a URL's host, for every row: of the (provider, host) patterns the first that is the host or a parent domain of it, else other."""
    rows = urls.select("page_id", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))).alias("host"))
    fits = lambda p: (F.col("host") == p) | F.endswith(F.col("host"), F.lit(f".{p}"))
    return rows.withColumn("provider", first_of([(fits(p), provider) for provider, p in patterns], "other"))


def failover(asked: DataFrame, peers: DataFrame) -> DataFrame:
    """asked with the peer that serves from its start: the peer at that position if it is online, else the next online one in turn, around the end.

    The table from position to serving peer is made once, of the peers alone, and joined by an equal position.
    """
    around = Window.orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    first = F.first("live", ignorenulls=True)
    live = peers.withColumn("live", F.when(F.col("online"), F.col("peer")))
    serving = live.select(F.col("pos").alias("start"), F.coalesce(first.over(around), first.over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("peer"))
    return asked.join(serving, "start").drop("start")


def with_all(servers: DataFrame, wanted: list[str]) -> DataFrame:
    """Servers that have every wanted capability."""
    return servers.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), "capabilities")) == 0)


def best_server(servers: DataFrame, wanted: list[str], max_load: float = 0, transport: str = "", min_health: str = "") -> DataFrame:
    """The server with the highest score among those that fit; of equals the least."""
    fit = with_all(servers, wanted)
    if min_health:
        fit = fit.where(F.col("health").isin(min_health, "healthy"))
    if max_load > 0:
        fit = fit.where(F.col("load") <= max_load)
    if transport:
        fit = fit.where(F.col("transport") == transport)
    score = F.round(1 - F.col("load") + F.when(F.col("health") == "healthy", 0.5).otherwise(0.0) + F.col("requests") * 0.0001, 6)
    return fit.select("server", score.alias("score")).orderBy(F.desc("score"), "server").limit(1)


def flatten(tree: DataFrame) -> DataFrame:
    """full_name, parent, depth, children of every namespace, by a recursive query."""
    nodes = tree.select("full_name", "parent").distinct()
    deep = nodes.sparkSession.sql(
        """with recursive t as (select full_name, parent, 0 as depth from {nodes} where parent is null
        union all select n.full_name, n.parent, t.depth + 1 from {nodes} n join t on n.parent = t.full_name) select * from t""",
        nodes=nodes,
    )
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("full_name")).agg(F.count(F.lit(1)).alias("children"))
    return deep.join(children, "full_name", "left").select("full_name", F.coalesce("parent", F.lit("")).alias("parent"), "depth", F.coalesce("children", F.lit(0)).alias("children"))


def namespace_servers(tree: DataFrame) -> DataFrame:
    own = tree.select("full_name", "server").union(tree.where("parent is not null").select("parent", "server"))
    return own.groupBy("full_name").agg(F.count_distinct("server").alias("servers"))


def nearest(asked: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """The n names nearest to each asked one by edit distance, case folded; equal names are left out, ties go by position. The asked names are few."""
    pairs = names.join(F.broadcast(asked), F.lower("asked") != F.lower("name"))
    pairs = pairs.withColumn("distance", F.levenshtein(F.lower("asked"), F.lower("name")))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "pos"))
    return pairs.withColumn("rn", rank).where(F.col("rn") <= n).select("asked", "name", "distance")


def contains_search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows in which some column holds the query, case folded; an empty query finds all."""
    hit = F.lit(not query)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(query.lower()))
    return rows.where(hit)


def all_words(line: Column, query: str) -> Column:
    hit = F.lit(True)
    for w in query.lower().split():
        hit = hit & F.contains(F.lower(line), F.lit(w))
    return hit


def scored_search(tools: DataFrame, query: str) -> DataFrame:
    """100 for an equal name, 50 for one that holds the query."""
    name, q = F.lower("tool"), query.lower()
    score = F.when(name == q, 100).when(F.contains(name, F.lit(q)), 50)
    return tools.withColumn("score", score).where("score is not null").withColumn("match_on", F.when(F.col("score") == 100, "exact").otherwise("contains"))


# What an error message holds and the action that is advised, in order.
HINTS = (
    ("repository", "check_repo"),
    ("not running", "restart_server"),
    ("not healthy", "restart_server"),
    ("server not available", "check_logs"),
    ("signal: killed", "check_logs"),
    ("command not found", "check_dependencies"),
    ("failed", "retry"),
    ("not authenticated", "check_auth"),
    ("forbidden", "check_permissions"),
    ("not found", "verify_resource"),
    ("rate limited", "wait_retry"),
    ("timeout", "retry"),
    ("invalid params", "check_params"),
    ("connection refused", "check_server"),
    ("tool not found", "list_tools"),
)


def hint(message: Column, table: Sequence[tuple[str, str]] = HINTS) -> Column:
    """The action of the longest pattern that a message holds, case folded, of equals the first; none where there is none.

    The longest, so that "tool not found" is not taken for "not found".
    """
    ranked = sorted(table, key=lambda x: -len(x[0]))
    return first_of([(F.contains(F.lower(message), F.lit(p)), action) for p, action in ranked], "none")


def with_context(message: Column, server: Column, tool: Column) -> Column:
    """A message with the server and tool that it came from, as far as they are known."""
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"\n  {name}: "), c))
    return F.when((server != "") | (tool != ""), F.concat_ws("", message, F.lit("\n\n📋 Context:"), line("Server", server), line("Tool", tool))).otherwise(message)


def override(layers: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key and column the value of the last layer that has one."""
    return layers.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def replace_by_name(rows: DataFrame, name: str, seq: str, value: str) -> DataFrame:
    return rows.groupBy(name).agg(F.min(seq).alias(seq), F.max_by(value, seq).alias(value))


def purge(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def allowed(clients: Column, client: Column) -> Column:
    """An empty list lets all in, else the client or a star must be in it."""
    return (F.size(clients) == 0) | F.array_contains(clients, client) | F.array_contains(clients, "*")


def glob_regex(pattern: str, crosses: bool = True) -> str:
    """A glob as a whole-string expression; with crosses False a star stops at slashes, two stars and a slash are any folders or none."""
    parts = {"*": ".*" if crosses else "[^/]*", "?": "." if crosses else "[^/]", "**": ".*", "**/": "(?:.*/)?"}
    return "^" + "".join(parts.get(c) or re.escape(c) for c in re.findall(r"\*\*/?|.", pattern, re.S)) + "$"


def transport(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(t == "", "stdio").when(t.isin("streamable-http", "streamablehttp"), "http").otherwise(t)


def describe(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ord int, name string, type string, nullable boolean")


def config_error(name: Column, transport: Column, stdio: Column, http: Column) -> Column:
    """(field, message) of the first rule that a server's settings break, else null; stdio has a command, http has a url, and each is null where it isn't set."""
    fault = lambda field, *message: F.struct(F.lit(field).alias("field"), F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]).alias("message"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    url = http["url"]
    remote = (
        F.when(http.isNull(), fault("http", "http configuration is required for ", transport, " transport"))
        .when(blank(url), fault("url", "url is required for http/sse transport"))
        .when(~F.startswith(url, F.lit("http://")) & ~F.startswith(url, F.lit("https://")), fault("url", "invalid URL format: '", url, "'"))
    )
    local = F.when(stdio.isNull(), fault("stdio", "stdio configuration is required for stdio transport")).when(blank(stdio["command"]), fault("command", "command is required for stdio transport"))
    return (
        F.when(blank(name), fault("name", "name is required"))
        .when(blank(transport), fault("transport", "transport type is required"))
        .when(transport == "stdio", local)
        .when(transport.isin("http", "sse"), remote)
        .otherwise(fault("transport", "invalid transport '", transport, "'. Must be stdio, http, or sse"))
    )
