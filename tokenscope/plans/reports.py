"""Report queries: sessions, previews, texts, federation, counters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tokenscope.functions import render, scalars
from tokenscope.operators import catalog
from tokenscope.plans.catalog import servers, tools
from tokenscope.plans.scalars import savings_by_server
from tokenscope.sources.tables import call_log, table


def percent_texts(s, d):
    """Share of returned lines per hundredth of orders, as text."""
    return table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count(F.lit(1)).alias("m")).select(
        "k", render.percent_text(F.floor(F.col("n") * 1000 / F.col("m")) / 10.0).alias("share")
    )


def durations(s, d):
    sec = F.col("user_id") * F.col("event_id") % 200_000
    return table(s, d, "events").select("event_id", render.duration_text(sec).alias("duration"))


def markdown_rows(s, d):
    """Rows of the report's table of savings, with the percentage of each server."""
    r = savings_by_server(s, d)
    pct = F.round(F.col("saved") * 100 / F.col("original"), 2)
    line = F.concat(F.lit("| "), render.markdown_cell(F.col("server")), *[x for c in ("original", "optimized", "saved") for x in (F.lit(" | "), F.col(c).cast("string"))], F.lit(" |"))
    return r.select("server", line.alias("line"), pct.alias("percent"))


def escaped_cells(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(render.markdown_cell(F.col("text")), 256).alias("cell"))


def file_names(s, d):
    return table(s, d, "pages").select("page_id", render.file_name(F.col("url")).alias("name"))


def risk_summary(s, d):
    """Counts per kind of security event, one column each."""
    kinds = ("api_key", "secret", "pii", "custom_pattern")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 7 % 4 + 1).cast("int"))
    return table(s, d, "events").withColumn("kind", kind).groupBy("event_type").pivot("kind", list(kinds)).count().fillna(0)


def cost_previews(s, d):
    n = F.when(F.col("server") % 9 == 0, F.lit(2)).otherwise(F.lit(35) + F.col("server") % 5)
    return servers(s, d).select("server", render.cost_preview(F.col("name"), F.col("transport"), n.cast("long")).alias("preview"))


def estimated_tools(s, d):
    return table(s, d, "documents").select("doc_id", render.estimated_tools(F.col("text")).alias("tools"))


def parsed_dates(s, d):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(day, "MMM d, yyyy")).otherwise("soon")
    return table(s, d, "orders").select("o_orderkey", render.parse_date(text).cast("timestamp_ntz").alias("parsed"))


def sensitive_fields(s, d):
    m = F.when(F.col("event_id") % 3 == 0, "tools/call").when(F.col("event_id") % 3 == 1, "resources/read").otherwise(F.col("event_type"))
    return table(s, d, "events").select(F.array_join(render.sensitive_fields(m), ",").alias("fields")).groupBy("fields").agg(F.count(F.lit(1)).alias("n"))


def env_lists(s, d):
    env = F.create_map(F.lit("b"), F.col("s_name"), F.lit("a"), F.col("s_suppkey").cast("string"))
    return table(s, d, "supplier").select("s_suppkey", F.array_join(render.env_list(env), ";").alias("env"))


def tool_stubs(s, d):
    """Tools without their schemas, with descriptions of at most 50 bytes and whether they fit a signature."""
    t = tools(s, d)
    name = F.concat(F.lit("srv"), F.col("server").cast("string"), F.lit("_"), F.col("tool"))
    long = F.repeat(F.col("description"), 5)
    return t.select("p_partkey", name.alias("name"), render.compact_description(long).alias("description"), F.lit("{}").alias("schema"), render.fits_signature(name, F.repeat(long, 5)).alias("fits"))


def split_names(s, d):
    """server_tool parted at the first underscore, namespace.tool at the first dot; without a dot both are the whole."""
    n = F.concat("namespace", F.lit("."), "tool")
    return tools(s, d).select("p_partkey", F.substring_index("tool", "_", 1).alias("server"), F.regexp_extract("tool", "^[^_]*_(.*)$", 1).alias("rest"), F.substring_index(n, ".", 1).alias("namespace"), F.regexp_extract(n, r"^[^.]*\.(.*)$", 1).alias("name"))


def federation_routes(s, d):
    """The online peer that serves each tool: the indexed one, or, if it is offline, the next online one in turn."""
    peers = table(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("peer"), (F.col("n_nationkey") % 4 != 0).alias("online"))
    asked = tools(s, d).select("p_partkey", (F.col("p_partkey") % 25).cast("int").alias("start"))
    return catalog.failover(asked, peers)


def peer_index(s, d):
    """namespace@peer names parted at the last @; the last writer of a tool wins."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("a@b"), (k % 300).cast("string"), F.lit("@"), F.lit("peer"), (k % 7).cast("string"))
    rows = table(s, d, "part").select(k.alias("seq"), F.regexp_extract(name, "^(.*)@([^@]*)$", 1).alias("tool"), F.regexp_extract(name, "^(.*)@([^@]*)$", 2).alias("peer"))
    return rows.groupBy("tool").agg(F.max_by("peer", "seq").alias("peer"))


def limiter_counters(s, d):
    """Per server: calls, those over 60 tokens as refused, and the sum and mean wait, in tokens, of the rest."""
    log, over = call_log(s, d), F.col("tokens") > 60
    out = log.groupBy("server").agg(F.count(F.lit(1)).alias("submitted"), F.count_if(over).alias("rejected"), F.sum(F.when(~over, F.col("tokens"))).alias("waited"), F.count_if(~over).alias("completed"))
    return out.withColumn("mean_wait", F.round(F.try_divide("waited", "completed"), 6))


def lazy_cache_stats(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.agg(F.count(F.lit(1)).alias("cached"), F.count_if(F.col("last") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).alias("expired"))


def manifest_reduction(s, d):
    """Percent of floor(bytes / 4) tokens that the first half of a turn saves."""
    t = table(s, d, "conversations")
    a, b = scalars.floor_tokens(F.col("text")), scalars.floor_tokens(F.expr("substring(text, 1, cast(length(text) / 2 as int))"))
    return t.select("conv_id", "turn", a.alias("before"), b.alias("after"), F.round(F.coalesce(F.try_divide((a - b) * 100, a), F.lit(0.0)), 6).alias("percent"))


def schema_lookup(s, d):
    """A tool's schema from the cache, else from the server, else none."""
    t = tools(s, d).select("p_partkey", "tool")
    cache = t.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("cached:"), "tool").alias("c"))
    origin = t.where("p_partkey % 5 <> 0").select("p_partkey", F.concat(F.lit("fetched:"), "tool").alias("o"))
    return t.join(cache, "p_partkey", "left").join(origin, "p_partkey", "left").select("p_partkey", F.coalesce("c", "o").alias("schema"))


def description_limits(s, d):
    n = (F.col("p_size") * 13).cast("int")
    return table(s, d, "part").where(~render.valid_description_chars(n)).select("p_partkey", n.alias("max_description_chars"))


def latest_turns(s, d):
    """The last turn of each conversation, as a dedup by key keeps it."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(s, d, "conversations").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conv_id", "turn", "role")


QUERIES = {
    f.__name__: f
    for f in (
        percent_texts, durations, markdown_rows, escaped_cells, file_names, risk_summary, cost_previews, estimated_tools, parsed_dates, sensitive_fields, env_lists, tool_stubs, split_names, federation_routes,
        peer_index, limiter_counters, lazy_cache_stats, manifest_reduction, schema_lookup, description_limits, latest_turns,
    )
}

_TOOLS = "(select p_partkey, 'tool_' || cast(p_partkey % 700 as varchar) as tool, lower(p_brand) as namespace, p_partkey * 7 % 120 + 1 as server, p_name as description from part)"
_LOG = "(select 'srv_' || cast(user_id % 8 as varchar) as server, cast(floor(value) as bigint) as tokens from events)"
_EST = "cast(ceil(strlen({0}) / 4.0) as bigint)"

SQL = {
    "cost_previews": """with t as (select s_suppkey as server, s_name as name, case when s_suppkey % 3 = 0 then 'http' else 'stdio' end as transport, case when s_suppkey % 9 = 0 then 2 else 35 + s_suppkey % 5 end as n from supplier),
 u as (select *, n * 75 as native, greatest(0, n * 75 - 158) as saved, greatest(0, n * 75 - 158) / (n * 75)::double * 100 as p from t)
 select server, case when saved > 0 then name || ' (' || transport || ', ~' || n || ' tools): ~' || native || ' native against 158 routed tokens (saves ~' || saved || ' / '
 || case when p - floor(p) < 0.05 then cast(cast(floor(p) as bigint) as varchar) else printf('%.1f', p) end || '%)' else name || ' (' || transport || '): ~' || native || ' native against 158 routed tokens (no savings)' end as preview from u""",
    "percent_texts": """with t as (select l_orderkey % 100 as k, floor(count(*) filter (l_returnflag = 'R') * 1000::double / count(*)) / 10.0::double as p from lineitem group by 1)
 select k, case when p <= 0 then '0' when p - floor(p) < 0.05 then cast(cast(floor(p) as bigint) as varchar) else printf('%.1f', p) end as share from t""",
    "durations": """with t as (select event_id, user_id * event_id % 200000 as s from events) select event_id, case when s >= 86400 then (s // 86400) || 'd' || (s // 3600 % 24) || 'h'
 when s >= 3600 then (s // 3600) || 'h' || (s // 60 % 60) || 'm' when s >= 60 then (s // 60) || 'm' || (s % 60) || 's' else s || 's' end as duration from t""",
    "markdown_rows": f"""with t as (select 'srv_' || cast(conv_id % 8 as varchar) as server, {_EST.format('text')} as original, least({_EST.format('substr(text, 1, 120)')}, {_EST.format('text')}) as optimized from conversations),
 u as (select server, cast(sum(original) as bigint) as o, cast(sum(optimized) as bigint) as p from t group by server)
 select server, '| ' || server || ' | ' || o || ' | ' || p || ' | ' || (o - p) || ' |' as line, round((o - p) * 100::double / o, 2) as percent from u""",
    "escaped_cells": r"select doc_id, sha256(replace(replace(text, '|', '\|'), '`', '\`')) as cell from documents",
    "file_names": "select page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') as name from pages",
    "risk_summary": """select event_type, count(*) filter (event_id % 7 % 4 = 0) as api_key, count(*) filter (event_id % 7 % 4 = 1) as secret, count(*) filter (event_id % 7 % 4 = 2) as pii,
 count(*) filter (event_id % 7 % 4 = 3) as custom_pattern from events group by 1""",
    "estimated_tools": "select doc_id, cast(greatest(35, strlen(text) // 1024 * 40) as bigint) as tools from documents",
    "parsed_dates": """select o_orderkey, case o_orderkey % 4 when 0 then date_trunc('day', o_orderdate)::timestamp when 1 then date_trunc('second', o_orderdate) when 2 then date_trunc('day', o_orderdate)::timestamp end as parsed from orders""",
    "sensitive_fields": "select case event_id % 3 when 0 then 'arguments,input' when 1 then 'uri,contents' else 'payload' end as fields, count(*) as n from events group by 1",
    "env_lists": "select s_suppkey, 'a=' || cast(s_suppkey as varchar) || ';b=' || s_name as env from supplier",
    "tool_stubs": f"""with t as (select *, repeat(description, 5) as long, 'srv' || cast(server as varchar) || '_' || tool as name from {_TOOLS})
 select p_partkey, name, case when length(long) > 50 then substr(long, 1, 47) || '...' else long end as description, '{{}}' as schema, length(name) + length(long) * 5 + 27 <= 500 as fits from t""",
    "split_names": f"select p_partkey, 'tool' as server, substr(tool, 6) as rest, namespace, tool as name from {_TOOLS}",
    "federation_routes": """select p_partkey, min_by(n_name, (n_nationkey - p_partkey % 25 + 25) % 25) as peer from part, nation where n_nationkey % 4 <> 0 group by p_partkey""",
    "peer_index": "select 'a@b' || cast(p_partkey % 300 as varchar) as tool, max_by('peer' || cast(p_partkey % 7 as varchar), p_partkey) as peer from part group by 1",
    "limiter_counters": f"""select server, count(*) as submitted, count(*) filter (tokens > 60) as rejected, cast(sum(tokens) filter (tokens <= 60) as bigint) as waited,
 count(*) filter (tokens <= 60) as completed, round(sum(tokens) filter (tokens <= 60) / nullif(count(*) filter (tokens <= 60), 0)::double, 6) as mean_wait from {_LOG} group by server""",
    "lazy_cache_stats": "select count(*) as cached, count(*) filter (last < timestamp '2024-01-25') as expired from (select user_id, max(ts) as last from events group by 1)",
    "manifest_reduction": """select *, round(coalesce((before - after) * 100 / nullif(before, 0)::double, 0), 6) as percent from (select conv_id, turn, cast(strlen(text) // 4 as bigint) as before,
 cast(strlen(substr(text, 1, length(text) // 2)) // 4 as bigint) as after from conversations)""",
    "schema_lookup": f"select p_partkey, case when p_partkey % 3 = 0 then 'cached:' || tool when p_partkey % 5 <> 0 then 'fetched:' || tool end as schema from {_TOOLS}",
    "description_limits": "select p_partkey, p_size * 13 as max_description_chars from part where not (p_size = 0 or p_size * 13 between 50 and 500)",
    "latest_turns": "select conv_id, max(turn) as turn, max_by(role, turn) as role from conversations group by conv_id",
}
