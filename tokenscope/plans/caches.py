"""Queries over caches, layered settings and the tools of many servers, made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tokenscope.operators import caches as op
from tokenscope.operators import layers, state
from tokenscope.plans.cost import LOG
from tokenscope.plans.stateful import _log
from tokenscope.sources import fanout, sinks
from tokenscope.sources.tables import table

CACHE_MOST, CACHE_SECONDS, SESSION_MOST, SESSION_SECONDS = 6, 100_000.0, 5, 50_000.0


def schema_cache_events(s, d):
    """Each server's schema cache: of ten calls one deletes, four set, five get the schema of a user."""
    kind = F.when(F.col("event_id") % 10 == 0, "delete").when(F.col("event_id") % 10 < 5, "set").otherwise("get")
    rows = _log(s, d).join(table(s, d, "events").select("event_id", "user_id"), "event_id").withColumn("kind", kind)
    return state.replay(rows, "server", ["ts", "event_id"], lambda k: op.AgedCache(CACHE_MOST, CACHE_SECONDS), ["t", "kind", "user_id"], ["event_id", "server"], "event_id long, server string")


def session_reuse(s, d):
    """Each tool's sessions with the users' servers."""
    rows = _log(s, d).join(table(s, d, "events").select("event_id", "user_id"), "event_id")
    return state.replay(rows, "tool", ["ts", "event_id"], lambda k: op.SessionReuse(SESSION_MOST, SESSION_SECONDS), ["t", "user_id"], ["event_id", "tool"], "event_id long, tool string")


def layered_settings(s, d):
    """Each nation's settings from its customers as layers, with gaps at each level."""
    k = F.col("c_custkey")
    some = lambda n, value, gap: F.when(k % n == 0, value).otherwise(gap)
    meta = F.struct(some(6, F.col("c_mktsegment"), F.lit("")).alias("source"), k.alias("version"))
    limits = F.struct(some(5, k, F.lit(0)).alias("max_connections"), some(7, k * 2, F.lit(None)).alias("timeout_seconds"), meta.alias("meta"))
    auth = F.struct(some(4, F.col("c_name"), F.lit("")).alias("token"), some(9, F.array("c_mktsegment", "c_name"), F.array().cast("array<string>")).alias("scopes"))
    rows = table(s, d, "customer").select(
        "c_nationkey", "c_custkey", some(3, F.col("c_name"), F.lit("")).alias("name"), some(8, F.array("c_name"), F.array().cast("array<string>")).alias("servers"),
        F.when((k % 2 == 0) & (F.col("c_nationkey") % 5 != 0), limits).alias("limits"), F.when(k % 3 != 0, auth).alias("auth"),
    )
    out = layers.override(rows, "c_nationkey", "c_custkey")
    return out.select(
        "c_nationkey", "name", F.array_join("servers", ",").alias("servers"), F.col("limits").isNotNull().alias("limited"), "limits.max_connections", "limits.timeout_seconds",
        F.col("limits.meta.source").alias("meta_source"), F.col("limits.meta.version").alias("meta_version"), F.col("auth.token").alias("token"), F.array_join("auth.scopes", ",").alias("scopes"),
    )


def tool_list_fanout(s, d):
    """Suppliers as servers, whose manifests list the parts of their number; every 10th manifest is cut short, every 7th server has none."""
    folder = f"{sinks.shared_folder(s, 'ts_manifests_')}/manifests-{uuid.uuid4().hex}"
    suppliers = table(s, d, "supplier").select(F.col("s_suppkey").alias("server"))
    tool = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.struct(F.col("p_size").alias("n")).alias("inputSchema"))
    found = table(s, d, "part").join(suppliers.agg(F.count(F.lit(1)).alias("n")).hint("broadcast"), F.col("n") > 0).select((F.col("p_partkey") % F.col("n") + 1).alias("server"), tool.alias("tool"))
    texts = found.groupBy("server").agg(F.to_json(F.struct(F.collect_list("tool").alias("tools"))).alias("text"))
    cut = F.when(F.col("server") % 10 == 0, F.expr("left(text, length(text) - 2)")).otherwise(F.col("text"))
    fanout.write_manifests(texts.where("server % 7 <> 0").select("server", cut.alias("text")), folder)
    tools = fanout.ask_servers(suppliers.select("server", F.concat(F.lit(f"{folder}/server="), F.col("server").cast("string")).alias("address")))
    return tools.groupBy("server").agg(F.count("tool").alias("tools"), F.min("tool").alias("first"), F.max("description").alias("last"), F.min("input_schema").alias("least"), F.max("error").alias("error"))


QUERIES = {f.__name__: f for f in (schema_cache_events, session_reuse, layered_settings, tool_list_fanout)}

_ROWS = lambda key: f"""select l.event_id, l.{key} as g, epoch_us(l.ts) / 1e6 as t, e.user_id as k, case when l.event_id % 10 = 0 then 'delete' when l.event_id % 10 < 5 then 'set' else 'get' end as kind,
 row_number() over (partition by l.{key} order by l.ts, l.event_id) as rn from {LOG} l join events e on e.event_id = l.event_id"""  # noqa: E731

SQL = {
    # an entry: k, created; the list goes from the least to the most recent
    "schema_cache_events": f"""with recursive log as materialized ({_ROWS("server")}),
 st as (select distinct g, 0::bigint as rn, null::bigint as event_id, []::struct(k bigint, c double)[] as held, '' as decision from log union all
 select g, rn, event_id, case decision when 'miss' then held when 'absent' then held when 'expired' then rest when 'deleted' then rest when 'hit' then list_append(rest, own)
 when 'update' then list_append(rest, {{'k': k, 'c': t}}) when 'insert_evict' then list_append(held[2:], {{'k': k, 'c': t}}) else list_append(held, {{'k': k, 'c': t}}) end, decision
 from (select *, case kind when 'get' then case when own is null then 'miss' when t - own.c > {CACHE_SECONDS} then 'expired' else 'hit' end when 'delete' then case when own is null then 'absent' else 'deleted' end
 else case when own is not null then 'update' when len(held) >= {CACHE_MOST} then 'insert_evict' else 'insert' end end as decision
 from (select log.*, st.held, list_filter(st.held, lambda x: x.k = log.k)[1] as own, list_filter(st.held, lambda x: x.k <> log.k) as rest from st join log on log.g = st.g and log.rn = st.rn + 1)))
 select event_id, g as server, decision from st where rn > 0""",
    # a session: u (last use), k; the least is the one not used for longest
    "session_reuse": f"""with recursive log as materialized ({_ROWS("tool")}),
 st as (select distinct g, 0::bigint as rn, null::bigint as event_id, []::struct(u double, k bigint)[] as held, '' as decision from log union all
 select g, rn, event_id, list_append(case when decision = 'create_evict' then list_sort(rest)[2:] else rest end, {{'u': t, 'k': k}}), decision
 from (select *, case when own is not null and t - own.u < {SESSION_SECONDS} then 'reuse' when len(rest) >= {SESSION_MOST} then 'create_evict' else 'create' end as decision
 from (select log.*, st.held, list_filter(st.held, lambda x: x.k = log.k)[1] as own, list_filter(st.held, lambda x: x.k <> log.k) as rest from st join log on log.g = st.g and log.rn = st.rn + 1)))
 select event_id, g as tool, decision from st where rn > 0""",
    "layered_settings": """with r as (select c_nationkey, c_custkey as k, c_name, c_mktsegment, c_custkey % 2 = 0 and c_nationkey % 5 <> 0 as l, c_custkey % 3 <> 0 as a from customer)
 select c_nationkey, arg_max(c_name, k) filter (k % 3 = 0) as name, arg_max(c_name, k) filter (k % 8 = 0) as servers, bool_or(l) as limited, arg_max(k, k) filter (l and k % 5 = 0 and k > 0) as max_connections,
 arg_max(k * 2, k) filter (l and k % 7 = 0 and k > 0) as timeout_seconds, arg_max(c_mktsegment, k) filter (l and k % 6 = 0) as meta_source, max(k) filter (l and k % 6 = 0) as meta_version,
 arg_max(c_name, k) filter (a and k % 4 = 0) as token, arg_max(c_mktsegment || ',' || c_name, k) filter (a and k % 9 = 0) as scopes from r group by 1""",
    "tool_list_fanout": """with n as (select count(*) as n from supplier), p as (select p_partkey % n + 1 as k, p_name, p_type, '{"n":' || p_size || '}' as size from part, n)
 select s_suppkey::varchar as server, case when bad then 0 else count(k) end as tools, case when not bad then min(p_name) end as first, case when not bad then max(p_type) end as last, case when not bad then min(size) end as least,
 case when s_suppkey % 7 = 0 or count(k) = 0 then 'FileNotFoundError' when s_suppkey % 10 = 0 then 'JSONDecodeError' end as error
 from (select *, s_suppkey % 7 = 0 or s_suppkey % 10 = 0 as bad from supplier) s left join p on p.k = s_suppkey group by s_suppkey, bad""",
}
