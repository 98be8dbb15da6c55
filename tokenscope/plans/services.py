"""Queries over settings files, status files, cache writes, manifests, usage and reports, made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenscope.operators import services as op
from tokenscope.operators import state
from tokenscope.plans import scalars
from tokenscope.plans.cost import LOG
from tokenscope.plans.scalars import trust_scores
from tokenscope.plans.stateful import _log
from tokenscope.sources.tables import call_log, table

SOURCES = ("claude", "cursor", "vscode", "other")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def discovered_servers(s, d):
    """A settings file for each supplier, in the forms of three programs and one unknown; every 10th is cut short."""
    k = F.col("s_suppkey")
    server = F.format_string('{"command": "%s", "args": ["-y", "%s"], "env": ["A=%d"], "other": 1}', _pick(["npx", "/usr/bin/node", "/run", ""], k), "s_name", k)
    text = F.format_string('{"x": 1, "%s": {"%s": %s, "second": {"command": "uv"}}}', F.when(k % 4 == 2, "mcpExtensions").when(k % 4 == 1, "mcp_servers").otherwise("mcpServers"), "s_name", server)
    files = table(s, d, "supplier").select("s_suppkey", _pick(SOURCES, k).alias("source"), F.when(k % 10 == 0, F.substring(text, 1, 40)).otherwise(text).alias("text"))
    return op.discovered_servers(files).select("s_suppkey", "source", "name", "transport", "command", F.array_join("args", " ").alias("args"), F.array_join("env", " ").alias("env"), "cwd")


def _status_files(s, d):
    """A status file per nation with its suppliers as servers."""
    sup = table(s, d, "supplier")
    one = F.struct(F.col("s_name").alias("name"), _pick(["running", "error", "stopped", "lost"], F.col("s_suppkey")).alias("status"), (F.col("s_suppkey") * 3).alias("request_count"))
    each = sup.groupBy("s_nationkey").agg(F.collect_list(one).alias("servers"), F.sum("s_suppkey").alias("total"))
    cost = F.struct(F.create_map(F.lit("click"), F.col("total")).alias("by_tool"), F.create_map(F.lit("srv"), F.col("total") * 2).alias("by_server"), (F.col("s_nationkey") % 2 == 0).alias("enabled"))
    return each.select("s_nationkey", F.to_json(F.struct((F.col("s_nationkey") + 100).alias("pid"), "servers", cost.alias("cost_tracking"))).alias("text"))


def running_status(s, d):
    return op.status_rows(_status_files(s, d)).select("s_nationkey", "pid", "name", "status", "request_count")


def status_by_server(s, d):
    """The servers of one name in all status files."""
    return op.status_rows(_status_files(s, d)).where("name = 'Supplier#000000007'").select("s_nationkey", "name", "status")


def status_costs(s, d):
    return op.status_costs(_status_files(s, d))


def _writes(s, d):
    t = table(s, d, "conversations")
    at = F.timestamp_add("SECOND", (F.col("conv_id") * 60 + F.col("turn")).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    response = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit("r"), F.col("conv_id").cast("string")))
    return t.select(F.col("role").alias("tool"), F.col("text").alias("prompt"), response.alias("response"), at.alias("stored_at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


def semantic_cache_store(s, d):
    return op.cache_store(_writes(s, d), 3600, F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")).where("not expired").select("key", "tool", "response", "stored_at")


def semantic_cache_evictions(s, d):
    out = op.cache_store(_writes(s, d), 3600, F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))
    return out.groupBy("tool").agg(F.count_if("expired").alias("evicted"), F.count_if(~F.col("expired")).alias("kept"))


def compacted_manifests(s, d):
    """Suppliers as servers with the parts of their number as tools; long descriptions are made of the part's name."""
    k = F.col("p_partkey")
    tool = F.struct(F.concat(F.lit("t"), k.cast("string")).alias("name"), F.when(k % 3 == 0, F.repeat("p_name", 4)).otherwise(F.col("p_name")).alias("description"), F.lit("{}").alias("parameters"))
    each = table(s, d, "part").groupBy((k % 97).alias("n")).agg(F.sort_array(F.collect_list(tool)).alias("tools"))
    out = op.compacted(each.select(F.concat(F.lit("srv"), F.col("n").cast("string")).alias("server"), "tools"))
    return out.select("server", "key", F.sha2("distilled", 256).alias("distilled_sha256"), "reduction_percent")


def _responses(s, d):
    read = F.when(F.col("turn") % 3 == 0, F.octet_length("text")).otherwise(0)
    body = F.format_string('{"usage": {"cache_read_input_tokens": %d, "cache_creation_input_tokens": %d}, "b": [1, 2.5, null], "a": "%s"}', read, F.when(F.col("turn") % 3 == 1, 5).otherwise(0), "role")
    return table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 7 == 6, "not json").otherwise(body).alias("body"))


def response_usage(s, d):
    """Prompt-cache hits with their tokens and misses, as responses report them."""
    used = _responses(s, d).select(op.response_usage(F.col("body")).alias("u")).where("u is not null")
    return used.groupBy("u.kind").agg(F.count(F.lit(1)).alias("n"), F.sum("u.tokens").alias("tokens"))


def json_token_estimate(s, d):
    return _responses(s, d).select("conv_id", "turn", op.estimate_json(F.col("body")).alias("tokens"))


def session_reports(s, d):
    """A report per conversation: tokens over 120 characters count as saved, system turns as risks."""
    tokens = F.octet_length("text").cast("long")
    each = table(s, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("original"), F.sum(F.greatest(tokens - 120, F.lit(0))).alias("saved"), F.count_if(F.col("role") == "system").alias("risks")
    )
    session = F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.concat(F.lit("s|"), F.col("conv_id").cast("string")))
    return op.session_report(each.withColumn("session", session)).groupBy("session", "report").agg(F.count(F.lit(1)).alias("n"))


def registry_changes(s, d):
    """Events between two states of a registry: every 5th supplier is new, every 7th gone, every 3rd renamed."""
    t = table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("x"))
    k = F.col("s_suppkey")
    after = t.where(k % 7 != 0).withColumn("name", F.when(k % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return op.changes(t.where(k % 5 != 0), after, "s_suppkey", ["name", "x"])


def dashboard_json(s, d):
    """As it stood at noon of the 18th, a Thursday."""
    return op.dashboard_json(call_log(s, d), F.lit("2024-01-18 12:00:00").cast("timestamp_ntz"))


def line_word_counts(s, d):
    """Lines and words of each document; an empty text has one line and no word."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[ \t\n\f\r\x0b]+"), lambda w: w != ""))
    return table(s, d, "documents").select("doc_id", F.size(F.split(text, "\n", -1)).alias("lines"), words.alias("words"))


def micro_batches(s, d):
    """Batches of each server's calls, of ten at most, each closed two hours after its first."""
    rows = state.replay(_log(s, d), "server", ["ts", "event_id"], lambda k: op.MicroBatcher(10, 7200.0), ["t"], ["event_id", "server"], "event_id long, server string")
    return rows.select("event_id", "server", F.col("decision").cast("long").alias("batch"))


def bounded_queue(s, d):
    """Each server's calls through a queue of three, served in 4,000 seconds each, given up after 7,000."""
    return state.replay(_log(s, d), "server", ["ts", "event_id"], lambda k: op.BoundedQueue(3, 4000.0, 7000.0), ["t"], ["event_id", "server"], "event_id long, server string")


def server_trust(s, d):
    """Trust of each supplier by the score of the part of its number; every 10th has none."""
    servers = table(s, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return op.with_trust(servers, trust_scores(s, d).where("p_partkey % 10 <> 0"), "p_partkey")


QUERIES = {
    f.__name__: f
    for f in (
        discovered_servers, running_status, status_by_server, status_costs, semantic_cache_store, semantic_cache_evictions, compacted_manifests, response_usage, json_token_estimate,
        session_reports, registry_changes, dashboard_json, line_word_counts, micro_batches, bounded_queue, server_trust,
    )
}

_STATUS = "(select s_nationkey, s_nationkey + 100 as pid, s_name as name, (['running', 'error', 'stopped', 'unresponsive'])[s_suppkey % 4 + 1] as status, s_suppkey * 3 as request_count from supplier)"
_WRITES = """(select key, arg_max(tool, seq) as tool, arg_max(response, seq) as response, arg_max(stored_at, seq) as stored_at from (select sha256(role || chr(0) || text) as key, role as tool, 'r' || conv_id as response,
 timestamp '2024-01-01' + to_seconds(conv_id * 60 + turn) as stored_at, conv_id * 1000 + turn as seq from conversations where turn % 5 <> 4) group by key)"""
_BODY = """(select conv_id, turn, role, case when turn % 7 = 6 then null when turn % 3 = 0 then strlen(text) else 0 end as read, case when turn % 7 = 6 then null when turn % 3 = 1 then 5 else 0 end as written from conversations)"""
_TOOL = lambda d: f"""'{{"name":"t' || p_partkey || '","description":' || to_json({d}) || ',"parameters":"{{}}"}}'"""

SQL = {
    "bounded_queue": f"""with recursive log as materialized (select event_id, server, epoch_us(ts) / 1e6 as t, row_number() over (partition by server order by ts, event_id) as rn from {LOG}),
 st as (select distinct server, 0::bigint as rn, null::bigint as event_id, []::double[] as starts, 0::double as free, '' as decision from log union all
 select server, rn, event_id, case when len(waiting) >= 3 then waiting else list_append(waiting, greatest(t, free)) end, case when len(waiting) >= 3 or greatest(t, free) - t > 7000 then free else greatest(t, free) + 4000 end,
 case when len(waiting) >= 3 then 'full' when greatest(t, free) - t > 7000 then 'timeout' else 'done' end
 from (select l.server, l.rn, l.event_id, l.t, st.free, list_filter(st.starts, lambda x: x > l.t) as waiting from st join log l on l.server = st.server and l.rn = st.rn + 1)) select event_id, server, decision from st where rn > 0""",
    "server_trust": f"""select s_suppkey as p_partkey, s_name, score, coalesce(score < 40, false) as low_trust from supplier left join (select p_partkey, score from ({scalars.SQL["trust_scores"]}) where p_partkey % 10 <> 0) on s_suppkey = p_partkey""",
    "discovered_servers": """with t as (select s_suppkey, s_name, (['claude', 'cursor', 'vscode', 'other'])[s_suppkey % 4 + 1] as source, (['npx', '/usr/bin/node', '/run', ''])[s_suppkey % 4 + 1] as command,
 (['.', '/usr/bin', '/', '.'])[s_suppkey % 4 + 1] as cwd from supplier where s_suppkey % 10 <> 0)
 select s_suppkey, source, s_name as name, 'stdio' as transport, command, '-y ' || s_name as args, 'A=' || s_suppkey as env, cwd from t where source <> 'other'
 union all select s_suppkey, source, 'second', 'stdio', 'uv', null, null, '.' from t where source <> 'other'""",
    "running_status": f"select s_nationkey, pid, name, status, request_count from {_STATUS}",
    "status_by_server": f"select s_nationkey, name, status from {_STATUS} where name = 'Supplier#000000007'",
    "status_costs": """with t as (select s_nationkey, cast(sum(s_suppkey) as bigint) as n from supplier where s_nationkey % 2 = 0 group by 1)
 select s_nationkey, 'tool' as kind, 'click' as name, n as tokens from t union all select s_nationkey, 'server', 'srv', n * 2 from t""",
    "semantic_cache_store": f"select key, tool, response, stored_at from {_WRITES} where stored_at >= timestamp '2024-01-01 01:00:00'",
    "semantic_cache_evictions": f"select tool, count(*) filter (stored_at < timestamp '2024-01-01 01:00:00') as evicted, count(*) filter (stored_at >= timestamp '2024-01-01 01:00:00') as kept from {_WRITES} group by tool",
    "compacted_manifests": f"""with p as (select 'srv' || (p_partkey % 97) as server, 't' || p_partkey as tool, {_TOOL("case when p_partkey % 3 = 0 then repeat(p_name, 4) else p_name end")} as long,
 {_TOOL("case when p_partkey % 3 = 0 and length(p_name) * 4 > 50 then substr(repeat(p_name, 4), 1, 47) || '...' when length(p_name) > 50 then substr(p_name, 1, 47) || '...' when p_partkey % 3 = 0 then repeat(p_name, 4) else p_name end")} as short from part),
 m as (select server, '[' || string_agg(long, ',' order by tool) || ']' as before, '[' || string_agg(short, ',' order by tool) || ']' as after from p group by server)
 select server, sha256(server || lower(hex('{{"name":"' || server || '","tools":' || before || '}}'))) as key, sha256(after) as distilled_sha256,
 round((strlen(before) // 4 - strlen(after) // 4) * 100 / (strlen(before) // 4)::double, 6) as reduction_percent from m""",
    "response_usage": f"""select case when read > 0 then 'hit' else 'miss' end as kind, count(*) as n, cast(sum(read) as bigint) as tokens from {_BODY} where read > 0 or written > 0 group by 1""",
    "json_token_estimate": f"""select conv_id, turn, case when read is null then 0 else cast(ceil(strlen('{{"a":"' || role || '","b":[1,2.5,null],"usage":{{"cache_creation_input_tokens":' || written || ',"cache_read_input_tokens":' || read || '}}}}') / 4.0) as bigint) end as tokens from {_BODY}""",
    "session_reports": """with t as (select conv_id, count(*) as requests, sum(strlen(text)) as original, sum(greatest(strlen(text) - 120, 0)) as saved, count(*) filter (role = 'system') as risks from conversations group by 1),
 u as (select *, case when conv_id % 9 = 0 then '' else 's|' || conv_id end as session from t)
 select session, '# Session Report' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10) || '| Session ID | `' || case when session = '' then 'N/A' else replace(session, '|', '\\|') end || '` |' || chr(10)
 || '| Total Requests | `' || requests || '` |' || chr(10) || '| **Total Tokens Saved** | **' || saved || ' (' || printf('%.2f', case when original > 0 then saved * 100.0::double / original else 0 end) || '%)** |' || chr(10)
 || '| Security Risks Intercepted | `' || risks || '` |' as report, count(*) as n from u group by 1, 2""",
    "registry_changes": """select s_suppkey, case when s_suppkey % 5 = 0 then 'added' when s_suppkey % 7 = 0 then 'removed' else 'changed' end as event from supplier
 where (s_suppkey % 5 = 0 and s_suppkey % 7 <> 0) or (s_suppkey % 5 <> 0 and s_suppkey % 7 = 0) or (s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0 and s_suppkey % 3 = 0)""",
    "dashboard_json": f"""with l as (select * from {LOG}), s as (select server, cast(sum(tokens) as bigint) as n from l group by 1), t as (select tool, cast(sum(tokens) as bigint) as n from l group by 1)
 select '{{"per_server":[' || (select string_agg('{{"server":"' || server || '","tokens":' || n || '}}', ',' order by n desc, server) from s) || '],"per_tool":[' || (select string_agg('{{"tool":"' || tool || '","tokens":' || n || '}}', ',' order by n desc, tool) from t)
 || '],"server_count":' || (select count(*) from s) || ',"today_spend":' || (select sum(tokens) from l where ts between timestamp '2024-01-18' and timestamp '2024-01-18 12:00:00') || ',"tool_count":' || (select count(*) from t) || ',"top_server":"' || (select server from s order by n desc, server limit 1)
 || '","top_tool":"' || (select tool from t order by n desc, tool limit 1) || '","total_spend":' || (select sum(n) from s) || ',"wtd_spend":' || (select sum(tokens) from l where ts between timestamp '2024-01-15' and timestamp '2024-01-18 12:00:00') || '}}' as body""",
    "line_word_counts": r"""select doc_id, cast(len(string_split(coalesce(text, ''), chr(10))) as integer) as lines, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\f\r\x0b]+'), lambda w: w <> '')) as integer) as words from documents""",
    "micro_batches": f"""with recursive log as materialized (select event_id, server, epoch_us(ts) / 1e6 as t, row_number() over (partition by server order by ts, event_id) as rn from {LOG}),
 st as (select distinct server, 0::bigint as rn, null::bigint as event_id, 0::bigint as batch, 0::double as opened, 0 as size from log union all
 select server, rn, event_id, batch + fresh, case when fresh = 1 then t else opened end, case when fresh = 1 then 1 else size + 1 end from (select l.server, l.rn, l.event_id, l.t, st.batch, st.opened, st.size,
 case when st.batch = 0 or st.size >= 10 or l.t - st.opened > 7200 then 1 else 0 end as fresh from st join log l on l.server = st.server and l.rn = st.rn + 1)) select event_id, server, batch from st where rn > 0""",
}
