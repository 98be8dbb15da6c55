"""Cost queries over the call log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tokenscope.operators import cost as op
from tokenscope.sources.tables import call_log, since, table

#: The call log as a DuckDB relation, the same expressions as sources.tables.call_log.
LOG = "(select event_id, event_type as tool, 'srv_' || cast(user_id % 8 as varchar) as server, cast(floor(value) as bigint) as tokens, ts from events)"
START = datetime(2024, 1, 20)


def volume(spark, sf_dir):
    """The largest table as a call log: suppliers as servers, parts' last digits as tools."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("server"), (F.col("l_partkey") % 10).alias("tool"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_shipdate").alias("ts"))


QUERIES = {
    "server_drilldown": lambda s, d: op.drilldown(call_log(s, d), "server", "srv_3", "tool"),
    "tool_drilldown": lambda s, d: op.drilldown(call_log(s, d), "tool", "click", "server"),
    "server_drilldown_since": lambda s, d: op.drilldown(call_log(s, d), "server", "srv_1", "tool", START),
    "cost_breakdown": lambda s, d: op.breakdown(call_log(s, d)),
    "cost_by_tool": lambda s, d: op.by(call_log(s, d), "tool"),
    "cost_by_server": lambda s, d: op.by(call_log(s, d), "server"),
    "server_tool_stats": lambda s, d: op.by(call_log(s, d), "server", "tool"),
    "top5_tools": lambda s, d: op.top(call_log(s, d), "tool", 5),
    "top_server": lambda s, d: op.top_one(call_log(s, d), "server"),
    "calls_since": lambda s, d: since(call_log(s, d), START).select("event_id", "tool", "server", "tokens"),
    "server_totals_text": lambda s, d: op.totals_text(call_log(s, d), "server"),
    "prompt_hash_totals": lambda s, d: op.prompt_hashes(call_log(s, d), F.col("tool"), (F.col("event_id") % 97).cast("string")),
    "daily_spend": lambda s, d: op.spend(call_log(s, d), "day"),
    "weekly_spend": lambda s, d: op.spend(call_log(s, d), "week"),
    "export_rows": lambda s, d: op.export_rows(call_log(s, d)),
    "dashboard_snapshot": lambda s, d: op.dashboard(call_log(s, d)),
    "server_error_rate": lambda s, d: op.error_rate(call_log(s, d), F.col("tool") == "error"),
    "server_latency_totals": lambda s, d: op.latency_totals(call_log(s, d), F.col("tool") != "error", F.col("tokens")),
    "cost_volume": lambda s, d: op.by(volume(s, d), "server", "tool"),
}

_by = "select {0}, cast(sum(tokens) as bigint) as tokens, count(*) as calls, max(ts) as last_call from {1} group by {0}"
_drill = """select {child}, count(*) as calls, cast(sum(tokens) as bigint) as tokens, round(avg(tokens), 6) as avg_tokens,
 max(ts) as last_call, cast(sum(sum(tokens)) over () as bigint) as total_tokens from {log} where {cond} group by {child}"""

SQL = {
    "server_drilldown": _drill.format(child="tool", log=LOG, cond="server = 'srv_3'"),
    "tool_drilldown": _drill.format(child="server", log=LOG, cond="tool = 'click'"),
    "server_drilldown_since": _drill.format(child="tool", log=LOG, cond="server = 'srv_1' and ts >= timestamp '2024-01-20'"),
    "cost_breakdown": f"""select 'tool' as kind, tool as name, cast(sum(tokens) as bigint) as tokens from {LOG} group by tool union all
 select 'server', server, cast(sum(tokens) as bigint) from {LOG} group by server union all select 'total', '', cast(sum(tokens) as bigint) from {LOG}""",
    "cost_by_tool": _by.format("tool", LOG),
    "cost_by_server": _by.format("server", LOG),
    "server_tool_stats": _by.format("server, tool", LOG),
    "top5_tools": f"select tool, cast(sum(tokens) as bigint) as tokens from {LOG} group by tool order by tokens desc, tool limit 5",
    "top_server": f"select server, cast(sum(tokens) as bigint) as tokens from {LOG} group by server order by tokens desc, server limit 1",
    "calls_since": f"select event_id, tool, server, tokens from {LOG} where ts >= timestamp '2024-01-20'",
    "server_totals_text": f"""with t as (select server, cast(sum(tokens) as bigint) as tokens from {LOG} group by server)
 select string_agg(server || '=' || cast(tokens as varchar), ',' order by server) as totals, cast(sum(tokens) as bigint) as grand_total from t""",
    "prompt_hash_totals": f"""select sha256(tool || '|' || cast(event_id % 97 as varchar)) as hash, cast(sum(tokens) as bigint) as tokens, 1 as count, count(*) as calls
 from {LOG} group by all""",
    "daily_spend": f"select date_trunc('day', ts)::timestamp as period, cast(sum(tokens) as bigint) as tokens, count(*) as calls from {LOG} group by 1",
    "weekly_spend": f"select date_trunc('week', ts)::timestamp as period, cast(sum(tokens) as bigint) as tokens, count(*) as calls from {LOG} group by 1",
    "export_rows": f"""select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, '' as team, '' as project, server, tool, tokens,
 printf('%.6f', tokens * 0.000002::double) as estimated_cost from {LOG}""",
    "dashboard_snapshot": f"""with l as (select * from {LOG}), t as (select tool, sum(tokens) as n from l group by tool order by n desc, tool limit 1),
 v as (select server, sum(tokens) as n from l group by server order by n desc, server limit 1)
 select cast(sum(tokens) as bigint) as total_tokens, count(*) as calls, count(distinct tool) as tools, count(distinct server) as servers, (select tool from t) as top_tool,
 cast((select n from t) as bigint) as top_tool_tokens, (select server from v) as top_server, cast((select n from v) as bigint) as top_server_tokens from l""",
    "server_error_rate": f"""select server, count(*) filter (tool = 'error') as errors, count(*) as calls,
 round(count(*) filter (tool = 'error') * 100.0::double / count(*), 6) as error_rate from {LOG} group by server""",
    "server_latency_totals": f"""select server, count(*) filter (tool <> 'error') as succeeded, count(*) filter (tool = 'error') as failed, round(avg(tokens), 6) as avg_latency
 from {LOG} group by rollup (server)""",
    "cost_volume": _by.format(
        "server, tool", "(select l_suppkey as server, l_partkey % 10 as tool, cast(trunc(l_quantity) as bigint) as tokens, l_shipdate as ts from lineitem)"
    ),
}
