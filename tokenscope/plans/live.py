"""Queries over feeds that are refreshed, budget alerts, tools as table functions and servers' status, made from the tables."""

from __future__ import annotations

import string
import uuid

import numpy as np
from pyspark.sql import functions as F

from tokenscope.operators import budgets, embed, services, tools
from tokenscope.plans.cost import LOG
from tokenscope.sources import refresh, sinks
from tokenscope.sources.tables import call_log, table
from tokenscope.streaming import stateful, status

BUDGET = 600_000


def budget_alerts(s, d):
    """Alerts at 80 and 100 % of a month's budget of each team's projects."""
    o, c = table(s, d, "orders"), table(s, d, "customer").select("c_custkey", "c_mktsegment")
    use = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("team"), F.col("o_orderpriority").alias("project"), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("month"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("tokens"),
    )
    out = budgets.budget_alerts(use, ["team", "project", "month"], ["ts", "id"], F.lit(BUDGET))
    return out.select("team", "project", "month", "id", "usage", "threshold", F.round("percentage", 4).alias("percentage"))


def tool_calls(s, d):
    """Three tools called for each row of part, conversations and customer; every 10th customer's arguments are cut short."""
    tools.register(s)
    table(s, d, "part").createOrReplaceTempView("ts_part")
    table(s, d, "conversations").createOrReplaceTempView("ts_turns")
    table(s, d, "customer").createOrReplaceTempView("ts_customer")
    return s.sql("""select 'split_words' as tool, p_partkey as id, position as n, word as text, error from ts_part, lateral call_tool('split_words', to_json(struct(p_name as text)))
 union all select 'count_tokens', conv_id * 1000 + turn, cast(tokens as int), cast(bytes as string), error from ts_turns, lateral call_tool('count_tokens', to_json(struct(text)))
 union all select 'phone_parts', c_custkey, country * 1000 + area, local, error from ts_customer,
 lateral call_tool('phone_parts', case when c_custkey % 10 = 0 then '{"phone":' else to_json(struct(lpad(cast(c_custkey % 90 as string), 2, '1') || '-' || (c_custkey % 700) || '-' || c_name as phone)) end)""")


def status_rates(s, d):
    """Status files of each nation's suppliers as servers: error rate in percent and uptime in seconds."""
    k = F.col("s_suppkey")
    up = F.when(k % 4 == 0, F.format_string("%dh%dm%d.5s", k % 50, k % 60, k % 59)).when(k % 4 == 1, F.format_string("%dms", k)).when(k % 4 == 2, F.format_string("%dm0s", k % 60)).otherwise("soon")
    one = F.struct(F.col("s_name").alias("name"), F.lit("running").alias("status"), (k % 7 * 10).alias("request_count"), (k % 3).alias("error_count"), up.alias("uptime"))
    files = table(s, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(one).alias("servers"))
    rows = services.status_rates(files.select("s_nationkey", F.to_json(F.struct("servers")).alias("text")))
    return rows.select("s_nationkey", "name", F.round("error_rate", 4).alias("error_rate"), F.round("uptime_seconds", 3).alias("uptime_seconds"))


def feed_refreshes(s, d):
    """A feed of suppliers at three polls, the second in another order, the third without every 7th and with new names for every 5th: entries, names and trust by batch."""
    root = f"{sinks.shared_folder(s, 'ts_feed_')}/feed-{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    first = table(s, d, "supplier").select(k, F.col("s_name").alias("name"), (k % 100).cast("int").alias("trust_score"))
    last = first.where(k % 7 != 0).withColumn("name", F.when(k % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    for state in (first, first.orderBy(F.desc("s_suppkey")), last):
        state.select("name", "trust_score").write.mode("overwrite").json(f"{root}/feed")
        stream = refresh.refreshes(s, f"{root}/feed", f"{root}/kept").select("version", "name", "trust_score")
        stateful.to_table(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = s.read.parquet(f"{root}/out")
    return out.groupBy("version").agg(F.count(F.lit(1)).alias("entries"), F.min("name").alias("first"), F.max("name").alias("last"), F.sum("trust_score").alias("trust"))


def status_snapshot(s, d):
    """The status of servers after the calls of all days were streamed day by day, with the number of its changes; calls of over 60 tokens failed."""
    root = f"{sinks.shared_folder(s, 'ts_status_')}/status-{uuid.uuid4().hex}"
    calls = call_log(s, d).select("server", "ts", (F.col("tokens") > 60).alias("failed"), (F.dayofmonth("ts") > 15).cast("int").alias("half"))
    for half in (0, 1):
        calls.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{root}/calls")
        stream = s.readStream.schema(calls.drop("half").schema).parquet(f"{root}/calls")
        status.status_sink(stream, f"{root}/status", f"{root}/checkpoint").awaitTermination()
    counted = status.status_changes(s, f"{root}/status").groupBy("server").agg(F.count(F.lit(1)).alias("changes"))
    now = sinks.load_snapshot(s, f"{root}/status", status.STATUS).join(counted, "server", "left")
    return now.select("server", "status", "requests", "errors", F.round("error_rate", 4).alias("error_rate"), F.col("last_activity").cast("timestamp_ntz").alias("last_activity"), "changes")


class Letters:
    """An embedder: how often each small Latin letter stands in a text."""

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in string.ascii_lowercase] for t in texts])


def prompt_vectors(s, d):
    """All turns under an embedder that is plugged in, with the vector's parts as whole numbers."""
    out = embed.embedded(table(s, d, "conversations").select("conv_id", "turn", "text"), "text", Letters, "letters")
    return out.select("conv_id", "turn", F.array_join(F.col("vector").cast("array<int>"), ",").alias("letters"), "error")


def session_json(s, d):
    """A report per conversation with turns dealt to three servers: tokens over 120 bytes count as saved, each turn but the assistant's as an event."""
    turns = table(s, d, "conversations").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), F.concat(F.lit("srv_"), (F.col("turn") % 3).cast("string")).alias("server"), "turn", "role", F.octet_length("text").cast("long").alias("original"))
    kinds = F.when(F.col("turn") % 4 == 0, "api_key").when(F.col("turn") % 4 == 1, "secret").when(F.col("turn") % 4 == 2, "pii").otherwise("other")
    return services.session_json(turns.withColumn("saved", F.greatest(F.col("original") - 120, F.lit(0))), turns.where("role <> 'assistant'").select("session", kinds.alias("kind")))


QUERIES = {f.__name__: f for f in (budget_alerts, tool_calls, status_rates, feed_refreshes, status_snapshot, prompt_vectors, session_json)}

SQL = {
    "budget_alerts": f"""with u as (select c_mktsegment as team, o_orderpriority as project, strftime(o_orderdate, '%Y-%m') as month, o_orderdate, o_orderkey as id, cast(floor(o_totalprice) as bigint) as tokens from orders join customer on o_custkey = c_custkey),
 r as (select *, cast(sum(tokens) over (partition by team, project, month order by o_orderdate, id rows unbounded preceding) as bigint) as usage from u)
 select team, project, month, id, usage, threshold, round(usage * 100.0::double / {BUDGET}, 4) as percentage from r, (values (80), (100)) t(threshold) where (usage - tokens) * 100 < threshold * {BUDGET} and usage * 100 >= threshold * {BUDGET}""",
    "prompt_vectors": """select conv_id, turn, array_to_string(list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: strlen(text) - strlen(replace(text, c, ''))), ',') as letters, null as error from conversations""",
    "session_json": """with t as (select 's' || conv_id as session, 'srv_' || turn % 3 as server, turn % 4 as k, role <> 'assistant' as risk, strlen(text) as original, greatest(strlen(text) - 120, 0) as saved from conversations),
 a as (select session, server, cast(sum(original) as bigint) as original, cast(sum(saved) as bigint) as saved from t group by 1, 2),
 b as (select session, '[' || string_agg('{"server":"' || server || '","original_tokens":' || original || ',"optimized_tokens":' || (original - saved) || ',"saved_tokens":' || saved || ',"savings_percentage":' || case when original > 0 then round(saved * 100.0::double / original, 2) else 0.0::double end || '}', ',' order by server) || ']' as servers from a group by 1),
 c as (select session, count(*) as n, cast(sum(original) as bigint) as original, cast(sum(saved) as bigint) as saved, count(*) filter (risk) as risks, count(*) filter (risk and k = 0) as r0, count(*) filter (risk and k = 1) as r1, count(*) filter (risk and k = 2) as r2 from t group by 1)
 select session, '{"session_id":"' || session || '","summary":{"total_requests":' || n || ',"total_tokens_saved":' || saved || ',"savings_percentage":' || case when original > 0 then round(saved * 100.0::double / original, 2) else 0.0::double end || ',"security_risks_intercepted":' || risks
 || '},"token_savings":' || servers || ',"risk_summary":{"api_key":' || r0 || ',"secret":' || r1 || ',"pii":' || r2 || ',"custom_pattern":0}}' as body from b join c using (session)""",
    "tool_calls": """select 'split_words' as tool, p_partkey as id, cast(unnest(range(1, len(string_split(p_name, ' ')) + 1)) as integer) as n, unnest(string_split(p_name, ' ')) as text, null as error from part
 union all select 'count_tokens', conv_id * 1000 + turn, cast(ceil(strlen(text) / 4.0) as integer), cast(strlen(text) as varchar), null from conversations
 union all select 'phone_parts', c_custkey, case when c_custkey % 10 <> 0 then cast(lpad(cast(c_custkey % 90 as varchar), 2, '1') as integer) * 1000 + c_custkey % 700 end, case when c_custkey % 10 <> 0 then c_name end,
 case when c_custkey % 10 = 0 then 'JSONDecodeError' end from customer""",
    "status_rates": """select s_nationkey, s_name as name, round(case when s_suppkey % 7 = 0 then 0 else (s_suppkey % 3) * 100.0::double / (s_suppkey % 7 * 10) end, 4) as error_rate,
 round(case s_suppkey % 4 when 0 then s_suppkey % 50 * 3600 + s_suppkey % 60 * 60 + s_suppkey % 59 + 0.5::double when 1 then s_suppkey / 1000.0::double when 2 then s_suppkey % 60 * 60 else 0 end, 3) as uptime_seconds from supplier""",
    "feed_refreshes": """select 1::bigint as version, count(*) as entries, min(s_name) as first, max(s_name) as last, cast(sum(s_suppkey % 100) as bigint) as trust from supplier
 union all select 2, count(*), min(n), max(n), cast(sum(k % 100) as bigint) from (select s_suppkey as k, case when s_suppkey % 5 = 0 then s_name || '!' else s_name end as n from supplier where s_suppkey % 7 <> 0)""",
    "status_snapshot": f"""with l as (select server, ts, tokens > 60 as failed, day(ts) > 15 as late from {LOG}),
 a as (select server, count(*) as requests, count(*) filter (failed) as errors, max(ts) as last_activity, arg_max(failed, (ts, failed)) as bad, arg_max(failed, (ts, failed)) filter (not late) as was, arg_max(failed, (ts, failed)) filter (late) as newer, max(ts) filter (not late) as t1, max(ts) filter (late) as t2 from l group by 1)
 select server, case when bad then 'error' else 'running' end as status, requests, errors, round(errors * 100.0::double / requests, 4) as error_rate, last_activity,
 1::bigint + case when was is not null and was <> bad then 1 else 0 end as changes from a""",
}
