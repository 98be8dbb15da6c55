"""Queries for tokens, savings, prices, trust and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tokenscope.functions import scalars as fn
from tokenscope.sources.tables import table

DAY = "2024-06-01"


def token_estimate(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), fn.estimate_tokens(F.col("text")).alias("tokens"), fn.floor_tokens(F.col("text")).alias("floor_tokens"))


def savings(s, d):
    """Turns as requests: the optimized form is the first 120 characters; the server is the conversation's number modulo 8."""
    turns = table(s, d, "conversations")
    original, short = fn.estimate_tokens(F.col("text")), fn.estimate_tokens(F.substring("text", 1, 120))
    clamped, saved, percent = fn.saved_tokens(original, short)
    return turns.select(
        "conv_id", "turn", F.concat(F.lit("srv_"), (F.col("conv_id") % 8).cast("string")).alias("server"), original.alias("original"), clamped.alias("optimized"), saved.alias("saved"), percent.alias("percent")
    )


def savings_by_server(s, d):
    return savings(s, d).groupBy("server").agg(F.sum("original").alias("original"), F.sum("optimized").alias("optimized"), F.sum("saved").alias("saved"))


def cumulative_savings(s, d):
    """requests_processed is the number of servers, as the model defines it; requests counts the rows."""
    return savings(s, d).agg(
        F.sum("original").alias("original"), F.sum("optimized").alias("optimized"), F.sum("saved").alias("saved"), F.count_distinct("server").alias("requests_processed"), F.count(F.lit(1)).alias("requests")
    )


def session_replay(s, d):
    """Native against routed schema tokens per conversation: a quarter of 35 tools x 75 tokens for each server in use, against 158 + 27 tokens a turn, also quartered where the schema was read before."""
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("role").alias("servers"))
    native = (F.col("prompts") * F.floor(F.col("servers") * fn.TOOLS_PER_SERVER * fn.TOKENS_PER_TOOL / 4)).cast("long")
    lean = (F.col("prompts") * 185).cast("long")
    return turns.select("conv_id", "prompts", "servers", native.alias("native_tokens"), lean.alias("routed_tokens"), F.round((native - lean) / native * 100, 6).alias("saved_percent"))


def model_savings(s, d):
    """Dollars saved by cached input per model, over the roles' tokens; one model is unknown and one empty (the default)."""
    models = [*(p[0] for p in fn.PRICES), "", "unknown-model"]
    names = F.element_at(F.array(*map(F.lit, models)), (F.col("conv_id") % len(models) + 1).cast("int"))
    tokens = table(s, d, "conversations").groupBy(names.alias("asked")).agg(F.sum(fn.estimate_tokens(F.col("text"))).alias("tokens"))
    priced = tokens.withColumn("model", F.when(F.col("asked") == "", fn.DEFAULT_MODEL).otherwise(F.col("asked"))).join(F.broadcast(fn.price_table(s)), "model", "left")
    dollars = F.when(F.col("input_price").isNull(), 0.0).otherwise(fn.dollars_saved(F.col("tokens"), F.col("input_price"), F.col("cached_price")))
    return priced.select("asked", "model", "tokens", F.round(dollars, 9).alias("dollars"))


def monthly_comparison(s, d):
    """Monthly dollars per provider for the suppliers as servers: 100 sessions, 80 % input tokens, cut to integers."""
    n = table(s, d, "supplier").agg((F.count(F.lit(1)) * fn.TOOLS_PER_SERVER * fn.TOKENS_PER_TOOL - 158).alias("saved"))
    rates = s.createDataFrame(fn.MONTHLY_RATES, "provider string, input_rate double, output_rate double")
    inp, out = F.floor(F.col("saved") * 100 * F.lit(0.8)), F.floor(F.col("saved") * 100 * F.lit(0.2))
    return n.join(F.broadcast(rates), F.lit(True)).select("provider", "saved", F.round(inp / 1e6 * F.col("input_rate") + out / 1e6 * F.col("output_rate"), 6).alias("savings_usd"))


def prompt_cache_stats(s, d):
    """Counters over turns: system turns are cacheable, a repeated text is a hit, its tokens are cached input."""
    asks = F.col("role") != "assistant"
    turns = table(s, d, "conversations").select(F.sha2("text", 256).alias("hash"), "conv_id", "turn", "role", fn.estimate_tokens(F.col("text")).alias("tokens"))
    # counts of each text's turns, gathered before the shuffle; only its first turn is no hit
    each = turns.groupBy("hash", "tokens").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asked"), F.count_if(F.col("role") == "system").alias("system"), F.min_by(asks, F.struct("conv_id", "turn")).cast("long").alias("first_asks")
    )
    c = each.agg(
        F.sum("n").alias("total"),
        F.sum("asked").alias("matched"),
        F.sum("system").alias("cacheable"),
        F.sum(F.col("asked") - F.col("first_asks")).alias("hits"),
        F.sum("first_asks").alias("misses"),
        F.sum(F.col("n") * F.col("tokens")).alias("input_tokens"),
        F.sum((F.col("n") - 1) * F.col("tokens")).alias("cached_tokens"),
    )
    rate = F.round(F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("hits"), F.col("matched"))), F.lit(0.0)), 6)
    return c.withColumn("hit_rate", rate)


def _feed(s, d):
    """Parts as a feed: signals from their numbers; every 50th has none."""
    p, k = table(s, d, "part"), F.col("p_partkey")
    empty = k % 50 == 0
    blank = lambda c: F.when(empty, 0).otherwise(c)
    return p.select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.when(k % 40 == 7, (k % 100).cast("int")).otherwise(0).alias("given"),
        F.when(~empty & (k % 9 != 0), ((k * 7) % 500 - 3).cast("int")).alias("days"),
        blank((k * 13) % 130).cast("int").alias("issues"),
        blank((k * k * 31) % 150_000).cast("int").alias("downloads"),
        empty.alias("is_empty"),
    )


def trust_scores(s, d):
    score = fn.trust_score(*(F.col(c) for c in ("given", "days", "issues", "downloads", "is_empty"))).cast("int")
    return _feed(s, d).select("p_partkey", score.alias("score"), fn.trust_level(score).alias("level"), (score < 40).alias("low_trust"))


def trust_levels(s, d):
    return trust_scores(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("entries"), F.min("score").alias("least"), F.max("score").alias("most"))


def _usage(s, d):
    """Customers' segments as teams, one month of orders as their use of tokens."""
    o, c = table(s, d, "orders"), table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("team"), F.col("o_orderpriority").alias("project"), F.floor("o_totalprice").cast("long").alias("tokens"), F.col("o_orderdate").alias("ts"))


def budget_month_usage(s, d):
    return _usage(s, d).groupBy("team", F.date_trunc("month", F.col("ts").cast("timestamp_ntz")).alias("month")).agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("calls"))


def budget_decision(s, d):
    """A decision per team and month: limits that follow from the team's name length, half of the use counts as today's."""
    use, n = budget_month_usage(s, d), F.length("team")
    monthly, daily = (n * 1_000_000).cast("long"), (n * 400_000).cast("long")
    remaining = F.greatest(F.lit(0), daily - F.floor(F.col("used") / 2)).cast("long")
    action, day, month = fn.budget_action(F.col("team") != "MACHINERY", remaining, daily, F.col("used"), monthly, F.col("team").startswith("A"), F.lit(90.0))
    return use.select("team", "month", "used", action.alias("action"), day.alias("daily_pct"), month.alias("monthly_pct"))


def number_texts(s, d):
    c = table(s, d, "customer")
    n = F.floor(F.abs("c_acctbal") * F.col("c_custkey")).cast("long")
    return c.select("c_custkey", n.alias("n"), fn.humanized(n).alias("short"))


def description_lines(s, d):
    """Turns as tool descriptions, cut to 200 bytes."""
    return table(s, d, "conversations").select("conv_id", "turn", fn.truncate_bytes(F.col("text"), 200).alias("line"), F.octet_length(fn.truncate_bytes(F.col("text"), 200)).alias("bytes"))


QUERIES = {f.__name__: f for f in (token_estimate, savings_by_server, cumulative_savings, session_replay, model_savings, monthly_comparison, prompt_cache_stats, trust_scores, trust_levels, budget_month_usage, budget_decision, number_texts, description_lines)}
QUERIES["savings_rows"] = savings

_CUT = "case when strlen(text) > 200 then substr(text, 1, list_max(list_filter(range(0, 198), lambda k: strlen(substr(text, 1, cast(k as bigint))) <= 197))) || '...' else text end"
_EST = "cast(ceil(strlen({0}) / 4.0) as bigint)"
_SAVE = f"""(select conv_id, turn, 'srv_' || cast(conv_id % 8 as varchar) as server, {_EST.format('text')} as original,
 least({_EST.format('substr(text, 1, 120)')}, {_EST.format('text')}) as optimized, {_EST.format('text')} - least({_EST.format('substr(text, 1, 120)')}, {_EST.format('text')}) as saved from conversations)"""
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::double" for x in r) + ")" for r in rows)
_FEED = """(select p_partkey, case when p_partkey % 40 = 7 then p_partkey % 100 else 0 end as given, case when p_partkey % 50 <> 0 and p_partkey % 9 <> 0 then (p_partkey * 7) % 500 - 3 end as days,
 case when p_partkey % 50 = 0 then 0 else (p_partkey * 13) % 130 end as issues, case when p_partkey % 50 = 0 then 0 else (p_partkey * p_partkey * 31) % 150000 end as downloads,
 p_partkey % 50 = 0 as is_empty from part)"""
_TRUST = f"""(select p_partkey, cast(case when given > 0 then given when is_empty then 100 else greatest(0, least(100,
 case when days is null then 0 when days between -1 and 30 then 30 when days < 0 then 0 when days <= 90 then 20 when days <= 365 then 10 else 0 end
 + case when issues <= 0 then 0 when issues < 5 then 25 when issues < 20 then 15 when issues < 100 then 5 else 0 end
 + case when downloads <= 0 then 0 when downloads >= 100000 then 25 when downloads >= 10000 then 20 when downloads >= 1000 then 15 when downloads >= 100 then 10 else 5 end)) end as integer) as score from {_FEED})"""
_LEVEL = "case when score >= 70 then 'high' when score >= 40 then 'medium' else 'low' end"
_USE = """(select c_mktsegment as team, o_orderpriority as project, cast(floor(o_totalprice) as bigint) as tokens, o_orderdate as ts from orders join customer on o_custkey = c_custkey)"""
_MONTH = f"(select team, date_trunc('month', ts)::timestamp as month, cast(sum(tokens) as bigint) as used, count(*) as calls from {_USE} group by 1, 2)"
_MODELS = "[" + ", ".join(f"'{m}'" for m in [*(p[0] for p in fn.PRICES), "", "unknown-model"]) + "]"

SQL = {
    "description_lines": f"select conv_id, turn, line, cast(strlen(line) as integer) as bytes from (select conv_id, turn, {_CUT} as line from conversations)",
    "token_estimate": f"select doc_id, cast(strlen(text) as bigint) as bytes, {_EST.format('text')} as tokens, cast(floor(strlen(text) / 4.0) as bigint) as floor_tokens from documents",
    "savings_rows": f"select *, round(case when original > 0 then saved::double / original * 100 else 0 end, 6) as percent from {_SAVE}",
    "savings_by_server": f"select server, cast(sum(original) as bigint) as original, cast(sum(optimized) as bigint) as optimized, cast(sum(saved) as bigint) as saved from {_SAVE} group by server",
    "cumulative_savings": f"""select cast(sum(original) as bigint) as original, cast(sum(optimized) as bigint) as optimized, cast(sum(saved) as bigint) as saved,
 count(distinct server) as requests_processed, count(*) as requests from {_SAVE}""",
    "session_replay": """with t as (select conv_id, count(*) as prompts, count(distinct role) as servers from conversations group by conv_id)
 select conv_id, prompts, servers, cast(prompts * floor(servers * 2625 / 4.0) as bigint) as native_tokens, prompts * 185 as routed_tokens,
 round((prompts * floor(servers * 2625 / 4.0) - prompts * 185) / (prompts * floor(servers * 2625 / 4.0)) * 100, 6) as saved_percent from t""",
    "model_savings": f"""with t as (select ({_MODELS})[(conv_id % 7) + 1] as asked, cast(sum({_EST.format('text')}) as bigint) as tokens from conversations group by 1),
 p(model, i, c, o) as (values {_values(fn.PRICES)}), m as (select *, case when asked = '' then '{fn.DEFAULT_MODEL}' else asked end as model from t)
 select asked, m.model, tokens, round(case when i is null then 0 else tokens / 1000000.0::double * (i - c) end, 9) as dollars from m left join p on m.model = p.model""",
    "monthly_comparison": f"""with n as (select count(*) * 2625 - 158 as saved from supplier), r(provider, i, o) as (values {_values(fn.MONTHLY_RATES)})
 select provider, saved, round(floor(saved * 100 * 0.8::double) / 1e6 * i + floor(saved * 100 * 0.2::double) / 1e6 * o, 6) as savings_usd from n, r""",
    "prompt_cache_stats": f"""with t as (select *, {_EST.format('text')} as tokens, row_number() over (partition by text order by conv_id, turn) > 1 as hit from conversations)
 select count(*) as total, count(*) filter (role <> 'assistant') as matched, count(*) filter (role = 'system') as cacheable, count(*) filter (role <> 'assistant' and hit) as hits,
 count(*) filter (role <> 'assistant' and not hit) as misses, cast(sum(tokens) as bigint) as input_tokens, cast(coalesce(sum(tokens) filter (hit), 0) as bigint) as cached_tokens,
 round(coalesce(least(1.0, (count(*) filter (role <> 'assistant' and hit))::double / nullif(count(*) filter (role <> 'assistant'), 0)), 0), 6) as hit_rate from t""",
    "trust_scores": f"select p_partkey, score, {_LEVEL} as level, score < 40 as low_trust from {_TRUST}",
    "trust_levels": f"select {_LEVEL} as level, count(*) as entries, min(score) as least, max(score) as most from {_TRUST} group by 1",
    "budget_month_usage": f"select * from {_MONTH}",
    "budget_decision": f"""with u as (select *, length(team) * 1000000 as monthly, length(team) * 400000 as daily, greatest(0, length(team) * 400000 - floor(used / 2.0)) as remaining from {_MONTH}),
 p as (select *, 100.0::double - remaining::double / daily * 100 as d, used::double / monthly * 100 as m from u)
 select team, month, used, case when team = 'MACHINERY' then 'allow' when remaining <= 0 or used >= monthly then 'reject' when team like 'A%' and (d >= 90 or m >= 90) then 'reject'
 when d >= 90 or m >= 90 then 'downgrade' else 'allow' end as action, case when remaining <= 0 then 100 else d end as daily_pct,
 case when used >= monthly and remaining > 0 then 100 else m end as monthly_pct from p""",
    "number_texts": """with t as (select c_custkey, cast(floor(abs(c_acctbal) * c_custkey) as bigint) as n from customer) select c_custkey, n,
 case when n >= 1000000 then printf('%.1fM', n / 1e6) when n >= 1000 then printf('%.1fK', n / 1e3) else cast(n as varchar) end as short from t""",
}
