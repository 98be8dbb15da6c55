"""Catalogue queries: search, routing, matching, sets and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tokenscope.operators import catalog as op
from tokenscope.sources.tables import table


def tools(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(
        "p_partkey", F.concat(F.lit("tool_"), (k % 700).cast("string")).alias("tool"), F.lower("p_brand").alias("namespace"), (k * 7 % 120 + 1).alias("server"), F.col("p_name").alias("description"), F.col("p_size").alias("size")
    )


def servers(s, d):
    k = F.col("s_suppkey")
    health = F.element_at(F.array(*map(F.lit, ["healthy", "degraded", "unhealthy", "unknown"])), (k % 4 + 1).cast("int"))
    caps = F.filter(F.array(*map(F.lit, ["read", "write", "list", "admin"])), lambda x, i: F.shiftright(k.cast("int"), 0).bitwiseAND(F.lit(1) * F.pow(F.lit(2), i).cast("int")) > 0)
    return table(s, d, "supplier").select(
        k.alias("server"), F.col("s_name").alias("name"), health.alias("health"), caps.alias("capabilities"), F.when(k % 3 == 0, "http").otherwise("stdio").alias("transport"),
        (k % 10 / 10.0).alias("load"), (k * 37 % 1000).alias("requests"), (k % 3).alias("tier"),
    )


def methods(s, d):
    e = F.col("event_id")
    name = F.concat(F.lit("brand#"), (e % 6 * 10 + e % 5 + 1).cast("string"), F.lit(".tool_"), (e % 800).cast("string"))
    return table(s, d, "events").select("event_id", F.when(e % 97 == 0, F.repeat(F.lit("x"), 101)).when(e % 89 == 0, F.lit("nodot")).otherwise(name).alias("method"))


PATTERNS = (("first", "example.net"), ("second", "example.com"), ("third", "tionsh.example.net"))


def server_tool_counts(s, d):
    return op.left_counts(servers(s, d).select("server", "name"), tools(s, d), "server", "tools")


def route_methods(s, d):
    return op.route(methods(s, d), tools(s, d))


def ambiguous_tools(s, d):
    return tools(s, d).groupBy("tool").agg(F.count_distinct("server").alias("n_servers"), F.min("server").alias("first_server")).where("n_servers > 1")


def resolve_tools(s, d):
    """One request per server: a tool of its own by equal name, or by the name behind a dot; the first by name wins."""
    asked = servers(s, d).select("server", F.concat(F.lit("tool_"), ((F.col("server") - 1) * 103 % 120).cast("string")).alias("asked"))
    return op.resolve(asked, tools(s, d).withColumn("tool", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ns."), "tool")).otherwise(F.col("tool"))))


def tier_models(s, d):
    """Tool to server to tier to model; an invalid tier gets the default model."""
    models = s.createDataFrame([(0, "small"), (1, "medium")], "tier long, model string")
    return tools(s, d).join(servers(s, d).select("server", "tier"), "server").join(F.broadcast(models), "tier", "left").select("p_partkey", F.coalesce("model", F.lit("medium")).alias("model"))


def provider_match(s, d):
    return op.match_hosts(table(s, d, "pages"), PATTERNS)


def best_server(s, d):
    return op.best_server(servers(s, d), ["read", "write"], max_load=0.8, transport="stdio")


def capability_division(s, d):
    return op.with_all(servers(s, d), ["read", "list"]).select("server", "name")


def capability_index(s, d):
    return servers(s, d).select("server", F.explode("capabilities").alias("capability")).groupBy("capability").agg(F.count(F.lit(1)).alias("servers"))


def unhealthy_servers(s, d):
    return servers(s, d).where(F.col("health").isin("unhealthy", "unknown")).select("server", "health")


def namespaces(s, d):
    """full_name, parent, server rows of a two-level tree."""
    region, nation, supplier = table(s, d, "region"), table(s, d, "nation"), table(s, d, "supplier")
    roots = region.select(F.col("r_name").alias("full_name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("server"))
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return roots.union(joined.select(F.concat("r_name", F.lit("."), "n_name"), "r_name", "s_suppkey"))


def namespace_flatten(s, d):
    return op.flatten(namespaces(s, d))


def namespace_servers(s, d):
    """Distinct servers of each namespace and of its descendants."""
    return op.namespace_servers(namespaces(s, d))


def fuzzy_names(s, d):
    asked = s.createDataFrame([("FRENCH",), ("JAPPAN",), ("kenia",), ("china",)], "asked string")
    return op.nearest(asked, table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos")), 3)


def catalog_search(s, d):
    return op.contains_search(tools(s, d), "Brand#2", "tool", "namespace").select("p_partkey")


def all_words_search(s, d):
    line = F.concat(F.lower("namespace"), F.lit("_"), "tool", F.lit(": "), F.col("description"))
    return tools(s, d).where(op.all_words(line, "BRAND#1 tool_6")).select("p_partkey")


def scored_search(s, d):
    return op.scored_search(tools(s, d), "tool_69").select("p_partkey", "score", "match_on")


def marketplace_search(s, d):
    found = op.contains_search(tools(s, d), "1", "tool", "description").orderBy("p_partkey").limit(25)
    return found.select("p_partkey", "tool")


def search_by_server(s, d):
    return op.contains_search(tools(s, d), "tool_1", "tool", "description").groupBy("server").agg(F.count(F.lit(1)).alias("matches"))


ENDS = (": Rate Limited", ": TIMEOUT after 3s", " fine", ": Tool not found", ": key Not Found", ": Connection refused", " Failed: 500", ": invalid params", " is not running")


def error_hints(s, d):
    """Each call's message with its context, and the advised action; every event of the table twice, as a log may repeat itself."""
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("event_id") % len(ENDS) + 1).cast("int"))
    rows = table(s, d, "events").select("event_id", F.concat(F.lit("Call "), "event_type", end).alias("message"), F.when(F.col("event_id") % 2 == 0, "srv").otherwise("").alias("server"))
    rows = rows.union(rows)
    return rows.select("event_id", op.hint(F.col("message")).alias("action"), op.with_context(F.col("message"), F.col("server"), F.lit("")).alias("message"))


def layered_override(s, d):
    """Layers of settings per customer segment: the last layer with a value wins, setting by setting."""
    c = table(s, d, "customer")
    layers = c.select(F.col("c_mktsegment").alias("key"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey")).alias("b"))
    return op.override(layers, "key", "c_custkey", ["a", "b"])


def key_glob(s, d):
    return table(s, d, "customer").where(F.col("c_name").rlike(op.glob_regex("Customer#*1?"))).agg(F.count(F.lit(1)).alias("keys"), F.min("c_name").alias("first"))


def key_exists(s, d):
    asked = s.createDataFrame([(1,), (1,), (5,), (10**9,)], "k long")
    return asked.join(table(s, d, "customer"), F.col("k") == F.col("c_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("found"))


def key_lookup(s, d):
    asked = s.createDataFrame([(1,), (10**9,)], "k long")
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return asked.join(c, F.col("k") == F.col("c_custkey"), "left").select("k", F.col("c_name").alias("value"), F.col("c_custkey").isNotNull().alias("found"))


def purge_tool(s, d):
    return op.purge(tools(s, d), "tool", ["tool_1", "tool_2"]).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def pattern_override(s, d):
    """A name defined again replaces its definition in place: least position, last definition."""
    rows = table(s, d, "part").select((F.col("p_partkey") % 50).alias("name"), F.col("p_partkey").alias("seq"), "p_type")
    return op.replace_by_name(rows, "name", "seq", "p_type")


def first_definition(s, d):
    rows = table(s, d, "part").select((F.col("p_partkey") % 50).alias("name"), F.col("p_partkey").alias("seq"), "p_type")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("seq"))).where("rn = 1").drop("rn")


def access_allowed(s, d):
    clients = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("*"))).otherwise(F.array("p_brand"))
    return table(s, d, "part").where(op.allowed(clients, F.lit("Brand#11"))).agg(F.count(F.lit(1)).alias("n"))


def transports(s, d):
    raw = F.element_at(F.array(*map(F.lit, [" STDIO", "Http ", "streamable-http", "sse", ""])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(s, d, "supplier").select("s_suppkey", op.transport(raw).alias("transport"))


def table_columns(s, d):
    """Columns of a table in their order: name, type, whether it may be null."""
    return op.describe(table(s, d, "orders"))


def union_sources(s, d):
    """Counts by source of two scans with different columns."""
    a = table(s, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.lit("stdio").alias("transport"))
    b = table(s, d, "nation").select(F.lit("nation").alias("source"), F.col("n_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source", F.coalesce("transport", F.lit("")).alias("transport")).agg(F.count(F.lit(1)).alias("n"))


KINDS = ("stdio", "http", "sse", "", "ftp")


def config_errors(s, d):
    """The first broken rule of each supplier's settings: every 11th has no name, every 7th no command or url, every 5th of the rest an odd url."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int"))
    value = lambda good: F.when(k % 7 == 0, "").when(k % 9 == 0, "nowhere").otherwise(good)
    rows = table(s, d, "supplier").select(
        k.alias("server"),
        F.when(k % 11 == 0, "").otherwise(F.col("s_name")).alias("name"),
        kind.alias("transport"),
        F.when(k % 13 != 0, F.struct(value(F.lit("npx")).alias("command"))).alias("stdio"),
        F.when(k % 13 != 0, F.struct(value(F.lit("https://example.com")).alias("url"))).alias("http"),
    )
    error = op.config_error(F.col("name"), F.col("transport"), F.col("stdio"), F.col("http"))
    return rows.select("server", error.alias("e")).where("e is not null").select("server", "e.*")


QUERIES = {
    f.__name__: f
    for f in (
        server_tool_counts, route_methods, ambiguous_tools, resolve_tools, tier_models, provider_match, best_server, capability_division, capability_index, unhealthy_servers, namespace_flatten,
        namespace_servers, fuzzy_names, catalog_search, all_words_search, scored_search, marketplace_search, search_by_server, error_hints, layered_override, key_glob, key_exists, key_lookup,
        purge_tool, pattern_override, first_definition, access_allowed, transports, table_columns, union_sources, config_errors,
    )
}

_TOOLS = "(select p_partkey, 'tool_' || cast(p_partkey % 700 as varchar) as tool, lower(p_brand) as namespace, p_partkey * 7 % 120 + 1 as server, p_name as description, p_size as size from part)"
_SERVERS = """(select s_suppkey as server, s_name as name, (['healthy', 'degraded', 'unhealthy', 'unknown'])[s_suppkey % 4 + 1] as health, s_suppkey & 1 > 0 as r, s_suppkey & 2 > 0 as w,
 s_suppkey & 4 > 0 as l, s_suppkey & 8 > 0 as a, case when s_suppkey % 3 = 0 then 'http' else 'stdio' end as transport, (s_suppkey % 10) / 10.0::double as load, s_suppkey * 37 % 1000 as requests, s_suppkey % 3 as tier from supplier)"""
_METHODS = """(select event_id, case when event_id % 97 = 0 then repeat('x', 101) when event_id % 89 = 0 then 'nodot'
 else 'brand#' || cast(event_id % 6 * 10 + event_id % 5 + 1 as varchar) || '.tool_' || cast(event_id % 800 as varchar) end as method from events)"""
_NS = """(select r_name as full_name, null as parent, null::bigint as server from region union all select r_name || '.' || n_name, r_name, s_suppkey from nation join region on n_regionkey = r_regionkey
 left join supplier on s_nationkey = n_nationkey)"""

SQL = {
    "server_tool_counts": f"select s.server, name, count(t.p_partkey) as tools from {_SERVERS} s left join {_TOOLS} t on s.server = t.server group by all",
    "route_methods": f"""with k as (select namespace || '.' || tool as method, min(server) as server, count(distinct server) as n from {_TOOLS} group by 1)
 select event_id, m.method, case when length(m.method) > 100 or strpos(m.method, '.') = 0 then 'invalid' when n is null then 'not_found' when n > 1 then 'ambiguous' else 'ok' end as status,
 case when n = 1 then server end as server from {_METHODS} m left join k on m.method = k.method""",
    "ambiguous_tools": f"select tool, count(distinct server) as n_servers, min(server) as first_server from {_TOOLS} group by tool having count(distinct server) > 1",
    "resolve_tools": f"""with a as (select server, 'tool_' || cast((server - 1) * 103 % 120 as varchar) as asked from {_SERVERS}),
 t as (select p_partkey, server, case when p_partkey % 2 = 0 then 'ns.' || tool else tool end as tool from {_TOOLS})
 select a.server, asked, min(tool) as tool from a join t on a.server = t.server and (tool = asked or ends_with(tool, '.' || asked)) group by all""",
    "tier_models": f"select p_partkey, case tier when 0 then 'small' else 'medium' end as model from {_TOOLS} t join {_SERVERS} s on t.server = s.server",
    "provider_match": """with h as (select page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host from pages), p(ord, provider, ph) as (values (0, 'first', 'example.net'), (1, 'second', 'example.com'),
 (2, 'third', 'tionsh.example.net')) select page_id, host, coalesce(min_by(provider, ord), 'other') as provider from h left join p on host = ph or ends_with(host, '.' || ph) group by page_id, host""",
    "best_server": f"""select server, round(1 - load + case when health = 'healthy' then 0.5 else 0 end + requests * 0.0001, 6) as score from {_SERVERS} where r and w and load <= 0.8 and transport = 'stdio'
 order by score desc, server limit 1""",
    "capability_division": f"select server, name from {_SERVERS} where r and l",
    "capability_index": f"""select * from (select 'read' as capability, count(*) filter (r) as servers from {_SERVERS} union all select 'write', count(*) filter (w) from {_SERVERS}
 union all select 'list', count(*) filter (l) from {_SERVERS} union all select 'admin', count(*) filter (a) from {_SERVERS}) where servers > 0""",
    "unhealthy_servers": f"select server, health from {_SERVERS} where health in ('unhealthy', 'unknown')",
    "namespace_flatten": f"""with recursive n as (select distinct full_name, parent from {_NS}), t as (select full_name, parent, 0 as depth from n where parent is null union all
 select n.full_name, n.parent, depth + 1 from n join t on n.parent = t.full_name) select full_name, coalesce(parent, '') as parent, depth, (select count(*) from n where n.parent = t.full_name) as children from t""",
    "namespace_servers": f"select full_name, count(distinct s) as servers from (select full_name, server as s from {_NS} union all select parent, server from {_NS} where parent is not null) group by full_name",
    "fuzzy_names": """with a(asked) as (values ('FRENCH'), ('JAPPAN'), ('kenia'), ('china')), r as (select asked, n_name as name, levenshtein(lower(asked), lower(n_name)) as distance, row_number() over
 (partition by asked order by levenshtein(lower(asked), lower(n_name)), n_nationkey) as rn from a, nation where lower(asked) <> lower(n_name)) select asked, name, cast(distance as integer) as distance from r where rn <= 3""",
    "catalog_search": f"select p_partkey from {_TOOLS} where contains(lower(tool), 'brand#2') or contains(lower(namespace), 'brand#2')",
    "all_words_search": f"select p_partkey from (select p_partkey, lower(namespace || '_' || tool || ': ' || description) as x from {_TOOLS}) where contains(x, 'brand#1') and contains(x, 'tool_6')",
    "scored_search": f"select p_partkey, case when tool = 'tool_69' then 100 else 50 end as score, case when tool = 'tool_69' then 'exact' else 'contains' end as match_on from {_TOOLS} where contains(tool, 'tool_69')",
    "marketplace_search": f"select p_partkey, tool from {_TOOLS} where contains(tool, '1') or contains(lower(description), '1') order by p_partkey limit 25",
    "search_by_server": f"select server, count(*) as matches from {_TOOLS} where contains(tool, 'tool_1') or contains(lower(description), 'tool_1') group by server",
    "error_hints": f"""with h(ord, p, action) as (values {', '.join(f"({i}, '{p}', '{a}')" for i, (p, a) in enumerate(op.HINTS))}),
 m as (select event_id, 'Call ' || event_type || ({list(ENDS)})[event_id % {len(ENDS)} + 1] as message from events),
 f as (select event_id, message, coalesce((select arg_max(action, length(p) * 100 - ord) from h where contains(lower(message), p)), 'none') as action from m)
 select event_id, action, case when event_id % 2 = 0 then message || chr(10) || chr(10) || '📋 Context:' || chr(10) || '  Server: srv' else message end as message from f, (values (1), (2)) twice(t)""",
    "layered_override": """select c_mktsegment as key, max_by(c_name, c_custkey) filter (c_custkey % 3 = 0) as a, max_by(c_nationkey, c_custkey) filter (c_custkey % 7 = 0) as b from customer group by 1""",
    "key_glob": "select count(*) as keys, min(c_name) as first from customer where c_name glob 'Customer#*1?'",
    "key_exists": "select count(*) as found from (values (1), (1), (5), (1000000000)) t(k) where k in (select c_custkey from customer)",
    "key_lookup": "select cast(k as bigint) as k, c_name as value, c_custkey is not null as found from (values (1), (1000000000)) t(k) left join customer on k = c_custkey",
    "purge_tool": f"select namespace, count(*) as n from {_TOOLS} where tool not in ('tool_1', 'tool_2') group by namespace",
    "pattern_override": "select p_partkey % 50 as name, min(p_partkey) as seq, max_by(p_type, p_partkey) as p_type from part group by 1",
    "first_definition": "select p_partkey % 50 as name, min(p_partkey) as seq, min_by(p_type, p_partkey) as p_type from part group by 1",
    "access_allowed": "select count(*) as n from part where p_size % 3 <> 2 or p_brand = 'Brand#11'",
    "transports": "select s_suppkey, (['stdio', 'http', 'http', 'sse', 'stdio'])[s_suppkey % 5 + 1] as transport from supplier",
    "table_columns": """select cast(row_number() over (order by column_index) - 1 as integer) as ord, column_name as name, case data_type when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else lower(data_type) end as type,
 is_nullable as nullable from duckdb_columns() where table_name = 'orders'""",
    "union_sources": "select 'supplier' as source, 'stdio' as transport, count(*) as n from supplier union all select 'nation', '', count(*) from nation",
    "config_errors": """with t as (select s_suppkey as k, (['stdio', 'http', 'sse', '', 'ftp'])[s_suppkey % 5 + 1] as kind, s_suppkey % 13 = 0 as bare, case when s_suppkey % 7 = 0 then '' when s_suppkey % 9 = 0 then 'nowhere' else 'ok' end as v from supplier)
 select k as server, split_part(e, '@', 1) as field, split_part(e, '@', 2) as message from (select k, case when k % 11 = 0 then 'name@name is required' when kind = '' then 'transport@transport type is required'
 when kind = 'ftp' then 'transport@invalid transport ' || chr(39) || 'ftp' || chr(39) || '. Must be stdio, http, or sse' when kind = 'stdio' and bare then 'stdio@stdio configuration is required for stdio transport'
 when kind = 'stdio' and v = '' then 'command@command is required for stdio transport' when kind = 'stdio' then null when bare then 'http@http configuration is required for ' || kind || ' transport'
 when v = '' then 'url@url is required for http/sse transport' when v = 'nowhere' then 'url@invalid URL format: ' || chr(39) || v || chr(39) end as e from t) where e is not null""",
}
