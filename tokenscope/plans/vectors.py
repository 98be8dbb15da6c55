"""Vector queries: top-k, semantic cache, upsert and eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenscope.operators import vectors as op
from tokenscope.operators.vectorstore import VectorStore
from tokenscope.sources.tables import table


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") % 3).alias("tool"))


def queries_(s, d):
    return vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


def vector_topk(s, d):
    return op.top_k(queries_(s, d).where("qid = 0"), vectors(s, d), 10).select("id", F.round("score", 6).alias("score"))


def vector_topk_per_query(s, d):
    return op.top_k(queries_(s, d), vectors(s, d), 5).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def vector_store_search(s, d):
    """A store in which each seventh vector was replaced by its opposite and each fifth deleted, asked for the nearest ten."""
    v = vectors(s, d).select("id", "vector")
    opposite = v.where("id % 7 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"))
    store = VectorStore.build(v, 64).upsert(opposite).delete(v.where("id % 5 = 3").select("id"))
    return store.search(_asked(v), 10).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def vector_store_matches(s, d):
    """All vectors with a cosine of 0.3 or more, 50 at most for each query."""
    v = vectors(s, d).select("id", "vector")
    return VectorStore.build(v, 64).search(_asked(v), 50, at_least=0.3).select("qid", "id", F.round("score", 6).alias("score"))


def _asked(v):
    return v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vector")


def _requests(s, d):
    """Each tenth vector with its first component changed, as a request: some keys are known, some entries old."""
    v = vectors(s, d).where("id % 10 = 0")
    bent = F.transform("vector", lambda x, i: F.when(i == 0, x * F.lit(1.5).cast("float")).otherwise(x))
    key = F.when(F.col("id") % 40 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("new"), F.col("id").cast("string")))
    return v.select(F.col("id").alias("qid"), key.alias("key"), F.when(F.col("id") % 30 == 0, (F.col("tool") + 1) % 3).otherwise(F.col("tool")).alias("tool"), bent.alias("vector"), F.lit(10).alias("day"))


def _entries(s, d):
    return vectors(s, d).select("id", F.col("id").cast("string").alias("key"), "tool", F.when(F.col("id") % 80 == 0, 5).when(F.col("id") % 70 == 0, 8).otherwise(9).alias("day"))


def semantic_cache_hits(s, d):
    out = op.semantic_hits(_requests(s, d), _entries(s, d), vectors(s, d))
    return out.select("qid", "kind", "id", F.round("score", 6).alias("score"))


def semantic_cache_hits_filtered(s, d):
    out = op.semantic_hits(_requests(s, d), _entries(s, d), vectors(s, d), filter_first=True)
    return out.select("qid", "kind", "id", F.round("score", 6).alias("score"))


def semantic_cache_stats(s, d):
    return op.cache_stats(op.semantic_hits(_requests(s, d), _entries(s, d), vectors(s, d)))


def _versions(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit(1).alias("version"))


def vector_upsert(s, d):
    """Every third vector is written again with another label, and new ones come in."""
    old = _versions(s, d)
    new = old.where("id % 3 = 0").select("id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    more = old.where("id % 7 = 0").select((F.col("id") + 1_000_000).alias("id"), "label", F.lit(2).alias("version"))
    return op.upsert(old, new.union(more))


def vector_delete(s, d):
    return op.delete(_versions(s, d), _versions(s, d).where("id % 4 = 0").select("id")).select("id", "label")


def lru_keep(s, d):
    e = table(s, d, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last_used"))
    return op.keep_recent(e, "event_type", "last_used", "user_id", 100).select("event_type", "user_id", F.col("rank").cast("int").alias("rank"))


def running_similarity(s, d):
    e = table(s, d, "events").select("event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return e.select("event_id", op.running_mean(e, "event_type", "event_id", "cents").alias("mean"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_per_query, vector_store_search, vector_store_matches, semantic_cache_hits, semantic_cache_hits_filtered, semantic_cache_stats, vector_upsert, vector_delete, lru_keep, running_similarity)}

_V = "(select vec_id as id, embedding::double[] as vector, label % 3 as tool from embeddings)"
_COS = "list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector)))"


def _top(where: str, k: int) -> str:
    return f"""select * from (select a.id as qid, b.id, {_COS} as score, row_number() over (partition by a.id order by {_COS} desc, b.id) as rank from {_V} a, {_V} b where {where}) where rank <= {k}"""


_STORED = "(select id, case when id % 7 = 0 then list_transform(vector, lambda x: -x) else vector end as vector from {0} where id % 5 <> 3)".format(_V)


def _cache(filtered: bool) -> str:
    ranked = "row_number() over (partition by qid order by {0} desc, b.id)".format(_COS)
    return f"""with q as (select id as qid, case when id % 40 = 0 then cast(id as varchar) else 'new' || cast(id as varchar) end as key, case when id % 30 = 0 then (tool + 1) % 3 else tool end as tool,
 list_transform(embedding, lambda x, i: case when i = 1 then (x * 1.5::float)::float else x end)::double[] as vector from (select vec_id as id, label % 3 as tool, embedding from embeddings) where id % 10 = 0),
 e as (select id, cast(id as varchar) as key, tool, vector, case when id % 80 = 0 then 5 when id % 70 = 0 then 8 else 9 end as day from {_V}),
 x as (select qid, case when e.id is null then null when 10 - e.day <= 1 then 'exact' else 'stale' end as kind, e.id, 1.0::double as score from q left join e on q.key = e.key),
 r as (select qid, b.id, {_COS} as score, {ranked} as rank, a.tool, b.tool as etool, b.day from q a, e b where qid in (select qid from x where kind is null) {"and a.tool = b.tool" if filtered else ""}),
 g as (select qid, min_by(id, rank) as id, min_by(score, rank) as score from r where rank <= 5 and tool = etool and score >= 0.92 and 10 - day <= 1 group by qid)
 select qid, kind, id, round(score, 6) as score from x where kind is not null union all
 select x.qid, case when g.id is null then 'miss' else 'semantic' end, g.id, round(g.score, 6) from x left join g on x.qid = g.qid where kind is null"""


SQL = {
    "vector_topk": f"select id, round(score, 6) as score from ({_top('a.id = 0', 10)})",
    "vector_topk_per_query": f"select qid, id, round(score, 6) as score, cast(rank as integer) as rank from ({_top('a.id % 50 = 0', 5)})",
    "semantic_cache_hits": _cache(False),
    "semantic_cache_hits_filtered": _cache(True),
    "semantic_cache_stats": f"""select count(*) as total, count(*) filter (kind = 'exact') as exact, count(*) filter (kind = 'semantic') as semantic, count(*) filter (kind in ('miss', 'stale')) as misses,
 count(*) filter (kind = 'stale') as evicted, round(count(*) filter (kind in ('exact', 'semantic')) * 100.0::double / count(*), 6) as hit_rate,
 round(coalesce(avg(score) filter (kind = 'semantic'), 0), 6) as mean_similarity from ({_cache(False).replace("round(score, 6) as score from x", "score from x").replace("round(g.score, 6)", "g.score")})""",
    "vector_store_search": f"""select qid, id, round(score, 6) as score, cast(rank as integer) as rank from (select a.id as qid, b.id, {_COS} as score, row_number() over (partition by a.id order by {_COS} desc, b.id) as rank
 from {_V} a, {_STORED} b where a.id % 100 = 0) where rank <= 10""",
    "vector_store_matches": f"select qid, id, round(score, 6) as score from ({_top('a.id % 100 = 0', 50)}) where score >= 0.3",
    "vector_upsert": """select vec_id as id, case when vec_id % 3 = 0 then label + 100 else label end as label, case when vec_id % 3 = 0 then 2 else 1 end as version from embeddings
 union all select vec_id + 1000000, label, 2 from embeddings where vec_id % 7 = 0""",
    "vector_delete": "select vec_id as id, label from embeddings where vec_id % 4 <> 0",
    "lru_keep": """select event_type, user_id, cast(rank as integer) as rank from (select event_type, user_id, row_number() over (partition by event_type order by max(ts) desc, user_id) as rank
 from events group by event_type, user_id) where rank <= 100""",
    "running_similarity": "select event_id, cast(sum(cast(round(value * 100) as bigint)) over w as double) / count(*) over w as mean from events window w as (partition by event_type order by event_id rows unbounded preceding)",
}
