"""Vectors: cosine, top-k, upsert, delete, and the semantic cache over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tokenscope.operators.vectorstore import best_pairs, matrix

# Similarity threshold and candidates of the semantic cache.
THRESHOLD, CANDIDATES = 0.92, 5
#: Queries and vectors of one group at most, and vectors under which more groups are not worth while.
MAX_QUERY_ROWS, MAX_VECTOR_ROWS, MIN_VECTOR_ROWS = 16_384, 32_768, 4096


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in doubles; 0 for empty vectors, unequal lengths and zero norms. Norms may be given, so that they are found once per row."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.when(fits, _dot(a, b) / n).otherwise(0.0)


def to_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in values.to_pylist()], type=pa.binary())

    return pack(vector)


def from_bytes(data: Column) -> Column:
    """The vector of to_bytes; null for a number of bytes that is no multiple of four."""

    @F.arrow_udf("array<float>")
    def unpack(values: pa.Array) -> pa.Array:
        return pa.array([None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4").tolist() for b in values.to_pylist()], type=pa.list_(pa.float32()))

    return unpack(data)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, same: str | None = None, at_least: float | None = None) -> DataFrame:
    """The k best vectors of each query, of those with an equal column same and with a score of at_least or more if they are given; ties go by id.

    Vectors are dealt to parts of up to MAX_VECTOR_ROWS and queries to blocks of up to MAX_QUERY_ROWS by their ids' hashes. Each block meets each part in a
    group of its own, which sends its k best, so that no task's memory grows with the data.
    """
    k = k if k > 0 else 10
    key = F.lit(0) if same is None else F.col(same)
    q, v = queries.select("qid", F.col("vector").alias("asked"), key.alias("same")), vectors.select("id", "vector", key.alias("same"))
    wanted = F.lit(2 * queries.sparkSession.sparkContext.defaultParallelism)
    spread = F.least(F.ceil(F.col("n") / MIN_VECTOR_ROWS), wanted)
    counted = lambda rows: rows.groupBy("same").agg(F.count(F.lit(1)).alias("n"))
    parts = counted(v).select("same", F.greatest(F.ceil(F.col("n") / MAX_VECTOR_ROWS), spread).alias("parts"))
    blocks = counted(q).select("same", F.ceil(F.col("n") / MAX_QUERY_ROWS).alias("blocks"))
    # one row for each value of same
    split = F.broadcast(parts.join(blocks, "same"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = v.join(split, "same").select("same", F.pmod(F.xxhash64("id"), "parts").alias("part"), every("blocks").alias("block"), "id", "vector")
    asked = q.join(split, "same").select("same", every("parts").alias("part"), F.pmod(F.xxhash64("qid"), "blocks").alias("block"), "qid", "asked")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = pc.fill_null(pc.list_value_length(right.column("asked").combine_chunks()), 0).to_numpy(zero_copy_only=False)
        ids, stored, found = left.column("id").combine_chunks(), left.column("vector").combine_chunks(), [right.select(["qid"]).slice(0, 0)]
        found[0] = found[0].append_column("id", ids.slice(0, 0)).append_column("score", pa.array([], pa.float64()))
        for dims in np.unique(lengths):
            of_length = right.take(pa.array(np.flatnonzero(lengths == dims)))
            values, norms = matrix(of_length.column("asked").combine_chunks(), int(dims))
            floor = None if at_least is None else np.full(len(norms), float(at_least))
            at, places, scores = best_pairs(values, norms, *matrix(stored, int(dims)), ids, k, floor)
            found.append(pa.table({"qid": of_length.column("qid").take(at), "id": ids.take(places), "score": scores}))
        return pa.concat_tables(found)

    types = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    keys, best = ("same", "part", "block"), Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    pairs = own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, types)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def upsert(vectors: DataFrame, changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The latest version of each key."""
    both = vectors.unionByName(changes)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), version).alias("r")).select(key, "r.*")


def delete(vectors: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return vectors.join(keys, key, "left_anti")


def semantic_hits(requests: DataFrame, entries: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, ttl_days: int = 1, filter_first: bool = False) -> DataFrame:
    """One outcome per request: exact, stale, semantic or miss.

    requests have qid, key, tool, vector, day; entries id, key, tool, day. An equal key decides alone, even if stale. Else the best of the first CANDIDATES
    vectors over all tools counts if its entry has the tool, is in time and is similar enough; with filter_first only vectors of the tool are ranked.
    """
    exact = requests.join(entries.select(F.col("id").alias("eid"), "key", F.col("day").alias("eday")), "key", "left")
    exact = exact.withColumn("fresh", F.col("day") - F.col("eday") <= ttl_days)
    decided = exact.select("qid", F.when(F.col("eid").isNull(), None).when(F.col("fresh"), "exact").otherwise("stale").alias("kind"), F.col("eid").alias("id"), F.lit(1.0).alias("score"))
    open_ = requests.join(decided.where("kind is null").select("qid"), "qid", "left_semi")
    info = entries.select("id", F.col("tool").alias("etool"), F.col("day").alias("eday"))
    # candidates below the threshold decide nothing, so they are left out where pairs are scored
    if filter_first:
        own = vectors.select("id", "vector").join(entries.select("id", "tool"), "id")
        ranked = top_k(open_, own, CANDIDATES, "tool", threshold)
    else:
        ranked = top_k(open_, vectors, CANDIDATES, at_least=threshold)
    ranked = ranked.join(info, "id").join(open_.select("qid", "tool", "day"), "qid").where("tool = etool")
    good = ranked.where((F.col("score") >= threshold) & (F.col("day") - F.col("eday") <= ttl_days))
    hit = good.groupBy("qid").agg(F.min_by("id", "rank").alias("id"), F.min_by("score", "rank").alias("score"))
    semantic = open_.select("qid").join(hit, "qid", "left").select("qid", F.when(F.col("id").isNull(), "miss").otherwise("semantic").alias("kind"), "id", "score")
    return decided.where("kind is not null").unionByName(semantic)


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """Counts, hit rate in percent and mean similarity of semantic hits."""
    hits = F.count_if(F.col("kind").isin("exact", "semantic"))
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind") == "exact").alias("exact"),
        F.count_if(F.col("kind") == "semantic").alias("semantic"),
        F.count_if(F.col("kind").isin("miss", "stale")).alias("misses"),
        F.count_if(F.col("kind") == "stale").alias("evicted"),
        F.round(hits * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("hit_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("kind") == "semantic", F.col("score"))), F.lit(0.0)), 6).alias("mean_similarity"),
    )


def keep_recent(rows: DataFrame, owner: str, used: str, key: str, capacity: int) -> DataFrame:
    """The entries that a cache of the capacity still holds: the last used ones of each owner."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(used), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= capacity)


def running_mean(rows: DataFrame, owner: str, order: str, value: str) -> Column:
    """Mean of the values so far, in order."""
    frame = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(frame) / F.count(value).over(frame)
