"""Vector store: exact top-k by pivots and triangle-inequality bounds, with upsert, delete, save and load.

Unit vectors are compared by their angle, which is a metric. Up to MAX_PIVOTS pivots are fitted on a bounded sample (SAMPLE
rows in the order of their ids' hashes); every vector goes to the cell of its nearest pivot, and a cell knows its size and its
least and largest angle. A search scores each query against the nearest cells that hold k vectors, which bounds the k-th angle.
A further cell can hold a better vector only if its ring of angles and its side of the plane between its pivot and the query's
nearest one come within that bound, so only such cells are asked. Pruning never changes a result; how much it saves depends
on the data (nothing on vectors without clusters).

Cells are dealt to packs of up to CHUNK vectors; a query goes once to each pack in which it asks cells, with their numbers, and gets its k best
of the pack. Cells of over CHUNK vectors are split by id and packs asked by over BLOCK queries by query, so no group grows with the data. Only
pivots and the sizes of cells reach the driver. Vectors without an angle (null, empty, zero, not finite, of another length) have
cosine 0 with everything, as in operators.vectors; so have such queries. Equal vectors have equal scores, and ties go by
id. Vectors and queries are taken as 32-bit floats; ids and query ids are integers, each once, and rows without one are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_PIVOTS, SAMPLE, STEPS = 2048, 20_000, 4
CHUNK, BLOCK = 8192, 2048
#: Queries and vectors of one product, pairs that are scored at a time, rows that are compared with all pivots at a time.
PRODUCT, PAIRS, SLICE = (512, 4096), 32_768, 128
#: Angles are exact to some 1e-8 near 0; bounds give way by this much.
SLACK = 1e-6

_ROWS = "id long, vector array<float>, cell int, angle double"


def matrix(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in doubles, norms) of an Arrow list array; rows without an angle are zeros with norm 0."""
    out = np.zeros((len(vectors), dims))
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False))
    if dims and len(fits):
        # nulls become NaN
        out[fits] = pc.list_flatten(vectors.take(pa.array(fits))).to_numpy(zero_copy_only=False).reshape(len(fits), dims)
        out[~np.isfinite(out).all(axis=1)] = 0
    return out, np.sqrt((out * out).sum(axis=1))


def _no_copies(vectors: np.ndarray, cells: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of vectors by cell, without a cell's copies of one vector beyond its k first ids, which no query can need."""
    mixed = (vectors.view(np.uint64) * np.random.default_rng(0).integers(1, 2**63, vectors.shape[1], dtype=np.uint64)).sum(axis=1)
    order = np.lexsort((rank, mixed, cells))
    copy = np.zeros(len(order), bool)
    copy[1:] = (mixed[order[1:]] == mixed[order[:-1]]) & (cells[order[1:]] == cells[order[:-1]])
    at = np.flatnonzero(copy)
    copy[at] = (vectors[order[at]] == vectors[order[at - 1]]).all(axis=1)
    places = np.arange(len(order))
    return order[places - np.maximum.accumulate(np.where(copy, 0, places)) < k]


class _Best:
    """The k best vectors so far of some queries."""

    def __init__(self, rows: int, k: int, floor: np.ndarray) -> None:
        self.k, self.least = k, floor
        self.scores, self.ranks, self.places = np.full((rows, k), -np.inf), np.zeros((rows, k), np.int64), np.zeros((rows, k), np.int64)

    def add(self, asked: np.ndarray, places: np.ndarray, ranks: np.ndarray, scores: np.ndarray) -> None:
        """Pairs in the order of their queries."""
        rows = np.unique(asked)
        q = np.concatenate([np.repeat(rows, self.k), asked])
        s, r, p = (np.concatenate([old[rows].ravel(), new]) for old, new in ((self.scores, scores), (self.ranks, ranks), (self.places, places)))
        order = np.lexsort((r, -s, q))
        starts = np.searchsorted(q[order], rows)
        first = order[starts[:, None] + np.arange(self.k)]
        self.scores[rows], self.ranks[rows], self.places[rows] = s[first], r[first], p[first]
        self.least[rows] = np.maximum(self.least[rows], self.scores[rows, -1])


def best_pairs(
    queries: np.ndarray, query_norms: np.ndarray, vectors: np.ndarray, norms: np.ndarray, ids: pa.Array, k: int,
    floor: np.ndarray | None = None, cells: np.ndarray | None = None, asked: np.ndarray | None = None,
) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(places of queries, places of vectors, scores) of each query's k best vectors, of those with a score of its floor or more.

    With cells (by vector) and asked (by query and cell) a query is held against the cells it asks. Products of PRODUCT queries and vectors at a time, in
    32 bits, find what may be among the best; the scores of that are summed row by row in doubles, so that equal vectors have equal ones.
    """
    rank = np.empty(len(norms), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(norms))
    cells = np.zeros(len(norms), np.int64) if cells is None else cells
    kept = _no_copies(vectors, cells, rank, k)
    bounds = np.flatnonzero(np.diff(cells[kept], prepend=-1, append=-1)) if len(kept) else []
    units = (vectors[kept] / np.maximum(norms[kept], 1e-300)[:, None]).astype(np.float32)
    slack = (vectors.shape[1] + 8) * 2.4e-7
    out = []
    for start in range(0, len(query_norms), PRODUCT[0]):
        q, n = queries[start : start + PRODUCT[0]], query_norms[start : start + PRODUCT[0]]
        unit = (q / np.maximum(n, 1e-300)[:, None]).astype(np.float32)
        best = _Best(len(n), k, np.full(len(n), -np.inf) if floor is None else floor[start : start + len(n)].copy())
        for low, high in zip(bounds[:-1], bounds[1:]):
            rows = np.arange(len(n)) if asked is None else np.flatnonzero(asked[start : start + len(n), cells[kept[low]]])
            for left in range(low, high, PRODUCT[1]) if len(rows) else ():
                near = unit[rows] @ units[left : min(left + PRODUCT[1], high)].T
                least = best.least[rows] - slack
                good = near >= least[:, None]
                many = np.flatnonzero(good.sum(axis=1) > 2 * k)
                if len(many):
                    at = near.shape[1] - k
                    least = np.maximum(least[many], np.partition(near[many], at, axis=1)[:, at] - 2 * slack)
                    good[many] = near[many] >= least[:, None]
                of, at = np.nonzero(good)
                for i in range(0, len(of), PAIRS):
                    own, places = rows[of[i : i + PAIRS]], kept[left + at[i : i + PAIRS]]
                    scale = n[own] * norms[places]
                    scores = np.divide((vectors[places] * q[own]).sum(axis=1), scale, out=np.zeros(len(own)), where=scale > 0)
                    high_enough = scores >= best.least[own]
                    if high_enough.any():
                        best.add(own[high_enough], places[high_enough], rank[places[high_enough]], scores[high_enough])
        of, at = np.nonzero(best.scores > -np.inf)
        out.append((start + of, best.places[of, at], best.scores[of, at]))
    found = [np.concatenate(x) for x in zip(*out)] or [np.empty(0)] * 3
    return pa.array(found[0], type=pa.int64()), pa.array(found[1], type=pa.int64()), pa.array(found[2], type=pa.float64())


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centres of unit vectors: the first ones of the sample, moved STEPS times to the mean direction of what is nearest to them."""
    pivots = sample[:count].copy()
    if not len(pivots):
        return pivots
    for _ in range(STEPS):
        near = np.concatenate([(sample[i : i + SLICE] @ pivots.T).argmax(axis=1) for i in range(0, len(sample), SLICE)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        moved = norms > 1e-9
        pivots[moved] = sums[moved] / norms[moved, None]
    return pivots


@dataclass
class Cells:
    """Pivots with their cells' sizes and rings of angles."""

    pivots: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.pivots.T, -1, 1))

    def least_angles(self, unit: np.ndarray) -> np.ndarray:
        """By query and cell an angle under which no vector of the cell can be; infinite for empty cells."""
        own = self.angles(unit)
        ring = np.maximum(self.low[None, :] - own, own - self.high[None, :])
        nearest = own.argmin(axis=1)
        cosines = unit @ self.pivots.T
        apart = np.sqrt(np.maximum(2 - 2 * (self.pivots[nearest] @ self.pivots.T), 0))
        gap = cosines[np.arange(len(unit)), nearest][:, None] - cosines
        plane = np.arcsin(np.clip(np.divide(gap, apart, out=np.zeros_like(gap), where=apart > 1e-6), 0, 1))
        return np.where(self.sizes[None, :] > 0, np.maximum(ring, plane) - SLACK, np.inf)

    def seeds(self, unit: np.ndarray, k: int) -> list[np.ndarray]:
        """By query the nearest cells that hold k vectors together."""
        order = self.angles(unit).argsort(axis=1, kind="stable")
        held = self.sizes[order]
        before = np.cumsum(held, axis=1) - held
        return [o[(h > 0) & (b < k)] for o, h, b in zip(order, held, before)]


    def packs(self) -> np.ndarray:
        """By cell the number of its pack: cells in their order up to CHUNK vectors; a larger cell is a pack of its own."""
        out, pack, held = np.zeros(len(self.sizes), np.int32), 0, 0
        for cell, size in enumerate(self.sizes):
            if held and held + size > CHUNK:
                pack, held = pack + 1, 0
            out[cell], held = pack, held + size
        return out


@dataclass
class VectorStore:
    """rows: id, vector, cell, angle (cell null for vectors without an angle); pivots; dims."""

    rows: DataFrame
    pivots: np.ndarray
    dims: int

    @classmethod
    def build(cls, vectors: DataFrame, dims: int, pivots: int | None = None) -> VectorStore:
        """A store of id and vector. By default as many pivots as four roots of the number of rows, MAX_PIVOTS at most."""
        vectors = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<float>")).where("id is not null")
        wanted = pivots or int(4 * max(vectors.count(), 1) ** 0.5)
        sample = vectors.where(F.size("vector") == dims).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        found, norms = matrix(sample.column("vector").combine_chunks(), dims)
        unit = np.unique((found / np.maximum(norms, 1e-300)[:, None])[norms > 0], axis=0)
        unit = unit[np.random.default_rng(0).permutation(len(unit))]
        store = cls(vectors, fit_pivots(unit, min(wanted, MAX_PIVOTS)), dims)
        store.rows = store._placed(vectors)
        return store

    def _placed(self, vectors: DataFrame) -> DataFrame:
        pivots, dims = self.pivots, self.dims

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
                values, norms = matrix(batch.column(1), dims)
                none = (norms == 0) | (len(pivots) == 0)
                cosines = (values / np.maximum(norms, 1e-300)[:, None]) @ pivots.T if len(pivots) else np.zeros((len(norms), 1))
                arrays = [pa.array(cosines.argmax(axis=1).astype(np.int32), mask=none), pa.array(np.arccos(np.clip(cosines.max(axis=1), -1, 1)), mask=none)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "vector", "cell", "angle"])

        return vectors.select("id", "vector").mapInArrow(place, _ROWS)

    def upsert(self, changes: DataFrame) -> VectorStore:
        """Rows with new ids come in, those with known ones are replaced; of several changes of an id the latest version counts, if there is a column of that name."""
        latest = F.max_by("vector", "version") if "version" in changes.columns else F.max("vector")
        new = changes.where("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(latest.cast("array<float>").alias("vector"))
        old = self.rows.join(new.select("id"), "id", "left_anti")
        if not len(self.pivots):
            return VectorStore.build(old.select("id", "vector").unionByName(new), self.dims)
        return VectorStore(old.unionByName(self._placed(new)), self.pivots, self.dims)

    def delete(self, keys: DataFrame) -> VectorStore:
        return VectorStore(self.rows.join(keys.select(F.col("id").cast("long")), "id", "left_anti"), self.pivots, self.dims)

    def save(self, path: str) -> VectorStore:
        """Writes the store to a new folder and returns the one that reads it, whose vectors are placed once and for all."""
        spark = self.rows.sparkSession
        self.rows.write.parquet(f"{path}/rows")
        spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(self.pivots)], "cell int, pivot array<double>").coalesce(1).write.parquet(f"{path}/pivots")
        return VectorStore.load(spark, path, self.dims)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dims: int) -> VectorStore:
        pivots = [r.pivot for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()]
        return cls(spark.read.parquet(f"{path}/rows"), np.array(pivots).reshape(len(pivots), dims), dims)

    def cells(self) -> Cells:
        """Sizes and rings of the cells, one row each."""
        out = Cells(self.pivots, np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots)), np.zeros(len(self.pivots)))
        for r in self.rows.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
            out.sizes[r.cell], out.low[r.cell], out.high[r.cell] = r.n, r.low, r.high
        return out

    def search(self, queries: DataFrame, k: int = 10, at_least: float | None = None) -> DataFrame:
        """qid, id, score, rank: the k best vectors of each query (qid, vector), of those with a score of at_least or more if it is given."""
        k = k if k > 0 else 10
        cells, asked = self.cells(), queries.select("qid", F.col("vector").cast("array<float>").alias("vector")).where("qid is not null")
        widest = np.pi if at_least is None else float(np.arccos(np.clip(at_least, -1, 1)))
        first = self._scored(_asks(asked.withColumn("bound", F.lit(widest)), cells, self.dims, k, True), cells, k)
        bound = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.acos(F.least(F.greatest(F.min("score"), F.lit(-1.0)), F.lit(1.0)))).alias("kth"))
        open_ = asked.join(bound, "qid", "left").select("qid", "vector", F.least(F.coalesce("kth", F.lit(np.pi)), F.lit(widest)).alias("bound"))
        second = self._scored(_asks(open_, cells, self.dims, k, False), cells, k)
        found = first.unionByName(second).unionByName(self._without_angle(asked, k))
        if at_least is not None:
            found = found.where(F.col("score") >= at_least)
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def scored_pairs(self, queries: DataFrame, k: int = 10, at_least: float | None = None) -> int:
        """How many pairs a search scores, to judge the pruning by."""
        cells, asked = self.cells(), queries.select("qid", F.col("vector").cast("array<float>").alias("vector")).where("qid is not null")
        found = self.search(queries, k, at_least).groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.acos(F.least(F.min("score"), F.lit(1.0)))).alias("kth"))
        widest = np.pi if at_least is None else float(np.arccos(np.clip(at_least, -1, 1)))
        open_ = asked.join(found, "qid", "left").select("qid", "vector", F.least(F.coalesce("kth", F.lit(np.pi)), F.lit(widest)).alias("bound"))
        both = _asks(open_, cells, self.dims, k, True).union(_asks(open_, cells, self.dims, k, False))
        counted = {r.cell: r["count"] for r in both.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
        return int(sum(n * cells.sizes[c] for c, n in counted.items()))

    def _scored(self, asks: DataFrame, cells: Cells, k: int) -> DataFrame:
        """qid, id, score: the k best of the asked cells of each pack, within the bounds."""
        spark, dims, packs = asks.sparkSession, self.dims, cells.packs()
        counts = {r.pack: r["count"] for r in asks.groupBy("pack").count().collect()}
        sizes = np.bincount(packs, cells.sizes) if len(packs) else packs
        split = {p: (max(1, -(-int(sizes[p]) // CHUNK)), -(-n // BLOCK)) for p, n in counts.items()}
        # one row for each cell at most
        of_cell = F.broadcast(spark.createDataFrame([(c, int(p), *split[p]) for c, p in enumerate(packs) if p in split], "cell int, pack int, parts long, blocks long"))
        of_pack = F.broadcast(spark.createDataFrame([(p, *x) for p, x in split.items()], "pack int, parts long, blocks long"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = self.rows.join(of_cell, "cell").select("pack", F.pmod(F.xxhash64("id"), "parts").alias("part"), every("blocks").alias("block"), "id", "vector", "cell")
        of_query = asks.join(of_pack, "pack").select("pack", every("parts").alias("part"), F.pmod(F.xxhash64("qid"), "blocks").alias("block"), "qid", "vector", "bound", "cells")

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            vectors, norms = matrix(left.column("vector").combine_chunks(), dims)
            queries, query_norms = matrix(right.column("vector").combine_chunks(), dims)
            ids, qids = left.column("id").combine_chunks(), right.column("qid")
            known, cell = np.unique(left.column("cell").to_numpy(), return_inverse=True)
            wanted = right.column("cells").combine_chunks()
            of, number = pc.list_parent_indices(wanted).to_numpy(), pc.list_flatten(wanted).to_numpy()
            asked = np.zeros((len(query_norms), len(known)), bool)
            if len(known):
                at = np.searchsorted(known, number).clip(max=len(known) - 1)
                asked[of[known[at] == number], at[known[at] == number]] = True
            floor = np.cos(right.column("bound").to_numpy()) - 1e-9
            asked_at, places, scores = best_pairs(queries, query_norms, vectors, norms, ids, k, floor, cell, asked)
            return pa.table({"qid": qids.take(asked_at), "id": ids.take(places), "score": scores})

        keys = ("pack", "part", "block")
        return own.groupBy(*keys).cogroup(of_query.groupBy(*keys)).applyInArrow(score, "qid long, id long, score double")

    def _without_angle(self, asked: DataFrame, k: int) -> DataFrame:
        """Scores of 0: the k least ids of rows without an angle for queries, of all rows for queries without one. Two lists of k rows."""
        good = asked.where(F.size("vector") == self.dims).where("exists(vector, x -> x <> 0) and forall(vector, x -> x is not null and abs(x) < double('infinity'))")
        none = asked.join(good.select("qid"), "qid", "left_anti")
        least = lambda rows: F.broadcast(rows.select("id").orderBy("id").limit(k))
        pairs = good.select("qid").join(least(self.rows.where("cell is null")), F.lit(True)).unionByName(none.select("qid").join(least(self.rows), F.lit(True)))
        return pairs.select("qid", "id", F.lit(0.0).alias("score"))


def _asks(queries: DataFrame, cells: Cells, dims: int, k: int, first: bool) -> DataFrame:
    """qid, vector, bound, pack, cells: by pack the seeds of each query, or the other cells that come within its bound."""
    packs = cells.packs()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            values, norms = matrix(batch.column(1), dims)
            unit = values / np.maximum(norms, 1e-300)[:, None]
            chosen = np.zeros((len(norms), len(packs)), bool)
            if len(packs):
                for row, seeds in zip(chosen, cells.seeds(unit, k)):
                    row[seeds] = True
                if not first:
                    chosen = ~chosen & (cells.least_angles(unit) <= batch.column(2).to_numpy()[:, None])
                chosen[norms == 0] = False
            # cells are in the order of their packs
            of, cell = np.nonzero(chosen)
            starts = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(packs[cell], prepend=-1)) if len(of) else of
            index = pa.array(of[starts])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)), type=pa.int32()), pa.array(cell, type=pa.int32()))
            arrays = [*(c.take(index) for c in batch.columns), pa.array(packs[cell[starts]], type=pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["qid", "vector", "bound", "pack", "cells"])

    return queries.select(F.col("qid").cast("long"), "vector", "bound").mapInArrow(choose, "qid long, vector array<float>, bound double, pack int, cells array<int>")
