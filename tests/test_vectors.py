import tracemalloc

import numpy as np
import pyarrow as pa

from tokenscope.operators import vectors as op
from tokenscope.operators import vectorstore as vs


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0 + i % 3]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = vectors.withColumnRenamed("id", "qid")
    want = sorted(map(tuple, op.top_k(queries, vectors, 4).collect()))
    monkeypatch.setattr(op, "MAX_QUERY_ROWS", 7)
    assert sorted(map(tuple, op.top_k(queries, vectors, 4).collect())) == want
    assert len(want) == 240


def plain_best(queries, vectors, ids, k, floor=-1.0, allowed=lambda q, v: True):
    out = []
    for q, x in enumerate(queries):
        scores = [((v * x).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum())), ids[at], at) for at, v in enumerate(vectors) if allowed(q, at)]
        out += [(q, at) for s, _, at in sorted(scores, key=lambda r: (-r[0], r[1]))[:k] if s >= floor]
    return out


def test_products_of_bounded_size_keep_the_best(monkeypatch):
    monkeypatch.setattr(vs, "PRODUCT", (7, 11))
    monkeypatch.setattr(vs, "PAIRS", 5)
    r = np.random.default_rng(3)
    vectors, queries = r.normal(size=(120, 4)), r.normal(size=(20, 4))
    vectors[30:60] = vectors[:1]  # thirty copies, of which the first ids count
    ids, norm = r.permutation(120), lambda x: np.sqrt((x * x).sum(axis=1))
    cells, asked = r.integers(0, 6, 120), r.random((20, 6)) < 0.5
    pairs = lambda *x: list(zip(*(c.to_pylist() for c in vs.best_pairs(queries, norm(queries), vectors, norm(vectors), pa.array(ids), *x)[:2])))
    assert pairs(5) == plain_best(queries, vectors, ids, 5)
    assert pairs(40) == plain_best(queries, vectors, ids, 40)
    assert pairs(5, np.full(20, 0.7)) == plain_best(queries, vectors, ids, 5, 0.7)
    assert pairs(3, None, cells, asked) == plain_best(queries, vectors, ids, 3, -1.0, lambda q, v: asked[q, cells[v]])


def test_memory_of_products_does_not_grow_with_queries():
    r = np.random.default_rng(0)
    vectors, queries = r.normal(size=(8000, 8)), r.normal(size=(8000, 8))
    tracemalloc.start()
    vs.best_pairs(queries, np.sqrt((queries**2).sum(axis=1)), vectors, np.sqrt((vectors**2).sum(axis=1)), pa.array(range(8000)), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one product of all would have 512 MB
    assert peak < 100e6


def test_queries_that_ask_all_cells_are_sent_in_small_pieces(spark):
    data = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(1).normal(size=(1500, 16)))]
    vectors = spark.createDataFrame(data, "id long, vector array<float>").coalesce(1)
    store = vs.VectorStore.build(vectors, 16)
    asked = vectors.withColumnRenamed("id", "qid").selectExpr("qid", "vector", "3.2d as bound")
    asks = vs._asks(asked, store.cells(), 16, 5, False)
    sent = asks.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    # a row for each query and pack, where there was one for each query and cell
    assert sent.agg({"n": "sum"}).first()[0] <= 1500 * (1 + max(store.cells().packs()))


def test_parts_and_blocks_by_a_column(spark, monkeypatch):
    for name, n in (("MAX_QUERY_ROWS", 4), ("MAX_VECTOR_ROWS", 9), ("MIN_VECTOR_ROWS", 5)):
        monkeypatch.setattr(op, name, n)
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 3)).round(1).astype(np.float32)
    tools = r.integers(0, 3, 90)
    vectors = spark.createDataFrame([(i, x[i].tolist(), int(tools[i])) for i in range(90)], "id long, vector array<float>, tool int")
    queries = vectors.where("id % 4 = 0").selectExpr("concat('q', id) as qid", "vector", "tool")
    got = op.top_k(queries, vectors, 4, "tool", 0.5).collect()
    d, asked = x.astype(float), list(range(0, 90, 4))
    want = plain_best(d[asked], d, np.arange(90), 4, 0.5, lambda q, v: tools[asked[q]] == tools[v])
    assert sorted((g.qid, g.id) for g in got) == sorted((f"q{asked[q]}", v) for q, v in want)
