"""The vector store against plain loops."""

import math

import numpy as np
import pytest

from tokenscope.operators import vectorstore as vs
from tokenscope.operators.vectorstore import VectorStore


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n > 0 else 0.0


def plain(queries, vectors, k, at_least=None):
    out = []
    for qid, q in queries:
        scores = sorted(((-round(cosine(q, v), 9), i) for i, v in vectors))[:k]
        out += [(qid, i, -s, at + 1) for at, (s, i) in enumerate(scores) if at_least is None or -s >= at_least]
    return sorted(out)


def rows(found):
    return sorted((r.qid, r.id, round(r.score, 9) + 0.0, r["rank"]) for r in found.collect())


def frame(spark, data, name="id"):
    return spark.createDataFrame(data, f"{name} long, vector array<float>")


def clustered(n, dims=8, centres=12, seed=1, spread=0.05):
    """Vectors near a few centres; in eighths and with repeats, so that there are ties."""
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, dims)) * 3
    return [(i, (np.round((middle[i % centres] + r.normal(size=dims) * spread * 3) * 8) / 8).tolist()) for i in range(n)]


@pytest.mark.parametrize("k", [1, 4, 70])
def test_equals_plain_loops_with_odd_rows(spark, k):
    data = clustered(300) + [(1000, [0.0] * 8), (1001, []), (1002, [1.0]), (1003, None)] + [(2000 + i, v) for i, v in clustered(20)]
    asked = [(i, v) for i, v in data if i % 23 == 0] + [(9001, [0.0] * 8), (9002, None), (9003, [1.0, 2.0]), (9004, [-x for x in data[0][1]])]
    store = VectorStore.build(frame(spark, data), 8, pivots=12)
    assert rows(store.search(frame(spark, asked, "qid"), k)) == plain(asked, data, k)


def test_least_score_and_pruning(spark):
    data = clustered(1200, spread=0.02)
    asked = [(i, v) for i, v in data if i % 100 == 0]
    store, queries = VectorStore.build(frame(spark, data), 8, pivots=24), frame(spark, asked, "qid")
    assert rows(store.search(queries, 5, at_least=0.9999)) == plain(asked, data, 5, 0.9999)
    # a third of the pairs would already be a lot in clusters
    assert store.scored_pairs(queries, 5) < 0.33 * len(data) * len(asked)


def test_upsert_delete_save_load(spark, tmp_path):
    data = clustered(200)
    changed = [(i, [-x for x in v]) for i, v in data if i % 9 == 0] + [(700, data[5][1])]
    gone = [i for i, _ in data if i % 4 == 1]
    store = VectorStore.build(frame(spark, data), 8).upsert(frame(spark, changed)).delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    now = sorted(({**dict(data), **dict(changed)}).items())
    now = [(i, v) for i, v in now if i not in gone]
    asked = [(i, v) for i, v in data if i % 10 == 0]
    queries = frame(spark, asked, "qid")
    saved = store.save(str(tmp_path / "store"))
    for s in (store, saved, VectorStore.load(spark, str(tmp_path / "store"), 8)):
        assert rows(s.search(queries, 3)) == plain(asked, now, 3)


def test_latest_version_counts(spark):
    store = VectorStore.build(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), 2)
    new = spark.createDataFrame([(1, [0.0, -1.0], 2), (1, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)], "id long, vector array<float>, version int")
    assert rows(store.upsert(new).search(frame(spark, [(7, [0.0, 1.0])], "qid"), 5)) == [(7, 1, -1.0, 2), (7, 2, 1.0, 1)]


def test_empty_store_and_first_rows(spark):
    store, queries = VectorStore.build(frame(spark, []), 2), frame(spark, [(7, [0.0, 1.0])], "qid")
    assert rows(store.search(queries, 5)) == []
    assert rows(store.upsert(frame(spark, [(3, [0.0, 2.0]), (4, [0.0, 0.0])])).search(queries, 5)) == [(7, 3, 1.0, 1), (7, 4, 0.0, 2)]


def test_large_cells_and_many_queries_are_split(spark, monkeypatch):
    monkeypatch.setattr(vs, "CHUNK", 10)
    monkeypatch.setattr(vs, "BLOCK", 4)
    data = clustered(240, centres=2)
    asked = [(i, v) for i, v in data if i % 5 == 0]
    store = VectorStore.build(frame(spark, data), 8, pivots=2)
    assert rows(store.search(frame(spark, asked, "qid"), 3)) == plain(asked, data, 3)
