import random
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenscope.llm import toxicity as tox
from tokenscope.llm.common import prepare


def make(n, seed):
    r = random.Random(seed)
    syllables = "an en er in on ti st re la mo".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.choice([5, 40, 150]))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "Scum!", "zoxtra" + word(), "zoxtra" + word()]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_gradients():
    net, r = tox.Network(3), np.random.default_rng(4)
    x = r.standard_normal((6, 2 * tox.WIDTH))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids = np.array([[0, 1, 2, 3, -1], [4, 5, 0, 1, 2], [3, -1, -1, -1, -1], [-1] * 5])
    target = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        z = net.forward(x, ids).astype(np.float64)
        return float(np.sum(np.log1p(np.exp(z)) - target * z))

    logit, kept = net.forward(x, ids, keep=True)
    g, d_x = net.backward(x, ids, kept, tox._sigmoid(logit) - target)
    for name, array, grad in [*((k, net.p[k], g[k]) for k in net.p), ("x", x, d_x)]:
        for _ in range(4):
            at = tuple(int(r.integers(k)) for k in array.shape)
            old, step = array[at], 1e-2
            array[at] = old + step
            up = loss()
            array[at] = old - step
            down = loss()
            array[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3, (name, at)


def test_windows_cover_every_word():
    for n in (0, 1, tox.WINDOW - 1, tox.WINDOW, tox.WINDOW + 1, 36, 200):
        w = tox.windows(np.arange(n))
        assert set(w.ravel().tolist()) - {-1} == set(range(n)) and w.shape[1] == tox.WINDOW
        assert n <= tox.WINDOW or (w[-1] >= 0).any()


def test_hashing_is_the_same_in_any_company():
    words = ["a", "idiot", "éß世", "x" * 50, "to"]
    word, gram, starts = tox.hashed(words)
    for i, w in enumerate(words):
        one = tox.hashed([w])
        assert one[0][0] == word[i] and sorted(one[1].tolist()) == sorted(gram[starts[i] : starts[i + 1]].tolist())
        assert len(one[1]) == sum(max(0, len(w) + 3 - n) for n in tox.GRAMS)


def test_held_out_accuracy_and_columns(spark):
    prepare(spark)
    rows = make(1500, 1)
    extra = [(9001, ""), (9002, None), (None, "vile scum"), (3, rows[3][1]), (9003, "vile " + "on er " * 20_000)]
    df = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string").withColumns({"score": F.lit("x"), "y": F.lit(1)})
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, 1, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    got = tox.score(df, labels, ["doc_id"]).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert len(got) == len(rows) + len(extra)
    label = {r[0]: r[2] for r in rows}
    held = [(x.score >= tox.THRESHOLD, label[x.doc_id]) for x in got if x.held and x.doc_id in label]
    assert len(held) > 150
    right = [p == bool(y) for p, y in held]
    assert sum(right) / len(right) > 0.93
    by_id = {x.doc_id: x.score for x in got}
    assert by_id[9001] == by_id[9002] and 0 <= by_id[9001] < tox.THRESHOLD and by_id[None] >= tox.THRESHOLD and by_id[9003] >= tox.THRESHOLD
    assert all(0 <= x.score <= 1 for x in got)


def test_empty_and_one_sided_tables(spark):
    prepare(spark)
    rows = make(30, 2)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    assert {x.score for x in tox.score(df, labels, ["doc_id"]).collect()} == {0.0}
    assert {x.score for x in tox.score(df, labels.limit(0), ["doc_id"]).collect()} == {0.0}
    assert tox.score(df.limit(0), labels, ["doc_id"]).count() == 0


def test_every_window_is_scored():
    for n in (tox.WINDOW, tox.WINDOW + 1, 25, 61):
        assert [w[0] for w in tox.windows(np.arange(n)).tolist()] == list(range(n - tox.WINDOW + 1))
    # the windows around a passage are scored alike wherever it stands, so only the number of windows tells
    texts = [" ".join(["on"] * k + ["vile", "scum"] + ["er"] * (90 - k)) for k in (30, 31, 35, 41)]
    net = tox.Network(5)
    net.p["scale"] = np.array([1.0, 0.3, 0.1])
    net.words[:] *= 20
    assert len(set(tox.score_texts(net, texts))) == 1


def test_scores_equal_those_of_single_windows(monkeypatch):
    """Sliding over all texts at once gives what each window gives by itself."""
    monkeypatch.setattr(tox, "BLOCK", 16)
    r = random.Random(6)
    texts = ["", "one", *(" ".join(r.choice(["on", "er", "vile", "st", "la"]) for _ in range(n)) for n in (2, 7, 8, 9, 30, 8, 70)), "two words"]
    net = tox.Network(5)
    net.words[:] *= 20
    net.p["scale"] = np.array([0.7, 0.3, 0.1])
    for text, got in zip(texts, tox.score_texts(net, texts)):
        words = tox.split(text)
        known = sorted(set(words))
        x = net.vectors(*tox.hashed(known))
        logits = net.forward(x, tox.windows(np.array([known.index(w) for w in words], dtype=np.int64)))
        z = 0.7 * logits.max() - 0.3 * np.log(len(logits)) + 0.1
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5


def test_scoring_makes_no_tanh_and_bears_large_weights(monkeypatch):
    """tanh is the dearest step: scoring goes without, shares the first step of a word, and gives what forward gives, also where exp overflows."""
    r = np.random.default_rng(3)
    ids, net = r.integers(0, 40, 90), tox.Network(5)
    for large in (1, 60):
        x = (large * r.standard_normal((40, 2 * tox.WIDTH))).astype(np.float32)
        want = tox.window_scores(net, x, [ids])
        assert np.abs(net.forward(x, tox.windows(ids)) - want).max() < 1e-4
        with monkeypatch.context() as patched, np.errstate(all="raise", under="ignore"):
            patched.setattr(np, "tanh", None)
            got = net.quick(x, ids)
        assert np.abs(got - want).max() < 1e-4


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_what_it_learns_from_the_tables():
    """Held-out rows of the larger tables: order, hits, and false alarms whatever the length."""
    read = lambda name: pq.read_table(f"/root/testdata/sf0.1/{name}.parquet").to_pandas()
    rows = read("documents")[["doc_id", "text"]].merge(read("labels")[["doc_id", "toxic"]], on="doc_id").drop_duplicates("doc_id")
    held = rows.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 3 == 1)
    known, test = rows[~held].sort_values("doc_id"), rows[held]
    known = pd.concat([known[known.toxic == 1].head(tox.MAX_POSITIVE), known[known.toxic == 0].head(tox.MAX_NEGATIVE)])
    net = tox.fit(list(known.text), list(known.toxic))
    score, y, size = np.array(tox.score_texts(net, list(test.text))), test.toxic.to_numpy(), test.text.str.len().to_numpy()
    assert (score[y == 1][:, None] > score[y == 0][None, :]).mean() > 0.95
    assert (score[y == 1] >= tox.THRESHOLD).mean() > 0.8
    for low, high in ((0, 500), (500, 2000), (2000, 8000), (8000, 10**9)):
        some = (size >= low) & (size < high) & (y == 0)
        assert (score[some] >= tox.THRESHOLD).mean() < 0.05
