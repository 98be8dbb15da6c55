import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenscope.llm import substring
from tokenscope.llm.common import prepare


def brute(rows, width=substring.WINDOW):
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        if doc is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = set()
        if doc is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] < doc:
                    gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("ab cé d ee ff".split()) + str(r.randrange(400))
    passages = [[word() for _ in range(r.choice([20, 49, 50, 51, 80, 130]))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(r.randrange(4)):
            text += [word() for _ in range(r.randrange(70))]
            p = r.choice(passages)
            k = r.randrange(3)
            text += p[k : len(p) - r.randrange(3)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(text)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, "  " + rows[9][1].replace(" ", "\n"))]
    rows += [(7, rows[7][1]), (8, rows[40][1]), (200, ""), (201, None), (None, rows[9][1]), (None, None), (202, "one two three")]
    rows.append((300, " ".join(["x"] * 300)))
    rows.append((301, " ".join(["x"] * 120)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    prepare(spark)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substring.removal_digests(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 500


def test_stage_keeps_rows_and_columns(spark):
    prepare(spark)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text").cast("long"), "starts": F.lit(1), "copy": F.lit("x")})
    out = substring.remove_repeats(df)
    assert out.columns == df.columns
    got = [(x.doc_id, hashlib.sha256(b" ".join((x.text or "").encode().split())).hexdigest()) for x in out.collect()]
    assert sorted(got, key=str) == sorted([(x[0], x[3]) for x in brute(rows)], key=str)


def test_empty_table(spark):
    prepare(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.removal_digests(df).count() == 0
    assert substring.remove_repeats(df).count() == 0


def test_cover_meets_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
