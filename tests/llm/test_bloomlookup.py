"""Sketches and likeness against sets of pieces, edited texts against slices of strings."""

import base64
import hashlib
import random
import struct

import regex
import xxhash
from pyspark.sql import functions as F

from tokenscope.llm import bloomlookup
from tokenscope.llm.common import prepare

PIECE = regex.compile(bloomlookup.PIECE, regex.ASCII)
SIGNED = 1 << 63


def signed(x):
    return x - (1 << 64) if x >= SIGNED else x


def pieces(text):
    return {xxhash.xxh64_intdigest(x.encode(), seed=42) for x in PIECE.findall(text)}


def sketch(keys):
    cells = [[0, 0, 0] for _ in range(24)]
    for k in keys:
        for third in range(3):
            c = cells[8 * third + (k >> 3 * third & 7)]
            c[0], c[1], c[2] = c[0] + 1, c[1] ^ k, c[2] ^ xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed=42)
    return base64.b64encode(b"".join(struct.pack(">IQQ", *c) for c in cells)).decode()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """(doc_id, n_chars, edited sha, fingerprint, edited fingerprint, near_edited, near_next) of rows with different ids."""
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    out = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        a, e, n = pieces(t), pieces(edited), pieces(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), sketch(a), sketch(e), like(a, e), like(a, n)))
    return out


def plain(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return [tuple(x[c] for c in names) for x in df.collect()]


def corpus():
    r = random.Random(3)
    word = lambda: r.choice(["alpha", "Beta.", "ça", "漢字", "x!", "end?", "𝒳𝒴", "w"]) + str(r.randrange(40))
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", " ", "\n", "\n\n", "  \t", "\x0b"]) for _ in range(n))
    rows = [(i * 7 - 50, text(r.choice([0, 1, 3, 8, 20, 60, 200]))) for i in range(60)]
    rows[10] = (rows[10][0], rows[9][1])  # the next document is a copy
    same = text(120)
    rows += [(1000, same), (1001, same + text(5)), (1002, None), (1003, ""), (1004, " \n "), (1005, text(6000)), (1006, "one line " * 3000), (None, text(30)), (10**15, "𝒳" * 9)]
    return rows


def test_equals_sets(spark):
    prepare(spark)
    rows = corpus()
    df = spark.createDataFrame([(*x, "clash", 1, "k") for x in rows], "doc_id long, text string, key string, need int, next string").repartition(7)
    got = bloomlookup.fingerprints(df)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(plain(got), key=str) == sorted(brute(rows), key=str)
    assert got.agg(F.max("enlarged_next")).first()[0] >= 3


def test_repeated_rows_and_ids(spark):
    prepare(spark)
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "zz yy xx ww"), (2, "bb cc dd ee"), (None, "first of all ones"), (None, "second of them all")]
    got = sorted(plain(bloomlookup.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))), key=str)
    nexts = {None: "a b c d e f g h", 1: "bb cc dd ee", 2: "first of all ones"}
    want = []
    for d, t in rows:
        k = len(t) // 4
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + nexts[d][:k]).encode()).hexdigest()))
    assert [x[:3] for x in got] == sorted(want, key=str)


def test_one_row_and_none(spark):
    prepare(spark)
    one = spark.createDataFrame([(5, "abcdefgh ijkl")], "doc_id long, text string")
    assert plain(bloomlookup.fingerprints(one)) == brute([(5, "abcdefgh ijkl")])
    assert bloomlookup.fingerprints(one.limit(0)).count() == 0


def test_differences_are_found(spark):
    r = random.Random(8)
    rows = []
    for n, both in [(0, 0), (1, 0), (3, 30), (12, 500), (40, 0), (300, 100), (2000, 50)]:
        a = [signed(r.getrandbits(64)) for _ in range(n)]
        b = [signed(r.getrandbits(64)) for _ in range(n // 2)]
        c = [signed(r.getrandbits(64)) for _ in range(both)]
        rows.append((a + c, c + b, a, b))
    # digests that agree in all bits that deal and place them on the first levels
    rows.append(([0, 1 << 33, 1 << 34], [], [0, 1 << 33, 1 << 34], []))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, plus array<long>, minus array<long>")
    zero = bloomlookup.places(F.lit(0))
    found = bloomlookup.differences(F.col("a"), F.col("b"), bloomlookup.sketch(F.col("a"), zero), bloomlookup.sketch(F.col("b"), zero))
    for x in df.select(found.alias("found"), "plus", "minus").collect():
        assert sorted(x.found.plus) == sorted(x.plus) and sorted(x.found.minus) == sorted(x.minus)


def test_only_functions_run(spark):
    prepare(spark)
    df = bloomlookup.fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
