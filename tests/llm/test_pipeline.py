import hashlib
import random
import struct

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontam, test_neardup, test_quality, test_substring
from tokenscope.llm import decontam, pieces


def make():
    r = random.Random(9)
    word = lambda: r.choice(["ba", "cé", "do"]) + str(r.randrange(3000))
    bench = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    passage = [word() for _ in range(70)]
    docs = []
    for i in range(110):
        w = [word() for _ in range(r.choice([10, 60, 90, 150]))]
        kind = r.randrange(8)
        if kind == 0:
            w += passage
        elif kind == 1:
            w += r.choice(bench)[1].split()
        elif kind == 2 and docs:
            w = test_neardup.edited(r, r.choice(docs)[1].split(), 0.03)
        elif kind == 3:
            w = [x.upper() + "%%%" for x in w]
        docs.append((i, r.choice([" ", "\n"]).join(w), r.choice(["en", "fr"]), "s", len(w)))
    docs += [(500, docs[0][1], "en", "s", 1), (501, None, None, None, None), (502, "", "en", "s", 0), (503, " ".join(f"long{k}x" for k in range(3000)), "en", "s", 0)]
    labels = [(d[0], int("%%%" not in (d[1] or "")), 0) for d in docs]
    return docs, labels, bench


def brute(docs, labels, bench):
    keep = [k for _, k in test_quality.brute_kept([d[:3] for d in docs], labels, corpus_pipeline.quality.ALPHA, corpus_pipeline.quality.DELTA)]
    docs = [(d[0], d[1]) for d, k in zip(docs, keep) if k]
    leads = set(test_neardup.brute_classes(docs))
    docs = [x for x in docs if (x[0], x[0]) in leads]
    gone = dict((x[0], x) for x in test_substring.brute(docs))
    first, out = {}, []
    for d, t in sorted(docs):
        w = (t or "").split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in docs:
        w = (t or "").split()
        cut = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        assert len(cut) == gone[d][2]
        out.append((d, " ".join(x for j, x in enumerate(w) if j not in cut) if cut else t))
    items = [(i, decontam.normal(t)) for i, t in bench]
    out = [(d, t) for d, t in out if not test_decontam.brute(items, t)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = []
    for d, t in out:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        rows.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    return sorted(rows)


def test_run_equals_brute_force(spark, tmp_path):
    docs, labels, bench = make()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    # columns with names of the operators' own
    df.withColumns({"node": F.lit(1), "items": F.lit("x"), "key": F.lit(2.5), "kept": F.lit(True)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    want = brute(docs, labels, bench)
    assert got == want
    assert 20 < len(want) < 90


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels, bench = make()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
