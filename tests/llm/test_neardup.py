import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenscope.llm import alignment, graph, neardup
from tokenscope.llm.common import prepare


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_classes(rows):
    words = [(d, neardup.normal_words(t or "")) for d, t in rows]
    parent = {d: d for d, _ in words if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    some = [(d, w) for d, w in words if d is not None and w]
    for i, (d, w) in enumerate(some):
        for e, v in some[:i]:
            if abs(len(w) - len(v)) <= 0.2 * max(len(w), len(v)) and distance(w, v) <= 0.2 * max(len(w), len(v)) + 1e-9:
                join(d, e)
    out = []
    for d, w in words:
        if d is None:
            same = [find(e) for e, v in some if v == w]
            out.append((None, min(same) if same else None))
        else:
            out.append((d, find(d)))
    return sorted(out, key=str)


def edited(r, words, share):
    out = []
    for w in words:
        x = r.random()
        if x < share / 3:
            continue
        out.append(f"n{r.randrange(10**6)}" if x < share else w)
    return out


def corpus(seed, copies=40):
    r = random.Random(seed)
    rows, i = [], 0
    boiler = [f"b{k}" for k in range(60)]
    for _ in range(30):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 200))]
        if r.random() < 0.5:
            base = base[:40] + boiler + base[40:]
        for _ in range(r.choice([1, 1, 2, 3])):
            rows.append((i, " ".join(edited(r, base, r.choice([0, 0.01, 0.04])))))
            i += 1
    base = [f"h{r.randrange(3000)}" for _ in range(150)]
    rows += [(i + k, " ".join(edited(r, base, 0.03))) for k in range(copies)]
    rows += [(i + 100, rows[3][1]), (i + 101, rows[3][1].upper()), (4, rows[4][1]), (5, rows[20][1])]
    rows += [(500, ""), (501, None), (502, " \n"), (None, rows[8][1]), (None, None), (None, "never seen"), (503, "one two"), (504, "One, two!"), (505, "...")]
    return rows


def test_classes_equal_all_pairs(spark):
    prepare(spark)
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "whole": F.lit("x")})
    got = sorted(map(tuple, neardup.classes(df).collect()), key=str)
    assert got == brute_classes(rows)


def test_stage_keeps_one_of_each_class(spark):
    prepare(spark)
    rows = corpus(2, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "class_id": F.lit("x")})
    out = neardup.keep_one(df)
    assert out.columns == df.columns
    want = sorted({d for d, c in brute_classes(rows) if d is not None and d == c})
    got = [x.doc_id for x in out.collect()]
    assert sorted(x for x in got if x is not None) == want


def test_empty_table(spark):
    prepare(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(df).count() == 0
    assert neardup.keep_one(df).count() == 0


def test_distances():
    r = random.Random(3)
    pairs = []
    for _ in range(200):
        a = [r.randrange(8) for _ in range(r.randrange(30))]
        b = edited(r, a, 0.3) if r.random() < 0.7 else [r.randrange(8) for _ in range(r.randrange(30))]
        b = [x if isinstance(x, int) else int(x[1:]) for x in b]
        pairs.append((np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)))
    long = [r.randrange(50) for _ in range(150)]
    pairs += [(np.array(long), np.array(long[k:] + long[: k // 2])) for k in range(0, 60, 4)]
    limits = [r.randrange(12) for _ in range(200)] + [40] * 15
    for (a, b), limit, got in zip(pairs, limits, alignment.within(pairs, limits)):
        d = distance(list(a), list(b))
        assert got == (d <= limit)
        assert alignment.banded(a.tolist(), b.tolist(), limit) == (d if d <= limit else None)


def test_best_in_text():
    r = random.Random(4)
    for _ in range(200):
        p = np.array([r.randrange(4) for _ in range(r.randrange(1, 12))])
        t = np.array([r.randrange(4) for _ in range(r.randrange(0, 30))], dtype=np.int64)
        want = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert alignment.best_in(p, t, 0, 60) == want


def test_components(spark):
    prepare(spark)
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    parent = {}
    for a, b in links:
        for x in (a, b):
            parent.setdefault(x, x)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)


def like_pairs(rows):
    """All pairs of doc_ids whose texts' alignment shows a similarity of 0.8 or more."""
    words = [(d, neardup.normal_words(t)) for d, t in rows]
    known = {}
    ids = [np.array([known.setdefault(x, len(known)) for x in w]) for _, w in words]
    counts = np.zeros((len(ids), 512), dtype=np.int16)
    for i, x in enumerate(ids):
        np.add.at(counts[i], x % 512, 1)
    sizes, pairs = counts.sum(axis=1), []
    for i in range(len(ids)):
        common, longer = np.minimum(counts[:i], counts[i]).sum(axis=1), np.maximum(sizes[:i], sizes[i])
        pairs += [(i, j) for j in np.flatnonzero(5 * (longer - common) <= longer).tolist()]
    good = alignment.within([(ids[i], ids[j]) for i, j in pairs], [max(len(ids[i]), len(ids[j])) // 5 for i, j in pairs])
    return [(rows[i][0], rows[j][0]) for (i, j), ok in zip(pairs, good) if ok]


def labels_of(rows, pairs):
    label = {d: d for d, _ in rows}
    for i, j in pairs:
        if label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {d: new if x == old else x for d, x in label.items()}
    return label


def aligned_classes(rows):
    """As brute_classes, by alignment of all pairs, for more rows of distinct doc_ids."""
    return sorted(labels_of(rows, like_pairs(rows)).items())


def recall(spark, rows):
    """(share of the like pairs, found by aligning all pairs, whose texts are in one class; whether some class joins what all pairs don't; like pairs)."""
    prepare(spark)
    pairs = like_pairs(rows)
    want = labels_of(rows, pairs)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return sum(got[x] == got[y] for x, y in pairs) / len(pairs), any(want[d] != want[c] for d, c in got.items()), len(pairs)


def changed(r, words, share, tag):
    """Words of which exactly that share, at random places, are others."""
    places = set(r.sample(range(len(words)), int(share * len(words) + 1e-9)))
    return [f"{tag}x{k}" if k in places else w for k, w in enumerate(words)]


@pytest.mark.parametrize("share, least", [(0.2, 0.9), (0.18, 0.94), (0.15, 0.99)])
def test_recall_of_isolated_pairs(spark, share, least):
    r = random.Random(6)
    rows = []
    for i in range(200):
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed(r, base, share, f"c{i}")))]
    found, wrong, n = recall(spark, rows)
    assert n >= 200 and not wrong and found >= least


@pytest.mark.parametrize("every", [5, 6, 7, 8])
def test_recall_of_evenly_spaced_changes(spark, every):
    """150 pairs with each so many-th word changed; and 150 with a template of 120 of their 200 words."""
    r = random.Random(every)
    template, rows = [f"t{k}" for k in range(120)], []
    for i in range(300):
        base = [f"w{r.randrange(5000)}" for _ in range(200 if i % 2 else 80)]
        base = base if i % 2 else base[:40] + template + base[40:]
        first = r.randrange(every)
        other = [f"c{i}x{k}" if k % every == first else w for k, w in enumerate(base)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    found, wrong, n = recall(spark, [row for row in rows if row[0] // 2 % 2])
    assert n >= 150 and not wrong and found >= 0.9
    found, wrong, n = recall(spark, [row for row in rows if row[0] // 2 % 2 == 0])
    assert n >= 150 and not wrong and found >= 0.9


@pytest.mark.parametrize("delete", [True, False])
def test_recall_of_scattered_deletions_and_insertions(spark, delete):
    r, rows = random.Random(12), []
    for i in range(200):
        base = [f"w{r.randrange(5000)}" for _ in range(250 if delete else 200)]
        if delete:
            gone = set(r.sample(range(250), 50))
            other = [w for k, w in enumerate(base) if k not in gone]
        else:
            other = list(base)
            for k in range(50):
                other.insert(r.randrange(len(other) + 1), f"c{i}x{k}")
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    found, wrong, n = recall(spark, rows)
    assert n >= 200 and not wrong and found >= 0.88


def test_recall_of_edits_of_all_kinds(spark):
    r = random.Random(9)
    rows = []
    for i in range(200):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([20, 40, 63, 64, 100, 130, 260, 600]))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(r, base, r.choice([0.1, 0.15, 0.18]))))]
    found, wrong, n = recall(spark, rows)
    assert n > 150 and not wrong and found >= 0.95


@pytest.mark.parametrize("own_only, share", [(False, 0.2), (False, 0.15), (True, 0.2), (True, 0.12)])
def test_recall_with_a_shared_template(spark, own_only, share):
    """200 pairs that share a template of 120 of their 200 words; edits anywhere, or only in the 80 words of their own."""
    r = random.Random(10)
    template, rows = [f"t{k}" for k in range(120)], []
    for i in range(200):
        own = [f"w{r.randrange(5000)}" for _ in range(80)]
        one = own[:40] + template + own[40:]
        other = changed(r, own, share * 200 / 80, f"c{i}") if own_only else None
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other[:40] + template + other[40:] if own_only else changed(r, one, share, f"c{i}")))]
    found, wrong, n = recall(spark, rows)
    assert n >= 200 and not wrong and found >= 0.9


def test_short_texts_equal_all_pairs(spark):
    prepare(spark)
    r = random.Random(7)
    rows = []
    for n in range(1, 13):
        for _ in range(12):
            base = [f"s{r.randrange(400)}" for _ in range(n)]
            other = list(base)
            other[n // 2] = "changed"
            rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((base, other, base[: n // 2] + base[n // 2 + 1 :] or ["none"]))]
    # short texts that share a common beginning
    rows += [(len(rows) + k, f"see the list of all {x} for {y} here now") for k, (x, y) in enumerate((f"a{k % 9}", f"b{k // 9}") for k in range(60))]
    want = aligned_classes(rows)
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sum(d != c for d, c in want) > 100
    # 24 samples of two-word shingles: of some hundred pairs that a changed word leaves with the least in common a few are missed
    assert sum(x != y for x, y in zip(got, want)) <= 0.05 * len(want)


def test_passage_shared_by_many_texts(spark):
    prepare(spark)
    r = random.Random(8)
    passage, rows = [f"p{k}" for k in range(60)], []
    for i in range(250):
        own = [f"w{r.randrange(20000)}" for _ in range(40)]
        rows.append((i, " ".join(passage + own)))
        if i % 25 == 3:
            rows.append((1000 + i, " ".join(passage + [f"c{i}x{k}" if k % 2 else w for k, w in enumerate(own)])))
    want = aligned_classes(rows)
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sum(d != c for d, c in want) == 10
    assert got == want


def test_texts_are_sampled_together(monkeypatch):
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(30)] + ["İx", "--", "a\x1fb", "«É»", "q\x85r"]
    texts = [r.choice([" ", "\n", "\u3000 "]).join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 4, 5, 6, 20, 21, 22, 29, 63, 64, 300]))) for _ in range(150)] + ["", " \n", "x " * 90]
    rows = list(neardup.word_rows(texts))
    assert [x for x, _ in rows] == [b" ".join(neardup.normal_words(t)) for t in texts]
    assert [len(x) for _, x in rows] == [len(neardup.normal_words(t)) for t in texts]
    hashes = [x for _, x in rows]
    for words, x in zip(map(neardup.normal_words, texts), hashes):
        assert len(set(words)) == len(set(x.tolist())) == len({(w, h) for w, h in zip(words, x.tolist())})
    together = neardup.samples(hashes)
    assert all(np.array_equal(a, neardup.samples([x])[0]) for a, x in zip(together, hashes))
    monkeypatch.setattr(neardup, "_WORDS", 70)
    assert all(map(np.array_equal, together, neardup.samples(hashes)))
    monkeypatch.undo()
    # the steps that hash and label shingles are as many for 20 texts as for 100
    calls, mix = [], neardup.mix
    monkeypatch.setattr(neardup, "mix", lambda *x: calls.append(1) or mix(*x))
    counts = []
    for n in (20, 100):
        calls.clear()
        neardup.samples([np.arange(40, dtype=np.uint64) + np.uint64(i) for i in range(n)])
        counts.append(len(calls))
    assert counts[0] == counts[1]


def test_occurrence_follows_the_order_of_the_text():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 3000):
        keys = r.integers(0, max(1, n // 3), n).astype(np.uint64) << np.uint64(50)
        seen = {}
        want = [seen.__setitem__(k, seen.get(k, -1) + 1) or seen[k] for k in keys.tolist()]
        assert neardup.occurrence(keys).tolist() == want
    owners = np.array([0, 0, 1, 1], dtype=np.uint64)
    one = neardup.labelled(np.array([5, 5, 5, 6], dtype=np.uint64), 3, owners)
    assert one[0] != one[1] and one[0] == one[2]


def test_blocks_of_alignments_are_exact_inside_their_band():
    r = random.Random(8)
    for half in (0, 1, 5, 12):
        pairs = []
        for _ in range(12):
            a = [r.randrange(r.choice([3, 40])) for _ in range(r.randrange(1, 40))]
            b = [r.randrange(40) if r.random() < 0.2 else x for x in a if r.random() > 0.1] or [1]
            pairs.append((a, b))
        found = alignment._block([(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)) for a, b in pairs], half)
        for (a, b), d in zip(pairs, found.tolist()):
            assert d == distance(a, b) or d > half and d >= distance(a, b)
