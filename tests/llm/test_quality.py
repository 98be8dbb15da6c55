import math
import random
import re

from pyspark.sql import functions as F

from tokenscope.llm import quality
from tokenscope.llm.common import prepare, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, n < 50 or 100 * repeat > 50 * n


def make(seed, n=400):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice("abcdeé") + str(r.randrange(300)) for _ in range(r.choice([0, 3, 49, 50, 51, 80, 120]))]
        bad = r.random() < 0.2
        if bad and w:
            kind = r.randrange(3)
            w = [x + "%%%" for x in w] if kind == 0 else [x.upper() for x in w] if kind == 1 else (w[:3] * 60)[: len(w)] + w[:10]
        text = "".join(x + r.choice([" ", "\n", "\n\n", "\t ", "\x0b", "  ", "\x1c "]) for x in w)
        docs.append((i, text, r.choice(["en", "en", "fr", None])))
        if r.random() < 0.9:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(5, docs[5][1], docs[5][2]), (None, "x " * 60, "en"), (1000, None, "en"), (1001, "", None), (1002, "a\n\na\n a\n", "fr")]
    labels += [(5, 0, 0), (6, None, 0), (None, 1, 0), (7777, 1, 0)]
    return docs, labels


def test_base_counts():
    for _, text, _ in make(1)[0]:
        got = quality.base_counts(text or "")
        assert got[:6] == brute(text), text


def test_tail_is_exact():
    for n, p, k in [(10, 0.3, 2), (200, 0.02, 0), (50, 0.5, 25), (7, 0.1, 7)]:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(math.exp(quality.log_binomial_tail(k, n, p)) - min(1, want)) < 1e-9


def brute_kept(docs, labels, alpha, delta):
    low = {}
    for d, q, _ in labels:
        if d is not None and q is not None:
            low[d] = min(low.get(d, q), q)
    feats = [(d, lang, quality.base_counts(t or "")) for d, t, lang in docs]
    rows = [(d, lang, f[6:]) for d, lang, f in feats if not f[5]]
    cut = {}
    for lang in {x for _, x, _ in rows}:
        own = [f for _, x, f in rows if x == lang]
        good = [f for d, x, f in rows if x == lang and low.get(d) == 1]
        bad = [f for d, x, f in rows if x == lang and low.get(d, 1) != 1]
        others = [f for d, x, f in rows if x == lang and low.get(d) != 1]

        def level(i, s, bad=bad, others=others):
            """The least level at which rule i rejects score s: that of the best lift of a score up to s."""
            found = []
            for c in range(1, s + 1):
                m, b = sum(f[i] >= c for f in others), sum(f[i] >= c for f in bad)
                if b > math.sqrt(b):
                    found.append(math.ceil(quality.PATH * m * len(bad) / (len(others) * (b - math.sqrt(b)))))
            return min([x for x in found if x <= quality.PATH], default=None)

        known = {(i, s): level(i, s) for i in range(3) for s in {f[i] for f in own}}
        hit = lambda f, t, known=known: any(known[i, f[i]] is not None and known[i, f[i]] <= t for i in range(3))
        gain, n = -1, len(good)
        for t in range(quality.PATH + 1):
            k = sum(hit(f, t) for f in good)
            if k >= alpha * n or sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) > delta * len(own) / len(rows):
                break
            if (now := sum(hit(f, t) for f in bad) / max(1, len(bad)) - quality.GOOD_WEIGHT * k / n) > gain:
                cut[lang], gain = (lambda f, t=t, hit=hit: hit(f, t)), now
    return [(d, not f[5] and not (lang in cut and cut[lang](f[6:]))) for d, lang, f in feats]


def test_judgement_and_filter_agree_with_brute_force(spark):
    prepare(spark)
    docs, labels = make(2, 900)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"kept": F.lit("x"), "n_words": F.lit(1)})
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("zz"))
    want = sorted(brute_kept(docs, labels, 0.05, 0.05), key=str)
    got = sorted(((x.doc_id, x.kept) for x in quality.judge(df, lf, 0.05, 0.05).collect()), key=str)
    assert got == want
    base = {d for d, t, _ in docs if not brute(t)[5]}
    assert any(not k and d in base for d, k in want), "some cutoff must act"
    out = quality.keep_good(df, lf, 0.05, 0.05)
    assert out.columns == df.columns
    assert sorted((x.doc_id for x in out.collect()), key=str) == sorted((d for d, k in want if k), key=str)


def test_each_rule_rejects_its_own(spark):
    """Shouted, repeated and symbol-heavy texts, each rejected by its rule, on unlike scales."""
    prepare(spark)
    r = random.Random(9)
    docs, labels = [], []
    for i in range(1200):
        words = [r.choice("abcde") + str(r.randrange(4000)) for _ in range(100)]
        kind = i % 10 if i % 10 < 3 else None
        if kind == 0:
            words[:12] = ["SHOUTED" + w.upper() for w in words[:12]]
        elif kind == 1:
            words[60:80] = words[:20]
        elif kind == 2:
            words[:30] = [w + "%" for w in words[:30]]
        docs.append((i, " ".join(words), "en"))
        if i % 3:
            labels.append((i, int(kind is None), 0))
    df, lf = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    symbol, shout, repeat = quality.fit_cutoffs(quality.features(df).checkpoint(), lf)["en"]
    assert shout < 12 and repeat < 40 and symbol < 30
    kept = {x.doc_id for x in quality.keep_good(df, lf).collect()}
    assert kept == {i for i in range(1200) if i % 10 > 2}


def test_the_largest_stratum_of_a_small_table_gets_cutoffs(spark):
    prepare(spark)
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    assert "en" in quality.fit_cutoffs(quality.features(docs).checkpoint(), labels)


def test_no_stratum_loses_more_than_alpha():
    """Of many samples of good levels the bound fails, by the true rate of the chosen level, in no more than delta."""
    r = random.Random(5)
    fails = 0
    for _ in range(300):
        rejected = [0] * 101
        for _ in range(600):
            for t in range(int(r.random() * 1000), 101):
                rejected[t] += 1
        t = quality.choose_level(rejected, 600, list(range(101)), 100, 0.02, 0.05)
        fails += t is not None and (t + 1) / 1000 > 0.02
    assert fails <= 0.05 * 300


def test_null_and_empty_lang_are_two_strata(spark):
    prepare(spark)
    docs = [(i, " ".join(f"{'%%' if i % 2 else ''}x{i}y{k}" for k in range(60)), "" if i < 700 else None) for i in range(900)]
    docs.append((5000, " ".join(f"long{k}" for k in range(100_000)), ""))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(900) if i % 7], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert quality.fit_cutoffs(quality.features(df), labels).keys() == {""}
    kept = {x.doc_id for x in quality.keep_good(df, labels).collect()}
    assert kept == {i for i in range(900) if i >= 700 or i % 2 == 0} | {5000}


def test_too_few_labels_give_no_cutoff():
    few, many = [0] * 101, [0] * 71 + [9] * 30
    assert quality.choose_level(few, 50, many, 9, 0.02, 0.01) is None
    assert quality.choose_level(few, 500, many, 9, 0.02, 0.01) == 71
    assert quality.choose_level([0] * 61 + [30] * 40, 500, [0] * 51 + [9] * 50, 9, 0.02, 0.01) == 51
    assert quality.choose_level([0] * 61 + [30] * 40, 500, [0] * 81 + [9] * 20, 9, 0.02, 0.01) == 0


def test_empty_tables(spark):
    prepare(spark)
    docs, labels = make(3, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.judge(df.limit(0), lf).count() == 0
    assert quality.keep_good(df.limit(0), lf.limit(0)).count() == 0
    assert quality.judge(df, lf.limit(0)).count() == len(docs)
