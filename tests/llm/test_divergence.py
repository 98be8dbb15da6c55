"""The audit against plain loops over every group, term and pair."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql.classic.dataframe import DataFrame

from tokenscope.llm import divergence
from tokenscope.llm.common import prepare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(far(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


def corpus():
    r = random.Random(5)
    vocabulary = ["Alpha", "ALPHA", "beta", "Été", "été", "gamma1delta", "x-y", "漢字", "𝒳y", "it's", "b\x00c", "\x7fz", "\xa0n"]
    rows = [(" ".join(r.choice(vocabulary) for _ in range(r.randrange(30))), r.choice(["en", "en", "fr", "", None]), r.choice(["a", "a", "b", "ç", "", None])) for _ in range(160)]
    rows += [(None, "en", "a"), ("", "en", "empty"), ("12 34", "xx", "s1"), (None, "xx", "s2"), ("once", "yy", "alone"), ("beta " * 30_000, "fr", "long")]
    return rows + rows[:5]


SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, p int, salt int, item string"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i % 7 or None, *x, "clash", 1, 2, 3, "c") for i, x in enumerate(rows)], SCHEMA)


def test_equals_loops(spark):
    rows = corpus()
    for min_docs, top in ((10, 10), (2, 3)):
        got = divergence.audit(frame(spark, rows).repartition(5), min_docs, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute(rows, min_docs, top)


def test_equals_loops_with_many_groups_and_small_portions(spark, monkeypatch):
    rows = corpus()
    for name, value in (("FEW", 0), ("HELD", 20), ("PIECE", 7)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows).repartition(3), 2, 3).collect())) == brute(rows, 2, 3)


def test_zeros_are_never_rows(spark, monkeypatch):
    # 40 terms, each in one of 40 sources: 40 counts, 1,600 with the zeros
    rows = [(f"term{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", f"s{i}") for i in range(40)] * 2
    written, checkpoint = [], DataFrame.checkpoint

    def spy(df, *args):
        out = checkpoint(df, *args)
        written.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", spy)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), 2, 10).collect())) == brute(rows, 2, 10)
    assert 0 < sum(written) <= 200


def test_pieces_are_cut_between_terms(monkeypatch):
    text = "Aß b-c\x00dd " + "x" * 30 + " E漢f"
    want = TERM.findall(text.translate(LOWER))
    for most in (1, 5, 1 << 22):
        monkeypatch.setattr(divergence, "PIECE", most)
        assert [t.decode() for terms in divergence._pieces(text.encode()) for t in terms] == want


def test_ties_take_the_smaller_item(spark):
    rows = [("aa bb", "en", "s")] * 10 + [("cc", "en", s) for s in "tu"] * 5
    got = [tuple(x) for x in divergence.audit(frame(spark, rows)).where("source = 's'").orderBy("part", "rank").collect()]
    assert [x[3] for x in got] == ["t", "u", "aa", "bb"]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == brute(rows, 10, 10)


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_shares_pass_64_bits(spark):
    df = spark.createDataFrame([(50_000_000_000, 90_000_000_000, 7)], "n long, total long, v long")
    assert df.select(divergence.share("n", "total").alias("p")).first().p == 1 + 10**9 * (50_000_000_000 + 2) // (90_000_000_000 + 14)
