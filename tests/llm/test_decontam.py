import random

import pytest
from pyspark.sql import functions as F

from tokenscope.llm import decontam
from tokenscope.llm.alignment import best_in
from tokenscope.llm.common import prepare

SYLLABLES = "th er on an re he in ed nd ha ti es or tion ing é ñ".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def brute(items, text):
    data = decontam.codes(decontam.normal(text or ""))
    out = []
    for i, x in items:
        p = decontam.codes(x)
        if best_in(p, data, 0, len(data) + len(p)) <= int(decontam.BUDGET * len(p)):
            out.append(i)
    return out


def corpus(seed):
    r = random.Random(seed)
    bench = [(i, prose(r, r.randrange(12, 40))) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (None, prose(r, 20))]
    rows = []
    for i in range(80):
        text = prose(r, r.randrange(0, 60))
        if i % 2:
            item = r.choice(bench[:12])[1]
            chars = list(item)
            for _ in range(int(len(item) * r.choice([0, 0.02, 0.06, 0.075, 0.1]))):
                k = r.randrange(len(chars))
                chars[k] = r.choice(["", "q", chars[k] + "x"])
            item = "".join(chars)
            text = text + r.choice([" ", "\n ", "%"]) + (item.upper() if i % 3 else item) + r.choice(["", ".", " "]) + prose(r, r.randrange(30))
        rows.append((i, text))
    return bench, rows + [(1, rows[1][1]), (None, rows[3][1]), (200, None), (201, ""), (202, "x")]


def test_equals_brute_force(spark):
    prepare(spark)
    bench, rows = corpus(1)
    b = spark.createDataFrame(bench, "item_id long, text string")
    items = decontam.load_items(b)
    assert len(items) == 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(0))
    want = sorted(((d, brute(items, t)) for d, t in rows), key=str)
    got = sorted(((x[0], x[1]) for x in decontam.found_items(docs, b, ["doc_id"]).collect()), key=str)
    assert got == want
    assert 20 < sum(bool(x) for _, x in want) < 60
    kept = decontam.drop_leaks(docs, b)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((d for d, x in want if not x), key=str)


def test_many_texts_at_once():
    bench, rows = corpus(2)
    index = decontam.Index(tuple((i, decontam.normal(t)) for i, t in bench[:12]))
    texts = [decontam.normal(t or "") for _, t in rows] * 3
    alone = [index.search_all([t])[0] for t in texts]
    assert index.search_all(texts) == alone


def test_empty_tables(spark):
    prepare(spark)
    bench, rows = corpus(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert decontam.found_items(docs.limit(0), b, ["doc_id"]).count() == 0
    assert decontam.drop_leaks(docs, b.limit(0)).count() == len(rows)


def test_short_items_are_found_as_whole_words(spark):
    prepare(spark)
    b = spark.createDataFrame([(1, "What is 2+2?"), (2, "too short"), (3, "???"), (4, " ")], "item_id long, text string")
    rows = [(1, "so: WHAT  is 2+2? Four"), (2, "It is Too\nshort."), (3, "too shorts, stoo short"), (4, "x??? y"), (5, "too, short"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: x[1] for x in decontam.found_items(docs, b, ["doc_id"]).collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: [3], 5: [], 6: []}
    assert sorted(x.doc_id for x in decontam.drop_leaks(docs, b).collect()) == [3, 5, 6]


LATIN, CYRILLIC, HAN = "abcdeéñopqr", "абвгдежзийк", "的一是不了人我在有他这"


def text_of(r, letters, n):
    """n characters; words of 2 to 6 in scripts that have them."""
    if letters == HAN:
        return "".join(r.choice(letters) for _ in range(n))
    out = ""
    while len(out) < n:
        out += "".join(r.choice(letters) for _ in range(r.randrange(2, 7))) + " "
    return (out[: n - 1] + r.choice(letters))[:n]


@pytest.mark.parametrize("letters", [LATIN, CYRILLIC, HAN])
def test_items_of_any_length_and_script(spark, letters):
    """Items of 1 to 60 characters against alignment, or against every place where they stand whole."""
    prepare(spark)
    r = random.Random(ord(letters[0]))
    bench = [(n, text_of(r, letters, n)) for n in range(1, 61)] + [(100, "x"), (101, "x")]
    rows = []
    for n, item in bench * 2:
        chars = list(item)
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            chars[r.randrange(len(chars))] = r.choice([r.choice(letters), "", r.choice(letters) * 2])
        rows.append((len(rows), text_of(r, letters, r.randrange(1, 80)) + r.choice([" ", "", ", "]) + "".join(chars) + r.choice([" ", "", "."]) + text_of(r, letters, r.randrange(1, 40))))
    rows.append((len(rows), text_of(r, letters, 200_000) + " " + bench[44][1]))

    def whole(item, text):
        word = lambda c: c.isalnum() and letters != HAN
        for at in range(len(text) - len(item) + 1):
            end = at + len(item)
            if text[at:end] == item and not (at and word(item[0]) and word(text[at - 1])) and not (end < len(text) and word(item[-1]) and word(text[end])):
                return True
        return False

    def want(text):
        text = decontam.normal(text)
        data, out = decontam.codes(text), []
        for i, x in bench:
            x = decontam.normal(x)
            if len(x) < decontam.EXACT:
                out += [i] * whole(x, text)
            elif len(text) < 1000 and best_in(decontam.codes(x), data, 0, len(text) + len(x)) <= int(decontam.BUDGET * len(x)):
                out.append(i)
        return sorted(out)

    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {x[0]: x[1] for x in decontam.found_items(spark.createDataFrame(rows, "doc_id long, text string"), b, ["doc_id"]).collect()}
    for d, text in rows[:-1]:
        assert got[d] == want(text), (d, text)
    assert 45 in got[len(rows) - 1]


def test_items_of_15_characters_have_their_edit(spark):
    prepare(spark)
    b = spark.createDataFrame([(15, "abcdefgh ijklmn"), (16, "opqrstuv wxyzabc"), (14, "hgfedcba nmlkj")], "item_id long, text string")
    texts = ["xx abcdefgh ijklmn yy", "xx abcdeXgh ijklmn yy", "xabcdefghijklmny", "abcXefgh iXklmn", "xx opqrstXv wxyzabcd", "z hgfedcba nmlkj z", "z hgfedXba nmlkj z", "zhgfedcba nmlkjz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x[0]: x[1] for x in decontam.found_items(docs, b, ["doc_id"]).collect()}
    assert got == {0: [15], 1: [15], 2: [15], 3: [], 4: [16], 5: [14], 6: [], 7: []}
    assert sorted(x.doc_id for x in decontam.drop_leaks(docs, b).collect()) == [3, 6, 7]
