import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenscope.llm import tokencount
from tokenscope.llm.common import prepare

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = tokencount.Tokenizer(PATH, PATTERN)
PARTS = st.lists(st.sampled_from(["the", " ", "  ", "\n", "'", "ll", "'s", "r", "e", "12", "%%", "é", "世", "\t", " a", "word"]), max_size=30).map("".join)


def total(text):
    return len(TOKENIZER.library.encode_ordinary(text))


def check(tree):
    """Sums hold everywhere and the leaves are the text's pre-tokens."""
    lengths = []

    def walk(node):
        if node.left is None:
            lengths.extend(node.lengths)
            assert (node.length, node.tokens) == (sum(node.lengths), sum(node.counts))
        else:
            walk(node.left)
            walk(node.right)
            assert (node.length, node.tokens) == (node.left.length + node.right.length, node.left.tokens + node.right.tokens)

    walk(tree.root)
    assert lengths == [len(x) for x in TOKENIZER.pattern.findall(tree.text)]
    assert tree.tokens == total(tree.text)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30), PARTS), max_size=5))
def test_edits_equal_counting_anew(text, edits):
    tree = tokencount.Tree(text, TOKENIZER)
    for at, deleted, inserted in edits:
        cut = min(at, len(text))
        text = text[:cut] + inserted + text[cut + deleted :]
        tree.edit(at, deleted, inserted)
        assert tree.text == text
        check(tree)


def test_long_texts_re_encode_little():
    r = random.Random(1)
    tree = tokencount.Tree(" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(20_000)), TOKENIZER)
    for _ in range(200):
        tree.edit(r.randrange(len(tree.text)), r.randrange(10), r.choice(["", " x", "yy", "\n" * 5, " new words" * 40]))
    check(tree)
    assert tree.reencoded < 200 * 250


def test_query_equals_brute_force(spark):
    prepare(spark)
    rows = [(1, "one two  three's\n four"), (2, ""), (3, None), (1, "one two  three's\n four"), (None, "x"), (4, "日本語 " * 50), (5, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"edits": F.lit(1), "n_after": F.lit("x")})
    want = []
    for d, t in rows:
        t = t or ""
        n, after = len(t), t
        for at, deleted, inserted in [(0, 1, ""), (n // 3, 12, " a revised passage 2024"), (n * 2 // 3, 0, "\n\n"), (n + 12, 0, " The end.")]:
            at = min(at, len(after))
            after = after[:at] + inserted + after[at + deleted :]
        want.append((d, total(t), total(after), 4, len(after)))
    out = tokencount.count_edits(df, tokencount.sample_edits, ["doc_id"], PATH, PATTERN).drop("n_reencoded")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert tokencount.count_edits(df.limit(0), tokencount.sample_edits, ["doc_id"], PATH, PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(PARTS, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30), PARTS), max_size=4))
def test_kept_trees_are_edited_without_encoding_the_rest(text, edits):
    tree = tokencount.Tree(text * 9, TOKENIZER)
    for at, deleted, inserted in edits:
        kept = tokencount.Tree(tree.text, None, tree.to_bytes())
        assert kept.tokens == tree.tokens and kept.to_bytes() == tree.to_bytes()
        kept.tokenizer = TOKENIZER
        kept.edit(at, deleted, inserted)
        tree.edit(at, deleted, inserted)
        check(kept)
        assert kept.to_bytes() == tree.to_bytes()


def test_edits_in_two_steps_through_stored_trees(spark, tmp_path):
    prepare(spark)
    rows = [(1, "one two  three's\n four " * 40), (2, ""), (3, None), (1, "again"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokencount.build_trees(df, ["doc_id"], PATH, PATTERN).write.parquet(f"{tmp_path}/trees")
    once = tokencount.apply_edits(spark.read.parquet(f"{tmp_path}/trees"), tokencount.sample_edits(F.col("_ts_text")), ["doc_id"], PATH, PATTERN)
    twice = tokencount.apply_edits(once, tokencount.sample_edits(F.col("_ts_text")), ["doc_id"], PATH, PATTERN).collect()
    assert all(r.n_after == total(r._ts_text) and r.n_chars_after == len(r._ts_text) for r in twice) and len(twice) == len(rows)
    broken = once.withColumn("_ts_tree", F.lit(None).cast("binary")).union(once.withColumn("_ts_tree", F.lit(b"12345678")))
    again = tokencount.apply_edits(broken, F.lit(None).cast("array<struct<at:long,deleted:long,inserted:string>>"), ["doc_id"], PATH, PATTERN).collect()
    assert all(r.n_before == r.n_after == total(r._ts_text) for r in again)


def test_the_tree_of_another_text_of_equal_length_is_not_taken():
    one, other = "a b c d e f g h i j k l m n", "abcdefghijklmnopqrstuvwxyz!"
    kept = tokencount.Tree(one, TOKENIZER).to_bytes()
    assert len(one) == len(other) and tokencount.Tree(one, TOKENIZER, kept).tokens == total(one)
    assert tokencount.Tree(other, TOKENIZER, kept).tokens == total(other) != total(one)
    assert tokencount.Tree(one, TOKENIZER, kept[:-8]).tokens == total(one)


def test_vocabulary_must_be_there():
    with pytest.raises(FileNotFoundError):
        tokencount.Tokenizer("/nowhere", PATTERN)
