import hashlib
import random
import struct

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tokenscope.llm import pieces
from tokenscope.llm.common import portions, prepare

EDGE = ["", " ", "  ", "a  b", " a b ", "a\nb\t c", "▁x", "é́ﬁ", "😀\x00x", "a\r\nb", "<s>x</s>", "<0x41>", "▁▁ ▁", "x" * 3000, " " * 100, "日本語 テキスト", "of.%%% the&&&"]


@pytest.fixture(scope="module")
def tools():
    with open(pieces.model_path(), "rb") as f:
        model = f.read()
    return pieces.Encoder(pieces.Vocabulary(model), 50), sentencepiece.SentencePieceProcessor(model_proto=model)


def unpack(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def test_edge_texts(tools):
    encoder, library = tools
    for t in EDGE:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert unpack(encoder.encode(t)) == ids, t
        assert encoder.decode(ids) == library.decode(ids), t


def test_random_texts(tools):
    encoder, library = tools
    r = random.Random(5)
    alphabet = "abcdefghij  \n.,%é世😀▁A1" + "the and ing tion "
    for _ in range(1500):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert unpack(encoder.encode(t)) == ids, t
        assert encoder.decode(ids) == library.decode(ids), t


def test_decoding_of_broken_bytes(tools):
    encoder, library = tools
    r = random.Random(6)
    for _ in range(300):
        ids = [r.randrange(0, 300) for _ in range(r.randrange(12))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_query_columns(spark):
    prepare(spark)
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(3, EDGE[3]), (None, "x"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    got = map(tuple, pieces.digests(df, pieces.model_path()).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.digests(df.limit(0), pieces.model_path()).count() == 0


def test_agrees_compares_the_own_decoding(spark, monkeypatch):
    prepare(spark)
    df = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    out = pieces.encode_texts(df, pieces.model_path(), ["doc_id"])
    assert all(x[-1] for x in out.collect())
    # the workers' own decoding is at fault here, the ids are right
    broken = type("Broken", (pieces.Encoder,), {"decode": lambda self, ids: "wrong"})
    seen = {}
    monkeypatch.setattr(pieces, "_tools", lambda model: (broken(pieces.Vocabulary(model)), sentencepiece.SentencePieceProcessor(model_proto=model)))
    monkeypatch.setattr(pieces, "map_batches", lambda df, fn, schema: seen.setdefault("fn", fn))
    pieces.encode_texts(df, pieces.model_path(), ["doc_id"])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    assert seen["fn"](batch).column(3).to_pylist() == [False]


WORDS = ["tion", "The", "schung.", "ciónllqueue", "ble.\nOuer", "of.%%%", "日本語", "é́ﬁ", "😀x", "x" * 70, "\t", "<0x41>", "", "onoutionnt"]


def test_words_are_encoded_together(tools):
    library = tools[1]
    encoder = pieces.Encoder(tools[0].v, 50)
    r = random.Random(7)
    texts = [" ".join("".join(r.choice(WORDS[:4] + list("aeinrst")) for _ in range(r.randrange(1, 6))) for _ in range(80)) for _ in range(40)]
    want = library.encode(texts, add_bos=True, add_eos=True)
    one_by_one = encoder.parts.make
    encoder.parts.make = lambda part: pytest.fail(f"{part!r} was encoded alone")
    assert [unpack(x) for x in encoder.encode_all(texts)] == want
    # long parts and characters of several bytes have no place there
    encoder.parts.make = one_by_one
    mixed = EDGE + [" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(40)] + ["a " + "x" * 200 + " b", "trailing "]
    r.shuffle(mixed)
    assert [unpack(x) for x in encoder.encode_all(mixed)] == library.encode(mixed, add_bos=True, add_eos=True)
    assert encoder.encode_all([]) == []


@pytest.mark.parametrize("name", ["MAX_TABLE", "BLOCK"])
def test_words_encoded_together_without_table_and_in_small_blocks(tools, monkeypatch, name):
    monkeypatch.setattr(pieces, name, 7)
    encoder = pieces.Encoder(tools[0].v, 50)
    assert (encoder.agendas.table is None) == (name == "MAX_TABLE")
    texts = [" ".join(WORDS[i:] + WORDS[:i]) for i in range(len(WORDS))]
    assert [unpack(x) for x in encoder.encode_all(texts)] == tools[1].encode(texts, add_bos=True, add_eos=True)


def test_equal_scores_are_joined_from_the_left():
    # aa and ab have one score: of a, a, b the left pair is joined first, whatever the pieces' order
    v = pieces.Vocabulary.__new__(pieces.Vocabulary)
    v.pieces = ["ab", "aa", "a", "b", "▁"]
    v.ids, v.rank = {p: i for i, p in enumerate(v.pieces)}, {"ab": 1.0, "aa": 1.0, "a": 3.0, "b": 3.0, "▁": 3.0}
    v.joined, v.bytes, v.fallback = {"ab", "aa"}, {}, False
    ids, sizes, done = pieces.Agendas(v).encode("▁aab▁abaa▁c")
    assert ids.tolist() == [4, 1, 3, 4, 0, 1] and sizes.tolist() == [3, 3, 0] and done.tolist() == [True, True, False]


def test_portions_hold_every_text():
    texts = ["abc", "", "x" * 20, "de", "f", "g" * 9]
    parts = list(portions(texts, 10))
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 10 for p in parts)
    assert list(portions([], 10)) == []
