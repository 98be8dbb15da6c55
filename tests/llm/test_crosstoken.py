"""Alignment against whole texts encoded by both libraries and groups found in plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tokenscope.llm import crosstoken
from tokenscope.llm.common import prepare, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """RESULT rows of (doc_id, text)."""
    a_library, b_library = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_library.encode_special_tokens = True
    alphabet, counts, found = crosstoken.byte_alphabet(), Counter(), []
    for doc, text in rows:
        ids_a = a_library.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_library.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a_library.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b_library.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((doc, [], [], [], []))
            continue
        links, groups, i, j, at_a, at_b, group_a, group_b = [], [], 0, 0, 0, 0, [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b:
                group_a.append(ids_a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                group_b.append(ids_b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                groups.append((group_a, group_b))
                group_a, group_b = [], []
        spans = lambda xs: [(sum(map(len, xs[:k])), sum(map(len, xs[: k + 1]))) for k in range(len(xs))]
        if len(ids_a) < 400:
            span_a, span_b = spans(bytes_a), spans(bytes_b)
            links = [(ids_a[i], ids_b[j]) for i, x in enumerate(span_a) for j, y in enumerate(span_b) if x[0] < y[1] and y[0] < x[1]]
        else:
            owner_a, owner_b = ([k for k, x in enumerate(xs) for _ in x] for xs in (bytes_a, bytes_b))
            links = [(ids_a[i], ids_b[j]) for i, j in sorted(set(zip(owner_a, owner_b)))]
        counts.update(links)
        found.append((doc, ids_a, ids_b, groups, links))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc, ids_a, ids_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


def corpus():
    r = random.Random(4)
    bits = ["the", "ouieré", "don't", "I'll", "漢字", "𝒳𝒴", "naïve", "<s>", "</s>", "<|endoftext|>", "<0x41>", "x\x00y", "\x1c", "　", "\xa0", "é", "ﬁ", "🙂👍", "1234567", "$$%", "�", "ǅ", "ɐb"]
    gaps = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\t", "\r\n", "\xa0 ", "  ", "   ", ""]
    rows = [(i, "".join(r.choice(bits) + r.choice(gaps) for _ in range(r.randrange(40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (503, "   "), (504, "a ▁ b"), (505, "▁"), (None, "no id"), (506, "x" * 5000), (507, "one two " * 4000), (508, " lead"), (509, "end ")]
    return rows + rows[:4]


SCHEMA = "doc_id long, text string, chunk string, key int, block string"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*x, "clash", 1, "b") for x in rows], SCHEMA)


def run(df):
    return sorted(map(tuple, crosstoken.align(df, A, B, public_tokenizers.PATTERN).collect()), key=str)


def test_equals_whole_texts(spark):
    rows = corpus()
    assert run(frame(spark, rows).repartition(3)) == brute(rows)


def test_small_blocks_and_chunks(spark, monkeypatch):
    rows = corpus()[:40]
    words = crosstoken.Words(crosstoken.Tokenizers(A, B, public_tokenizers.PATTERN))
    one = crosstoken.encode_block(words, [x[0] for x in rows], [crosstoken.words_of(x[1]) if x[1] else [] for x in rows])
    total = Counter()
    for row in rows:
        _, keys, counts = crosstoken.encode_block(words, [row[0]], [crosstoken.words_of(row[1]) if row[1] else []])
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    assert total == dict(zip(one[1].tolist(), one[2].tolist()))


def test_given_table(spark):
    prepare(spark)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    assert run(docs) == brute(rows)


def test_components():
    r = random.Random(1)
    for _ in range(50):
        n = r.randrange(1, 60)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(50))]
        label = list(range(n))
        for _ in range(n):
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        u, v = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
        assert crosstoken.components(n, u, v).tolist() == label


def test_empty_table(spark):
    assert run(frame(spark, [])) == []
