"""Alignment of two tokenizers over the same texts.

Each text is encoded by a byte-level BPE vocabulary (A, with a space before the text) and by a SentencePiece vocabulary
(B, which adds the space itself). An A and a B token are linked where their byte ranges overlap; tokens and links make a
bipartite graph, whose connected components, found by union-find, are the minimal groups: byte runs that both tokenizers
end together. Links are counted corpus-wide per pair of ids, and each text gets sums over its links.

Words: texts are cut before each space that follows no white space. There A's pattern always splits and no B piece goes
across (``Tokenizers`` checks the vocabulary), so that words are encoded on their own with the same ids and no token, link or
group crosses a cut. Ids, groups and links of words are kept in a bounded memory per Python worker, which changes no result.

Counts: each task cuts its texts, as they come, into blocks, and a few blocks make a chunk. Encoded once, a block is kept in
compact form (word numbers per text, links per word), and a chunk gives its pairs with their counts; both are written by one
checkpoint. Pairs are summed over all chunks, a B id's highest count follows from the sums (at most one row per B id, so it
may be broadcast), and each chunk is sent the counts of the pairs it holds. Work per task is bounded by the size of a block
and the pairs of a chunk; texts are never shuffled.

Defined cases: null, empty, and texts whose tokens don't join to the text with a space before it (a text that holds the
space mark U+2581) have no tokens: zeros, and an empty string in place of the digest; special tokens' strings are plain
text; ties for a B id's highest count all count; repeated rows count each; null or repeated doc_ids are kept, as rows aren't
joined by them; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.common import table

#: Pair of ids as one number: a * B_IDS + b.
B_IDS = 1 << 15
MARK = "▁"
#: Words of a block, blocks of a chunk, words kept in memory.
BLOCK_WORDS, CHUNK_BLOCKS, MAX_KNOWN = 300_000, 8, 300_000
#: Rows with up to so many pairs each carry a chunk's counts.
PAIRS_ROW = 8192
#: Characters from here on are left to A's library itself, as tables of character classes differ between engines.
PLAIN = 0x250
CUT, WIDE = re.compile(r"(?<!\s) "), re.compile(r"\s ")
STATS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next free from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both vocabularies, their token bytes, and ids of words (texts with one space before them)."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            described = json.load(f)
        special = {x["id"] for x in described["added_tokens"]}
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(map(alphabet.__getitem__, x)) for x, i in described["model"]["vocab"].items() if i not in special}
        ranks = {x: i for i, x in self.a_bytes.items()}
        merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in described["model"]["merges"]]
        if [ranks[bytes(map(alphabet.__getitem__, x))] for x in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("ids of the byte-level vocabulary don't follow its merges")
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(a_path)
        self.exact.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in x.lstrip(MARK) for x in pieces):
            raise ValueError("a piece of the vocabulary goes across the beginning of a word")
        if len(pieces) > B_IDS:
            raise ValueError("too many pieces")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)]
        self.a_length = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        self.a_length[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_length = np.array(list(map(len, self.b_bytes)), dtype=np.int64)

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        plain = [max(x, default="") < chr(PLAIN) for x in words]
        other = iter(self.exact.encode_batch([" " + x for x, p in zip(words, plain) if not p], add_special_tokens=False))
        quick, space = self.fast.encode_ordinary, [self.b.piece_to_id(MARK)]
        # the library adds no space to an empty string, as a space at the end of a text leaves
        return [quick(" " + x) if p else next(other).ids for x, p in zip(words, plain)], [x or space for x in self.b.encode(words, num_threads=1)]


def words_of(text: str) -> list[str]:
    """The text cut before spaces that follow no white space; each word without the space before it."""
    return CUT.split(" " + text)[1:] if text[:1] == " " or WIDE.search(text) else text.split(" ")


def link(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and B tokens that overlap, from the byte offsets where tokens end; both cover the same bytes."""
    ends = np.union1d(a_ends, b_ends)
    starts = np.concatenate([[0], ends[:-1]])
    return np.searchsorted(a_ends, starts, "right"), np.searchsorted(b_ends, starts, "right")


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of each node's component by union-find: roots are hooked to lesser roots, paths are halved until they are flat."""
    parent = np.arange(n)
    while True:
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        if not apart.any():
            return parent
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _joined(pieces: list[str], first: np.ndarray) -> list[str]:
    """Strings of runs of pieces that begin at first, pieces joined by commas."""
    marks = first.tolist() + [len(pieces)]
    return [",".join(pieces[i:j]) for i, j in zip(marks, marks[1:])]


class Words:
    """Numbers of words, with their counts, links and groups."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.stats = np.zeros((0, len(STATS)), dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.keys = np.zeros(0, dtype=np.int32)

    def numbers(self, words: list[str]) -> np.ndarray:
        found = list(map(self.number.get, words))
        if None in found:
            self.add(list(dict.fromkeys(w for w, i in zip(words, found) if i is None)))
            found = list(map(self.number.__getitem__, words))
        return np.array(found, dtype=np.int64)

    def add(self, words: list[str]) -> None:
        t, n = self.tokenizers, len(words)
        a, b = t.encode(words)
        good = np.array([b"".join(map(t.a_bytes.__getitem__, x)) == (w := b" " + word.encode()) == b"".join(map(t.b_bytes.__getitem__, y)) for word, x, y in zip(words, a, b)], dtype=bool)
        a, b = ([x if g else [] for x, g in zip(ids, good)] for ids in (a, b))
        n_a, n_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (a, b))
        a, b = (np.array([i for x in ids for i in x], dtype=np.int64) for ids in (a, b))
        at_a, at_b = link(np.cumsum(t.a_length[a]), np.cumsum(t.b_length[b]))
        root = components(len(a) + len(b), at_a, at_b + len(a))
        # components are runs in the order of the text: a new one begins where the root changes
        first_a = np.flatnonzero(np.diff(root[: len(a)], prepend=-1))
        first_b = np.flatnonzero(np.diff(root[len(a) :], prepend=-1))
        groups = [f"{x}|{y}" for x, y in zip(_joined(list(map(str, a.tolist())), first_a), _joined(list(map(str, b.tolist())), first_b))]
        word_of_a = np.repeat(np.arange(n), n_a)
        n_groups, n_links = np.bincount(word_of_a[first_a], minlength=n), np.bincount(word_of_a[at_a], minlength=n)
        marks = [0, *np.cumsum(n_groups).tolist()]
        base = len(self.text)
        self.number.update(zip(words, range(base, base + n)))
        self.text += [";".join(groups[i:j]) for i, j in zip(marks, marks[1:])]
        self.stats = np.concatenate([self.stats, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.good = np.concatenate([self.good, good])
        self.keys = np.concatenate([self.keys, (a[at_a] * B_IDS + b[at_b]).astype(np.int32)])


@lru_cache(maxsize=1)
def _words(a_path: str, b_path: str, pattern: str) -> Words:
    return Words(Tokenizers(a_path, b_path, pattern))


def _digest(known: Words, numbers: np.ndarray) -> str:
    done = hashlib.sha256()
    for i in range(0, len(numbers), BLOCK_WORDS):
        done.update(((";" if i else "") + ";".join([known.text[x] for x in numbers[i : i + BLOCK_WORDS]])).encode())
    return done.hexdigest()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of runs that begin at starts."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def encode_block(known: Words, doc_ids: list[int | None], words: list[list[str]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A block's texts in compact form, and its pairs with the number of their links. No words: a text without tokens."""
    lengths = np.array(list(map(len, words)), dtype=np.int64)
    numbers = known.numbers([w for x in words for w in x])
    ends = np.cumsum(lengths)
    bad = np.array([n > 0 and not known.good[numbers[e - n : e]].all() for n, e in zip(lengths, ends)], dtype=bool)
    numbers, lengths = numbers[~np.repeat(bad, lengths)], np.where(bad, 0, lengths)
    ends = np.cumsum(lengths)
    sums = np.concatenate([np.zeros((1, len(STATS)), dtype=np.int64), np.cumsum(known.stats[numbers], axis=0)])
    stats = sums[ends] - sums[ends - lengths]
    shas = [_digest(known, numbers[e - n : e]) if n else "" for n, e in zip(lengths, ends)]
    held, local, times = np.unique(numbers, return_inverse=True, return_counts=True)
    n_links = known.stats[held, 3]
    keys = known.keys[ragged((np.cumsum(known.stats[:, 3]) - known.stats[:, 3])[held], n_links)]
    row = [pa.array(doc_ids, type=pa.int64()), *(pa.array(stats[:, i]) for i in range(len(STATS))), pa.array(shas, type=pa.string()), pa.array(lengths)]
    row += [pa.array(local.astype(np.int32)), pa.array(n_links), pa.array(keys)]
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), x) for x in row], names=list(map(str, range(len(row)))))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    pairs, at = np.unique(keys, return_inverse=True)
    return sink.getvalue().to_pybytes(), pairs, np.bincount(at, weights=np.repeat(times, n_links), minlength=len(pairs)).astype(np.int64)


ENCODED = "chunk string, block binary, keys array<int>, counts array<long>"


def encode(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """ENCODED: rows with a block, and rows with pairs of a chunk, for all rows of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, schema = _words(a_path, b_path, pattern), TaskContext.get().partitionId(), None
        ids: list[int | None] = []
        words: list[list[str]] = []
        size, chunk, blocks, pairs = 0, 0, 0, []

        def rows(block: list, keys: list, counts: list) -> pa.RecordBatch:
            columns = [pa.array([f"{task}-{chunk}"] * len(block)), pa.array(block, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int32())), pa.array(counts, type=pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "block", "keys", "counts"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, blocks
            if len(known.number) > MAX_KNOWN:
                known.clear()
            block, keys, counts = encode_block(known, ids, words)
            ids.clear(), words.clear()
            size, blocks = 0, blocks + 1
            pairs.append((keys, counts))
            yield rows([block], [None], [None])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, blocks
            keys, at = np.unique(np.concatenate([x[0] for x in pairs]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([x[1] for x in pairs]), minlength=len(keys)).astype(np.int64)
            cuts = range(0, len(keys), PAIRS_ROW)
            if cuts:
                yield rows([None] * len(cuts), [keys[i : i + PAIRS_ROW] for i in cuts], [counts[i : i + PAIRS_ROW] for i in cuts])
            pairs.clear()
            chunk, blocks = chunk + 1, 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc)
                words.append(words_of(text) if text else [])
                size += len(words[-1]) + 1
                if size >= BLOCK_WORDS:
                    yield from flush()
                    if blocks >= CHUNK_BLOCKS:
                        yield from close()
        if ids:
            yield from flush()
        if pairs:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT of blocks; rows come by chunk, a chunk's counts (key, total, best) before its blocks."""
    at, parts, sorted_ = None, [], None
    for batch in batches:
        chunks = batch.column(0)
        cuts = [0, *(i for i in range(1, len(chunks)) if chunks[i] != chunks[i - 1]), len(chunks)]
        for i, j in zip(cuts, cuts[1:]):
            if chunks[i].as_py() != at:
                at, parts, sorted_ = chunks[i].as_py(), [], None
            rows = batch.slice(i, j - i)
            pairs = rows.filter(pc.is_null(rows.column(1)))
            if pairs.num_rows:
                parts.append([pairs.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)])
            for block in rows.column(1).drop_null():
                if sorted_ is None:
                    keys, totals, best = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 3
                    order = np.argsort(keys)
                    sorted_ = keys[order], totals[order], best[order].astype(np.int64)
                yield _finish(block.as_py(), *sorted_)


def _finish(block: bytes, keys: np.ndarray, totals: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    with pa.ipc.open_stream(block) as source:
        doc_ids, *stats, shas, lengths, local, n_links, held = (x.values for x in source.read_next_batch().columns)
    lengths, local, n_links, held = (x.to_numpy(zero_copy_only=False) for x in (lengths, local, n_links, held))
    where = np.searchsorted(keys, held)
    ends = np.cumsum(n_links)

    def per_text(values: np.ndarray) -> pa.Array:
        run = np.concatenate([[0], np.cumsum(values[where])])
        words = run[ends] - run[ends - n_links]
        run, last = np.concatenate([[0], np.cumsum(words[local])]), np.cumsum(lengths)
        return pa.array((run[last] - run[last - lengths]).astype(np.int64))

    out = [doc_ids, *stats, per_text(best), per_text(totals), shas]
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """RESULT for every row of docs (doc_id, text)."""
    encoded = encode(docs, a_path, b_path, pattern).checkpoint()
    blocks = encoded.where("block is not null").select("chunk", "block")
    pairs = encoded.where("block is null").select("chunk", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("chunk", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    totals = pairs.groupBy("key").agg(F.sum("n").alias("total")).checkpoint()
    b = F.pmod(F.col("key"), F.lit(B_IDS))
    highest = totals.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))
    counts = totals.join(F.broadcast(highest), b == F.col("b")).select("key", "total", (F.col("total") == F.col("highest")).alias("best"))
    asked = pairs.select("chunk", "key").join(counts, "key")
    n_chunks = max(1, blocks.select("chunk").distinct().count())
    both = asked.select("chunk", F.lit(None).cast("binary").alias("block"), "key", "total", "best").unionByName(blocks, allowMissingColumns=True)
    return both.repartition(n_chunks, "chunk").sortWithinPartitions("chunk", F.col("block").isNotNull()).mapInArrow(_sum_up, RESULT)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
