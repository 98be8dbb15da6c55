"""Edit-aware token counts.

A document's pre-tokens are the leaves of a binary tree: leaf nodes hold runs of up to BLOCK pre-tokens with
their lengths and token counts, inner nodes the sums below them. An edit re-encodes from the pre-token that
holds the second character before it (a match of the pre-token pattern looks at no more than one character
past its end's neighbour, so earlier ones stand), and stops as soon as a new pre-token ends where an old one
ended behind the edit: from there on the pattern finds the same pre-tokens. Only the nodes touched and the
sums on their paths to the root change.

Trees are kept: build_trees gives each document's tree as bytes (lengths and counts of its pre-tokens), and
apply_edits takes texts, trees and edits to new texts, trees and counts, without encoding what no edit touches. A tree
is balanced when it is read; edits split leaves where they are.

Defined cases: null texts and null edit lists count as empty; a null tree, one of another text (a tree holds its
text's digest), or a damaged one is built anew; positions and lengths are code points and are
cut to the text; edits apply in their order, each to the text that the ones before left; every row gives one
result row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.common import OWN, map_batches, table, texts_of

BLOCK = 64
CONTEXT = 2
MAX_KNOWN = 300_000


class Counts(dict):
    """Token counts of pre-tokens; emptied when full, which changes no result."""

    def __init__(self, count: Callable[[str], int], limit: int = MAX_KNOWN) -> None:
        self.count, self.limit = count, limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[piece] = self.count(piece)
        return n


class Tokenizer:
    """Pre-token pattern and counts of a byte-level vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts = Counts(lambda piece: len(self.library.encode_ordinary(piece)))

    def split(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the pre-tokens of text."""
        pieces = self.pattern.findall(text)
        return list(map(len, pieces)), list(map(self.counts.__getitem__, pieces))


def text_digest(text: str) -> bytes:
    """Eight bytes that tell the tree of one text from that of another."""
    import xxhash

    return xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass"))


class Node:
    __slots__ = ("counts", "left", "length", "lengths", "parent", "right", "tokens")

    def __init__(self, lengths: list[int], counts: list[int], parent: Node | None) -> None:
        self.parent, self.left, self.right = parent, None, None
        self.fill(lengths, counts)

    def fill(self, lengths: list[int], counts: list[int]) -> None:
        """Hold these pre-tokens: as a leaf, or, if there are too many, as a balanced subtree."""
        self.length, self.tokens = sum(lengths), sum(counts)
        if len(lengths) <= BLOCK:
            self.lengths, self.counts, self.left, self.right = lengths, counts, None, None
        else:
            half = (len(lengths) + 1) // 2
            self.lengths = self.counts = None
            self.left, self.right = Node(lengths[:half], counts[:half], self), Node(lengths[half:], counts[half:], self)

    def refresh(self) -> None:
        """Sums on the way to the root."""
        node = self.parent
        while node is not None:
            node.length = node.left.length + node.right.length
            node.tokens = node.left.tokens + node.right.tokens
            node = node.parent

    def next_leaf(self) -> Node | None:
        node = self
        while node.parent is not None and node is node.parent.right:
            node = node.parent
        if node.parent is None:
            return None
        node = node.parent.right
        while node.left is not None:
            node = node.left
        return node


class Tree:
    """A document's text with its pre-tokens."""

    def __init__(self, text: str, tokenizer: Tokenizer, kept: bytes | None = None) -> None:
        self.text, self.tokenizer, self.reencoded = text, tokenizer, 0
        if kept is not None and len(kept) >= 8 and len(kept) % 8 == 0 and kept[:8] == text_digest(text):
            both = np.frombuffer(kept, dtype="<u4", offset=8).reshape(2, -1)
            if int(both[0].sum()) == len(text):
                self.root = Node(both[0].tolist(), both[1].tolist(), None)
                return
        self.root = Node(*tokenizer.split(text), None)

    def to_bytes(self) -> bytes:
        """The text's digest, then lengths, then counts, of all pre-tokens, as unsigned 32-bit integers."""
        lengths, counts, stack = [], [], [self.root]
        while stack:
            node = stack.pop()
            if node.left is None:
                lengths += node.lengths
                counts += node.counts
            else:
                stack += [node.right, node.left]
        return text_digest(self.text) + np.array([lengths, counts], dtype="<u4").tobytes()

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def _find(self, at: int) -> tuple[Node, int, int]:
        """(leaf, number in it, its beginning) of the pre-token that holds character at, or of the last one."""
        node, start = self.root, 0
        while node.left is not None:
            if at < start + node.left.length or node.right.length == 0:
                node = node.left
            else:
                start += node.left.length
                node = node.right
        for i, n in enumerate(node.lengths):
            if at < start + n:
                return node, i, start
            start += n
        return node, len(node.lengths), start

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replace deleted characters from at on by inserted."""
        at = max(0, min(at, len(self.text)))
        end = min(at + max(0, deleted), len(self.text))
        shift = len(inserted) - (end - at)
        self.text = text = self.text[:at] + inserted + self.text[end:]
        leaf, number, start = self._find(max(0, at - CONTEXT))
        first, kept = leaf, (leaf.lengths[:number], leaf.counts[:number])
        match, count = self.tokenizer.pattern.match, self.tokenizer.counts
        lengths, counts = [], []
        old, new, touched = start, start, []
        while True:
            # the end, in the old text, of the next pre-token to replace
            while leaf is not None and number == len(leaf.lengths):
                touched.append(leaf)
                leaf, number = leaf.next_leaf(), 0
            if leaf is None or (old >= end and old + shift == new):
                break
            if old < end or old + shift < new:
                old += leaf.lengths[number]
                number += 1
                continue
            m = match(text, new)
            lengths.append(m.end() - new)
            counts.append(count[m[0]])
            new = m.end()
        if leaf is None:
            while new < len(text):
                m = match(text, new)
                lengths.append(m.end() - new)
                counts.append(count[m[0]])
                new = m.end()
        rest = (leaf.lengths[number:], leaf.counts[number:]) if leaf is not None else ([], [])
        self.reencoded += sum(lengths)
        for x in [*touched, leaf]:
            if x is not None and x is not first:
                x.fill(*(rest if x is leaf else ([], [])))
                x.refresh()
        if leaf is first:
            first.fill(kept[0] + lengths + rest[0], kept[1] + counts + rest[1])
        else:
            first.fill(kept[0] + lengths, kept[1] + counts)
        first.refresh()


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def _kinds(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)


def build_trees(docs: DataFrame, keep: list[str], path: str, pattern: str) -> DataFrame:
    """Columns keep of docs with _ts_text, _ts_tree and _ts_tokens. The vocabulary's path must be readable on the executors."""
    n, own = len(keep), [OWN + x for x in ("text", "tree", "tokens")]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = [Tree(t, _tokenizer(path, pattern)) for t in texts_of(batch.column(n))]
        new = [pa.array([t.text for t in trees]), pa.array([t.to_bytes() for t in trees], type=pa.binary()), pa.array([t.tokens for t in trees], type=pa.int64())]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *new], names=[*keep, *own])

    return map_batches(docs.select(*keep, "text"), one, f"{_kinds(docs, keep)}, {own[0]} string, {own[1]} binary, {own[2]} long")


def apply_edits(trees: DataFrame, edits: Column, keep: list[str], path: str, pattern: str) -> DataFrame:
    """Columns keep of trees (see build_trees) with the new _ts_text and _ts_tree, n_before, n_after (tokens), n_edits, n_chars_after, n_reencoded (characters).

    edits is an array of structs (at, deleted, inserted).
    """
    n, own = len(keep), [OWN + x for x in ("text", "tree", "edits")]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(path, pattern)
        out = []
        for text, kept, changes in zip(texts_of(batch.column(n)), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()):
            tree = Tree(text, tokenizer, kept)
            before, changes = tree.tokens, [x for x in changes or [] if x is not None]
            for x in changes:
                tree.edit(x["at"] or 0, x["deleted"] or 0, x["inserted"] or "")
            out.append((tree.text, tree.to_bytes(), before, tree.tokens, len(changes), len(tree.text), tree.reencoded))
        columns = [pa.array(list(x), type=t) for x, t in zip(zip(*out), [pa.string(), pa.binary(), *[pa.int64()] * len(NAMES)])]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns], names=[*keep, *own[:2], *NAMES])

    source = trees.select(*keep, *own[:2], edits.alias(own[2]))
    return map_batches(source, one, f"{_kinds(trees, keep)}, {own[0]} string, {own[1]} binary, " + ", ".join(f"{x} long" for x in NAMES))


def count_edits(docs: DataFrame, edits: Callable[[Column], Column], keep: list[str], path: str, pattern: str) -> DataFrame:
    """Columns keep of docs with NAMES: trees are built, then edited; edits makes the edits of a text."""
    trees = build_trees(docs, keep, path, pattern)
    return apply_edits(trees, edits(F.col(OWN + "text")), keep, path, pattern).select(*keep, *NAMES)


NAMES = ("n_before", "n_after", "n_edits", "n_chars_after", "n_reencoded")


def sample_edits(text: Column) -> Column:
    """Four edits per document, set by its length: a deletion at the start, a replacement, an inserted line break, an added ending."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda at, deleted, inserted: F.struct(at.cast("long").alias("at"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(edit(F.lit(0), 1, ""), edit(F.floor(n / 3), 12, " a revised passage 2024"), edit(F.floor(n * 2 / 3), 0, "\n\n"), edit(n + 12, 0, " The end."))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_edits(docs, sample_edits, ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
