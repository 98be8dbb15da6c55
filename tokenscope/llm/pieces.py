"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model asks (a leading space mark, spaces as marks), cut where no merge can ever
cross, and each part is encoded by an agenda: a heap of adjacent symbol pairs, best score first and leftmost
among equals; the pair on top is joined, its neighbours enter the heap, and pairs whose symbols are gone are
skipped. What is left of unknown symbols becomes byte pieces.

A cut between two characters is safe if no piece of the vocabulary holds both side by side, since a merge
makes a piece. Cutting makes words and parts repeat, so their ids are kept in a bounded memory per Python worker;
that memory changes no result. The words of some texts that it lacks are encoded together (Agendas): each of their
parts has an agenda of its own, and in every round each agenda gives the pair on top. Each Arrow batch is encoded by
the sentencepiece library as well and compared.

Defined cases: null and empty texts have no pieces besides the begin and end ids and decode to an empty
string; every row gives one result row, whatever its doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.common import OWN, map_batches, portions, table, texts_of

MARK = "▁"
#: Piece types of the public model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
MAX_WORDS = 500_000
#: Characters of words in one block of agendas.
BLOCK = 1 << 17
#: Most characters that have a table of their pairs.
MAX_TABLE = 1024
#: Parts of up to so many symbols are worked on without a heap.
SHORT = 48
NEVER = float("inf")
#: Stands for the rank of a pair that is no piece.
_NONE = 1 << 62


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class Vocabulary:
    """A merge-type model read from its file's bytes."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        kind, normalizer = 1, {}
        self.bos, self.eos, self.unk, self.fallback = 1, 2, 0, False
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                kind = trainer.get(3, 1)
                self.fallback = bool(trainer.get(35, 0))
                self.unk, self.bos, self.eos = trainer.get(40, 0), trainer.get(41, 1), trainer.get(42, 2)
            elif number == 3:
                normalizer = dict(_fields(value))
        if kind != BPE:
            raise ValueError("only merge-type vocabularies are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only the identity normalizer, with marks for spaces, is supported")
        if USER in self.types or UNUSED in self.types:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(p[1] == MARK != p[0] for p in self.joined):
            raise ValueError("a piece has a space mark after another character")

    def normalize(self, text: str) -> str:
        """A space mark goes before the text and stands for each space."""
        return text and (MARK if self.prefix else "") + text.replace(" ", MARK)

    def agenda(self, part: str) -> list[str]:
        """The pieces of one part: pairs are joined by score, then from the left, until none is a piece."""
        symbols: list[str] = list(part)
        n = len(symbols)
        if n == 1:
            return symbols
        if n <= SHORT:
            return self._short_agenda(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            if (r := rank.get(symbols[i] + symbols[i + 1])) is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + symbols[i])) is not None:
                heapq.heappush(heap, (r, h, size + len(symbols[h])))
        return [s for s in symbols if s]

    def _short_agenda(self, symbols: list[str]) -> list[str]:
        """The same with the agenda as a list of the pairs' ranks, by place: for few symbols its least is found faster than a heap is kept."""
        get = self.rank.get
        ranks = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            joined = symbols[i] + symbols.pop(i + 1)
            symbols[i] = joined
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(joined + symbols[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + joined, NEVER)
        return symbols

    def to_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def cut(self, text: str) -> list[str]:
        """Parts of text between which nothing can be joined."""
        joined = self.joined
        breaks = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in joined]
        return [text[i:j] for i, j in zip([0, *breaks], [*breaks, len(text)])] if breaks else [text]


class Agendas:
    """The agendas of many words at once, over numbers for the vocabulary's characters and pieces."""

    def __init__(self, v: Vocabulary) -> None:
        joined = sorted(set("".join(v.joined)))
        # characters that can be joined come first; those of one byte that are no piece become that byte
        names = list(dict.fromkeys([*joined, *v.ids, *(map(chr, range(128)) if v.fallback else ())]))
        number = {s: i for i, s in enumerate(names)}
        order = {r: i for i, r in enumerate(sorted(set(v.rank.values())))}
        made = [(number[p[:i]] << 32 | number[p[i:]], order[v.rank[p]] << 32, number[p]) for p in v.ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        keys, ranks, wholes = (np.array(x, dtype=np.int64) for x in zip(*sorted(made), (1 << 62, _NONE, -1)))
        #: Pairs of symbols that are a piece: their keys in order, and by the same places rank and piece; the last place stands for no piece.
        self.keys, self.ranks, self.wholes, self.none = keys, ranks, wholes.astype(np.int32), len(keys) - 1
        self.joined = np.array(sorted(number[a] << 32 | number[b] for a, b in v.joined), dtype=np.int64)
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for i, s in enumerate(names):
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.ids = np.array([v.ids.get(s, v.bytes.get(ord(s), -1) if v.fallback and len(s) == 1 and s.isascii() else -1) for s in names], dtype=np.int64)
        #: Where they are few, a table of the characters that can be joined: -1 for what no piece holds side by side, else the pair's place.
        self.table, k = None, len(joined)
        if k <= MAX_TABLE:
            self.table = np.full((k + 1, k + 1), -1, dtype=np.int32)
            a, b = self.joined >> 32, self.joined & 0xFFFFFFFF
            self.table[a, b] = self._find(a, b)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in keys of the pairs of symbols."""
        pairs = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[at] == pairs, at, self.none)

    def _neighbours(self, symbols: np.ndarray) -> np.ndarray:
        """For the pairs of characters side by side their places in keys, -1 if no piece holds them."""
        if self.table is not None:
            known = np.minimum(symbols.view(np.uint32), len(self.table) - 1)
            return self.table[known[:-1], known[1:]]
        pairs = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        return np.where(self.joined[at] == pairs, self._find(symbols[:-1], symbols[1:]), -1)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, done) of words that each begin with a mark: all ids, their number by word, and whether the word is done.

        Not done, and without ids, are words with a part of over SHORT symbols, or with characters that only several bytes stand for.
        """
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts = np.flatnonzero(points == ord(MARK))
        blocks, last = [], 0
        while last < len(starts):
            first, begin = last, starts[last]
            last = max(first + 1, int(np.searchsorted(starts, begin + BLOCK)))
            symbols = self.of_char[points[begin : starts[last] if last < len(starts) else len(points)]]
            blocks.append(self._block(symbols, starts[first:last] - begin))
        return tuple(np.concatenate(x) for x in zip(*blocks))

    def _block(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = self._merge(symbols, starts)
        left = np.flatnonzero(out > -2)
        ids = np.where(out[left] >= 0, self.ids[out[left]], -1)
        bounds = np.searchsorted(left, np.append(starts, len(symbols)))
        sizes = np.diff(bounds)
        done = np.diff(np.append(0, np.cumsum(ids < 0))[bounds]) == 0
        return ids[np.repeat(done, sizes)].astype("<u4"), np.where(done, sizes, 0), done

    def _merge(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """By place the symbol that begins there when no pair is left to join, -2 inside of one; -1 for unknown ones and all of a part of over SHORT."""
        n = len(symbols)
        out, place = np.full(n, -2, dtype=np.int32), np.arange(n)
        found = np.append(self._neighbours(symbols), -1)
        found[starts[1:] - 1] = -1
        ends = np.flatnonzero(found < 0) + 1
        counts = np.diff(ends, prepend=0)
        found[ends - 1] = self.none
        # of the pair that begins at each symbol: rank and place, in one number, and the piece
        top, whole = self.ranks[found] + place, self.wholes[found]
        live = counts <= SHORT
        some = np.repeat(live, counts)
        out[~some] = -1
        symbols, place, top, whole, counts = symbols[some], place[some], top[some], whole[some], counts[live]
        while len(counts):
            best = np.minimum.reduceat(top, np.cumsum(counts) - counts)
            live = best < _NONE
            some = np.repeat(live, counts)
            out[place[~some]] = symbols[~some]
            symbols, place, top, whole, counts, best = symbols[some], place[some], top[some], whole[some], counts[live], best[live]
            ends = np.cumsum(counts)
            i = np.flatnonzero(top == np.repeat(best, counts))
            symbols[i] = whole[i]
            inner, last = i[i > ends - counts], i + 2 >= ends
            found = np.full(len(i), self.none)
            found[~last] = self._find(symbols[i[~last]], symbols[i[~last] + 2])
            top[i], whole[i] = self.ranks[found] + place[i], self.wholes[found]
            found = self._find(symbols[inner - 1], symbols[inner])
            top[inner - 1], whole[inner - 1] = self.ranks[found] + place[inner - 1], self.wholes[found]
            some = np.ones(len(symbols), dtype=bool)
            some[i + 1] = False
            symbols, place, top, whole, counts = symbols[some], place[some], top[some], whole[some], counts - 1
        return out


class _Memory(dict):
    """Ids, as bytes, of parts. At half the limit what is there becomes the older half, which the next such step drops; what is used again moves up."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    def __init__(self, vocabulary: Vocabulary, limit: int = MAX_WORDS) -> None:
        self.v = v = vocabulary
        pack = lambda ids: np.array(ids, dtype="<u4").tobytes()
        self.agendas = Agendas(v)
        self.parts = _Memory(lambda part: pack(v.to_ids(v.agenda(part))), limit)
        self.runs = _Memory(lambda run: b"".join(map(self.parts.__getitem__, v.cut(run))), limit)
        self.words = _Memory(lambda word: b"".join(map(self.parts.__getitem__, v.cut(MARK + word))), limit)
        self.begin, self.end = pack([v.bos]), pack([v.eos])
        byte = lambda p: chr(b) if (b := int(p[3:5], 16)) < 128 else chr(0xDC00 + b)
        #: Text of each piece; bytes beyond ASCII stand for themselves as lone surrogates, which no text holds.
        self.plain = [p if k == NORMAL else byte(p) if k == BYTE else None if k == UNKNOWN else "" for p, k in zip(v.pieces, v.types)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, see encode."""
        # where each space parts two words, a word is what stands between spaces, with a mark before it
        plain = [bool(t) and self.v.prefix and t[0] != " " and "  " not in t and MARK not in t for t in texts]
        bodies = iter(self._of_words([t for t, ok in zip(texts, plain) if ok]))
        runs = lambda t: re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", self.v.normalize(t))
        return [self.begin + (next(bodies) if ok else b"".join(map(self.runs.__getitem__, runs(t)))) + self.end for t, ok in zip(texts, plain)]

    def _of_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of words with one space between any two. The different words are encoded together, those that this leaves out each by itself."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, type=pa.string()), " ")
        words = split.flatten().dictionary_encode()
        names = words.dictionary
        every = pa.ListArray.from_arrays(pa.array([0, len(names)], type=pa.int32()), names)
        ids, sizes, done = self.agendas.encode(MARK + pc.binary_join(every, MARK)[0].as_py())
        stops = np.append(0, np.cumsum(4 * sizes))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(stops), pa.py_buffer(ids)])
        where = words.indices
        if not done.all():
            own = np.flatnonzero(~done)
            place = np.arange(len(names))
            place[own] = len(names) + np.arange(len(own))
            found = pa.concat_arrays([found, pa.array([self.words[names[int(i)].as_py()] for i in own], type=pa.large_binary())])
            where = pa.array(place).take(where)
        data = found.take(where)
        ends, ids = np.frombuffer(data.buffers()[1], dtype=np.int64), data.buffers()[2].to_pybytes()
        ends = ends[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))].tolist()
        return [ids[i:j] for i, j in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks are spaces, the first one from the leading mark is dropped; bytes that are no UTF-8 become U+FFFD each."""
        v, first = self.v, self.v.prefix
        try:
            text = "".join(map(self.plain.__getitem__, ids))
            text = (text[1:] if first and text[:1] == MARK else text).replace(MARK, " ")
            return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode()
        except (TypeError, UnicodeDecodeError):  # unknown ones, or bytes that are no text
            out, raw = [], bytearray()

        def flush() -> None:
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()

        for i in ids:
            kind = v.types[i]
            if kind == BYTE:
                raw.append(int(v.pieces[i][3:5], 16))
                first = False
            elif kind == NORMAL:
                flush()
                piece = v.pieces[i]
                out.append(piece[1:] if first and piece[0] == MARK else piece)
                first = False
            elif kind == UNKNOWN:
                flush()
                out.append(" ⁇ ")
                first = False
        flush()
        return "".join(x.replace(MARK, " ") for x in out)


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _tools(model: bytes):
    """The encoder and the library's processor; once per Python worker."""
    import sentencepiece

    return Encoder(Vocabulary(model)), sentencepiece.SentencePieceProcessor(model_proto=model)


def encode_texts(df: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """Columns keep of df with ids (binary, see Encoder.encode), decoded (the library's decoding of them) and agrees: the library finds the same ids and decoding gives the same text here (Encoder.decode).

    The model's file is read once, on the driver, and travels with the tasks (0.5 MB).
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, library = _tools(model)
        n = len(keep)
        found, decoded, agrees = [], [], []
        texts = texts_of(batch.column(n))
        for some in portions(texts):
            found += encoder.encode_all(some)
        for at in range(0, len(texts), 200):
            some, ours = texts[at : at + 200], found[at : at + 200]
            theirs = library.encode(some, add_bos=True, add_eos=True, num_threads=1)
            same = [np.array(b, dtype="<u4").tobytes() == a for a, b in zip(ours, theirs)]
            ids = [b if ok else np.frombuffer(a, dtype="<u4").tolist() for a, b, ok in zip(ours, theirs, same)]
            back = library.decode(ids, num_threads=1)
            decoded += back
            agrees += [ok and encoder.decode(i) == t for i, t, ok in zip(ids, back, same)]
        names = [*keep, OWN + "ids", OWN + "decoded", OWN + "agrees"]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(found, type=pa.binary()), pa.array(decoded, type=pa.string()), pa.array(agrees, type=pa.bool_())], names=names)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(df.select(*keep, "text"), one, f"{kinds}, {OWN}ids binary, {OWN}decoded string, {OWN}agrees boolean")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees for every row. The digests are taken by Spark, of the operator's ids and text."""
    out = encode_texts(docs, model_path, ["doc_id"])
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(OWN + "ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(OWN + "ids"), 256).alias("ids_sha256"),
        F.sha2(F.col(OWN + "decoded"), 256).alias("decoded_sha256"),
        F.col(OWN + "agrees").alias("agrees"),
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
