"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased, and runs of white space become one space. Characters are code points,
whatever the script. An item of n characters is found in a text if some stretch is within edit distance
e = floor(BUDGET * n) of it. By the q-gram lemma such a stretch shares at least n + 1 - q * (1 + e) of the item's
character q-grams, and those lie on diagonals (text position minus item position) no more than e apart. So per text:

1. q-grams that occur in any item are marked; a text goes on only if some stretch of n + e positions holds as
   many marks as the most lenient item length class asks for. This looks at whole texts with vector operations.
2. In the stretches left, marks are looked up in the items' positions, and hits are counted per item in
   overlapping bands of diagonals, 2e + 1 wide, one beginning every e + 1; bands that reach the bound are kept.
3. Each kept band is verified by banded alignment of the item to the text.

q is the greatest of GRAMS that leaves the bound positive for an item: 8, and 4 for items of 15 characters.

Items of under EXACT characters have no budget. They are searched as they are, all at once by an automaton, and, as a few
characters are found in many words, count where they are whole: where a word of the item does not go on in the text. Scripts
written without spaces (HAN_LIKE) have no such borders and count anywhere. Items with a budget count wherever they are found.

The benchmark is a small fixed table: it is sent to every task, and a size above MAX_ITEM_BYTES is refused
rather than cut (split the benchmark by item_id and take the union then).

Defined cases: null and empty texts are clean; null and empty items are left out; equal items are all reported; a text
of any length is searched whole; every row gives one result row, whatever its doc_id; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.alignment import best_in
from tokenscope.llm.common import OWN, map_batches, mix, table, texts_of

GRAMS = (8, 4)
BUDGET = 0.07
#: The fewest characters for which BUDGET allows an edit.
EXACT = 15
MAX_ITEM_BYTES = 64 << 20
BITS = 22
_CHARS = 1 << 20
#: First and last code points of scripts written without spaces.
HAN_LIKE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(data: np.ndarray, q: int = GRAMS[0]) -> np.ndarray:
    """A hash of every run of q code points, a power of two, by doubling."""
    out = mix(data.astype(np.uint64), 3)
    for size in (1, 2, 4)[: q.bit_length() - 1]:
        if len(out) <= size:
            return np.empty(0, dtype=np.uint64)
        out = out[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + out[size:]
    return out


def slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def bound_of(n: int, q: int) -> int:
    """q-grams that an item of n characters and a stretch within its budget share at least."""
    return n + 1 - q * (1 + int(BUDGET * n))


class Index:
    """Items by their q-grams, of one q for all."""

    def __init__(self, items: tuple[tuple[int, str], ...], q: int = GRAMS[0]) -> None:
        self.q = q
        self.ids = [i for i, _ in items]
        self.data = [codes(x) for _, x in items]
        self.budget = [int(BUDGET * len(x)) for x in self.data]
        self.bound = [bound_of(len(x), q) for x in self.data]
        found = [grams(x, q) for x in self.data]
        keys = np.concatenate(found) if found else np.empty(0, np.uint64)
        owner = np.concatenate([np.full(len(x), i) for i, x in enumerate(found)]) if found else np.empty(0, np.int64)
        at = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.at = keys[order], owner[order], at[order]
        self.table = np.zeros(1 << BITS, dtype=bool)
        self.table[slots(self.keys)] = True
        # (length of a stretch, fewest marks in it), by classes of item length: each class asks for the most lenient bound over its longest stretch
        classes: dict[int, tuple[int, int]] = {}
        for x, e, bound in zip(self.data, self.budget, self.bound):
            span, least = classes.get(c := len(x) * 4 // max(32, 1 << (len(x).bit_length() - 1)) + 8 * len(x).bit_length(), (0, 1 << 60))
            classes[c] = max(span, len(x) + e - q + 1), min(least, bound)
        self.classes = sorted(classes.values())

    def stretches(self, marks: np.ndarray) -> list[tuple[int, int]]:
        """Parts of a text (from, to) outside of which no item can begin and end."""
        sums = np.concatenate([[0], np.cumsum(marks)])
        n, hot = len(marks), None
        for span, least in self.classes:
            span = min(span, n)
            dense = np.flatnonzero(sums[span:] - sums[: n - span + 1] >= least)
            if len(dense):
                if hot is None:
                    hot = np.zeros(n + 1, dtype=np.int64)
                np.add.at(hot, dense, 1)
                np.add.at(hot, dense + span, -1)
        if hot is None:
            return []
        inside = np.concatenate([[0], (np.cumsum(hot[:-1]) > 0).astype(np.int8), [0]])
        edge = np.diff(inside)
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))

    def regions(self, keys: np.ndarray, start: int) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that reach their item's bound; keys are the q-grams from start on."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        count = high - low
        if not count.sum():
            return []
        text_at = np.repeat(np.arange(len(keys)), count)
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        owner, diagonal = self.owner[entry], text_at - self.at[entry]
        out = []
        enough = np.flatnonzero(np.bincount(owner, minlength=len(self.ids)) >= np.array(self.bound))
        for i in enough.tolist():
            mine = owner == i
            step = self.budget[i] + 1
            place, diag = text_at[mine], diagonal[mine]
            offset = len(self.data[i])
            for shift in (0, step):
                band = (diag + offset + shift) // (2 * step)
                # every text position counts once in a band
                pairs = np.unique(band * (len(keys) + 1) + place)
                bands, hits = np.unique(pairs // (len(keys) + 1), return_counts=True)
                for b in bands[hits >= self.bound[i]].tolist():
                    first = b * 2 * step - offset - shift
                    out.append((i, first + start, first + 2 * step - 1 + start))
        return out

    def search(self, data: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> list[int]:
        """Numbers of the items that data holds."""
        found = set()
        for a, b in self.stretches(marks):
            for item, first, last in self.regions(keys[a:b], a):
                if item not in found:
                    e = self.budget[item]
                    half = (last - first) // 2 + 1 + e
                    if best_in(self.data[item], data, (first + last) // 2, half) <= e:
                        found.add(item)
        return sorted(found)

    def search_all(self, texts: list[str]) -> list[list[int]]:
        """search() for every text; q-grams of many texts are marked at once."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _CHARS):
                size += len(texts[end]) + 1
                end += 1
            data = codes("\n".join(texts[at:end]))
            keys = grams(data, self.q)
            marks = self.table[slots(keys)]
            start = 0
            for t in texts[at:end]:
                n = len(t) - self.q + 1
                some = marks[start : start + n] if n > 0 else marks[:0]
                out.append(self.search(data[start : start + len(t)], keys[start : start + n], some) if n > 0 and some.any() else [])
                start += len(t) + 1
            at = end
        return out


def _spaced(char: str) -> bool:
    """Whether a character belongs to a word of a script that parts its words."""
    return (char.isalnum() or char == "_") and not any(first <= ord(char) <= last for first, last in HAN_LIKE)


class Short:
    """Items under EXACT characters in an automaton."""

    def __init__(self, items: tuple[tuple[int, str], ...]) -> None:
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for i, text in items:
            ids.setdefault(text, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for text, found in ids.items():
            self.automaton.add_word(text, (text, found))
        if ids:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[int]:
        """Ids of the items that a normalised text holds."""
        if not len(self.automaton):
            return []
        out: set[int] = set()
        for end, (item, ids) in self.automaton.iter(text):
            start = end - len(item) + 1
            begins = start == 0 or not (_spaced(item[0]) and _spaced(text[start - 1]))
            if begins and (end + 1 == len(text) or not (_spaced(item[-1]) and _spaced(text[end + 1]))):
                out.update(ids)
        return sorted(out)


@lru_cache(maxsize=2)
def _short(items: tuple[tuple[int, str], ...]) -> Short:
    return Short(items)


@lru_cache(maxsize=2)
def _indexes(items: tuple[tuple[int, str], ...]) -> tuple[Index, ...]:
    """An index for each q that items need."""
    by: dict[int, list[tuple[int, str]]] = {}
    for i, x in items:
        by.setdefault(next(q for q in GRAMS if bound_of(len(x), q) > 0), []).append((i, x))
    return tuple(Index(tuple(x), q) for q, x in by.items())


def search(items: tuple[tuple[int, str], ...], texts: list[str]) -> list[list[int]]:
    """Ids of the items of EXACT characters or more that each normalised text holds."""
    out: list[set[int]] = [set() for _ in texts]
    for index in _indexes(items):
        for ids, found in zip(out, index.search_all(texts)):
            ids.update(index.ids[i] for i in found)
    return [sorted(x) for x in out]


def _load(benchmark: DataFrame) -> list[tuple[int, str]]:
    """Normalised items. The benchmark's size is checked before it is gathered."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; at most {MAX_ITEM_BYTES} can be sent to every task")
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").collect()
    return sorted((i, x) for i, x in ((r[0], normal(r[1])) for r in rows) if x)


def _split(items: list[tuple[int, str]]) -> tuple[tuple[tuple[int, str], ...], tuple[tuple[int, str], ...]]:
    """Items of EXACT characters or more, and shorter ones."""
    long = [len(x) >= EXACT for _, x in items]
    return tuple(x for x, y in zip(items, long) if y), tuple(x for x, y in zip(items, long) if not y)


def load_items(benchmark: DataFrame) -> tuple[tuple[int, str], ...]:
    """Normalised items of EXACT characters or more."""
    return _split(_load(benchmark))[0]


def found_items(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep of docs with the ids of the items that each text holds."""
    items, short = _split(_load(benchmark))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normal(t) for t in texts_of(batch.column(len(keep)))]
        ids = [sorted({*x, *_short(short).search(t)}) for x, t in zip(search(items, texts), texts)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(ids, type=pa.list_(pa.int64()))], names=[*keep, OWN + "items"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(docs.select(*keep, "text"), one, f"{kinds}, {OWN}items array<long>")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; they are filtered where they are read."""
    (items, short), at = _split(_load(benchmark)), docs.columns.index("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normal(t) for t in texts_of(batch.column(at))]
        return batch.filter(pa.array([not x and not _short(short).search(t) for x, t in zip(search(items, texts), texts)], type=pa.bool_()))

    return map_batches(docs, one, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.col(OWN + "items")
    return out.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"))
