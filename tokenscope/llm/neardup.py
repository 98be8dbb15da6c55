"""Near-duplicate classes by order MinHash.

Words are lower-cased and stripped of punctuation at their ends. Two texts are linked if the word edit distance,
found by banded alignment, is at most 0.2 of the longer one (similarity 0.8 or more); classes are the connected
components of links, and a class is named by its least doc_id. Texts with equal words are one node before
anything is compared, so exact copies cost one row each.

Samples: a text's k-mers are its five-word shingles, labelled with their occurrence number, so that a multiset is
sampled. Each of SEEDS hash functions takes the two least labelled k-mers and keeps them in text order: equal
samples then speak for a small edit distance, not just for common shingles. Changes at every fifth, sixth or seventh
word leave few or no five words in a row; so some samples (STEPS) are of stretched shingles, five words that each stand
as many words after the last, most of which such changes leave whole. From every eighth word on the plain ones do.
A text of under SHORT words has too few five-word shingles; it is sampled by SHORT_SEEDS pairs of its two-word shingles as well. Texts with an equal
sample share a bucket, and a bucket of up to SMALL texts gives all its pairs.

Large buckets come from what many texts share: a passage, a template, a near copy of very many. Their texts are
aligned with the least text of the bucket, its hub, which links the near copies. Where this leaves some text of a
hub unlinked, its texts are sampled anew by the words that none of their hubs has: INNER_SEEDS pairs of single words
in text order, so that a passage no longer counts. Common words are drawn more rarely: a word enters its place in the
order by an exponential variate over its weight, which is USUAL over its number of occurrences in these texts, 1 at
most (numbers by slots of a fixed table; words that share a slot only change how often they are drawn). This is
repeated for inner buckets that are large in turn, and each time the sampled words leave the texts, so it comes to
an end. Two texts that are both linked to one hub are in one class and need not be compared.

So no bucket, partner or candidate is dropped, and the number of aligned pairs grows in proportion to the texts.
Recall is a matter of sampling: a pair of similarity 0.8 with scattered changes is found with a chance of 0.95 (0.92 if
they are all insertions or deletions), one of 0.85 nearly always, one with every fifth, sixth or seventh word changed with one of 0.96 (see README for measured figures, and tests/llm for the measurement).

Defined cases: null and blank texts are alike to nothing and form classes of their own, as do unlike texts of under
five words; rows with a null doc_id get the class of an equal text, if any, else null; several texts of one doc_id
are one node; repeated rows give repeated result rows; doc_id is an integer (a text that is none raises an error
under ANSI mode); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.alignment import within
from tokenscope.llm.common import OWN, map_batches, mix, portions, release, table, texts_of, window_hashes
from tokenscope.llm.graph import components

SHINGLE, SEEDS = 5, 64
#: Samples of stretched shingles by the distance of their words.
STEPS = {5: 6, 6: 5, 7: 5}
SHORT, SHORT_SHINGLE, SHORT_SEEDS = 64, 2, 24
INNER_SEEDS = 40
SMALL = 16
USUAL, SLOTS = 64, 1 << 18
SIMILARITY = 0.8
#: Most values of a block of samples that are computed at once, and words of texts that are sampled together.
_BLOCK, _WORDS = 1 << 18, 1 << 15

_edges = re.compile(r"^[\W_]+|[\W_]+$")


def _normal(words: list[str]) -> list[bytes]:
    return [(w if w.isalnum() else _edges.sub("", w) or w).encode() for w in words]


def normal_words(text: str) -> list[bytes]:
    """Lower-cased words without punctuation at their ends; a word of punctuation only stays as it is."""
    return _normal(text.lower().split())


def word_rows(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text its normal words joined by spaces, and their 64-bit hashes. What differs among the words of some texts is made normal and hashed once."""
    import xxhash

    for some in portions(texts):
        lines = [" ".join(t.lower().split()) for t in some]
        split = pc.split_pattern(pa.array(lines, type=pa.string()), " ")
        words = split.flatten().dictionary_encode()
        names = words.dictionary
        every = pa.ListArray.from_arrays(pa.array([0, len(names)], type=pa.int32()), names)
        forms = _normal(pc.binary_join(every, " ")[0].as_py().split(" "))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, forms), np.uint64, len(forms))[words.indices.to_numpy()]
        data = pa.array([x + b" " for x in forms], type=pa.large_binary()).take(words.indices)
        counts = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[counts].tolist()
        joined, counts = data.buffers()[2].to_pybytes(), counts.tolist()
        for i, line in enumerate(lines):
            # a text without words is one empty word to the split
            yield (joined[ends[i] : ends[i + 1] - 1], hashes[counts[i] : counts[i + 1]]) if line else (b"", hashes[:0])


def occurrence(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    out, order = np.zeros(len(keys), dtype=np.int64), np.argsort(keys)
    ordered = keys[order]
    same = np.append(False, ordered[1:] == ordered[:-1])[: len(keys)]
    if same.any():
        # only the keys that are there again need the order of the text
        again = same | np.append(same[1:], False)
        both = np.sort(np.cumsum(~same)[again] << 32 | order[again])
        group, numbers = both >> 32, np.arange(len(both))
        out[both & 0xFFFFFFFF] = numbers - np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), numbers, 0))
    return out


def labelled(keys: np.ndarray, seed: int, owners: np.ndarray | None = None) -> np.ndarray:
    """Keys mixed with their occurrence numbers, among the keys of each owner."""
    times = occurrence(keys if owners is None else keys ^ mix(owners, 9))
    return mix(keys + (mix(np.arange(times.max(initial=0) + 1, dtype=np.uint64), 7) * np.uint64(2))[times], seed)


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factors, offsets, marks) of count hash functions."""
    numbers = np.arange(1, count + 1, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    return (mix(numbers, seed) & low).astype(np.uint32) | np.uint32(1), (mix(numbers, seed + 1) & low).astype(np.uint32), mix(numbers, seed + 2)


LONG, BRIEF, INNER = _functions(SEEDS, 20), _functions(SHORT_SEEDS, 30), _functions(INNER_SEEDS, 40)
STRETCHED = {step: _functions(count, 50 + 3 * step) for step, count in STEPS.items()}


def stretched(words: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Hash of every SHINGLE words that each stand step words after the last."""
    n = len(words) - (SHINGLE - 1) * step
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = mix(out + words[k * step : k * step + n], seed + k)
    return out


def _least(keys: np.ndarray, functions: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each hash function the places of the two least of several keys, in order."""
    factors, offsets, _ = functions
    short = (keys >> np.uint64(32)).astype(np.uint32)
    firsts, seconds = np.empty(len(factors), np.int64), np.empty(len(factors), np.int64)
    step = max(1, _BLOCK // len(keys))
    for at in range(0, len(factors), step):
        values = short[None, :] * factors[at : at + step, None] + offsets[at : at + step, None]
        if weights is not None:
            values = -np.log((values + np.float64(0.5)) / 2**32) / weights
        rows, i = np.arange(len(values)), values.argmin(axis=1)
        values[rows, i] = 0xFFFFFFFF if weights is None else np.inf
        j = values.argmin(axis=1)
        firsts[at : at + step], seconds[at : at + step] = np.minimum(i, j), np.maximum(i, j)
    return firsts, seconds


def _joined(marks: np.ndarray, firsts: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    return mix(mix(marks + firsts) * np.uint64(0x9E3779B97F4A7C15) + seconds)


def ordered_samples(keys: np.ndarray, functions: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray | None = None) -> np.ndarray:
    """For each hash function a hash of the two least keys (labelled, 64 bits) in text order; of the only key if there is one.

    With weights a key's value is an exponential variate of that rate, so that it is least in proportion to its weight.
    """
    if len(keys) == 1:
        return mix(functions[2] + keys[0])
    i, j = _least(keys, functions, weights)
    return _joined(functions[2], keys[i], keys[j])


#: Kinds of samples: hash of the shingles of a row of words, words from a shingle's first to its last, seed of labels, functions, and whether for texts under SHORT only.
KINDS = [
    (lambda words: window_hashes(words, SHINGLE, 5), SHINGLE, 8, LONG, False),
    (lambda words: window_hashes(words, SHORT_SHINGLE, 6), SHORT_SHINGLE, 10, BRIEF, True),
    *((lambda words, step=step: stretched(words, step, 60 + 5 * step), (SHINGLE - 1) * step + 1, 14 + step, functions, False) for step, functions in STRETCHED.items()),
]


def samples(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of each text's ordered samples; words are 64-bit hashes. A text of under five words is like equal ones only and gives none.

    The words of some texts stand in one row, so that shingles are hashed and labelled for all of them in one step; a shingle that reaches
    into the next text comes after all of its own text, and is not read.
    """
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for shingles, width, seed, functions, short in KINDS:
        at, chosen = 0, [i for i, x in enumerate(texts) if len(x) >= max(5, width) and (not short or len(x) < SHORT)]
        while at < len(chosen):
            block, size = [], 0
            while at < len(chosen) and (not block or size + len(texts[chosen[at]]) <= _WORDS):
                block.append(chosen[at])
                size += len(texts[chosen[at]])
                at += 1
            hashes = shingles(np.concatenate([texts[i] for i in block]))
            sizes = [len(texts[i]) for i in block]
            keys = labelled(hashes, seed, np.repeat(np.arange(len(block), dtype=np.uint64), sizes)[: len(hashes)])
            firsts, seconds = np.empty((2, len(block), len(functions[0])), dtype=np.uint64)
            start = 0
            for k, n in enumerate(sizes):
                if n > width:
                    own = keys[start : start + n - width + 1]
                    i, j = _least(own, functions)
                    firsts[k], seconds[k] = own[i], own[j]
                start += n
            found = _joined(functions[2], firsts, seconds)
            start = 0
            for i, n, row in zip(block, sizes, found):
                out[i].append(row if n > width else ordered_samples(keys[start : start + 1], functions))
                start += n
    return [np.concatenate(x).view(np.int64) if x else np.empty(0, dtype=np.int64) for x in out]


def _scan(docs: DataFrame) -> DataFrame:
    """doc, whole (digest of the words, null if none), n, samples for each row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        wholes, hashes = [], []
        for words, row in word_rows(texts_of(batch.column(1))):
            wholes.append(hashlib.blake2b(words, digest_size=16).digest() if len(row) else None)
            hashes.append(row)
        counts, found = list(map(len, hashes)), samples(hashes)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), type=pa.int32()), pa.array(np.concatenate(found), type=pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(wholes, type=pa.binary()), pa.array(counts, type=pa.int64()), lists], names=["doc", "whole", "n", "samples"]
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc long, whole binary, n long, samples array<long>")


def _near(x: Column, y: Column) -> Column:
    """Whether lengths x and y let texts be alike."""
    return F.least(x, y) >= F.greatest(x, y) * SIMILARITY - 1e-9


def _buckets(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of the small buckets, rows of the large ones) of rows with key, node, n and root, the least hub that the node is linked to, if any.

    Sizes are written before the join, so that adaptive execution can split a hot key's rows.
    """
    full = rows.join(sizes.checkpoint(), "key").checkpoint()
    release(rows.sparkSession)
    lists = full.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "root"))).alias("all"))
    # each text with those after it in its bucket's list
    pairs = lists.select(F.posexplode("all").alias("at", "p"), "all").select("p", F.explode(F.slice("all", F.col("at") + 2, SMALL)).alias("q"))
    pairs = pairs.where(_near(F.col("p.n"), F.col("q.n")) & F.coalesce(F.col("p.root") != F.col("q.root"), F.lit(True)))
    pairs = pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).where("a < b").distinct()
    return pairs, full.where(F.col("size") > SMALL)


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of small buckets, and the nodes (node, n) of large ones with the least node, hub, of each."""
    rows = nodes.select("node", "n", F.explode("samples").alias("key"), F.lit(None).cast("long").alias("root"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1")
    pairs, large = _buckets(rows, sizes)
    pairs, stars = pairs.checkpoint(), large.where("node <> hub").select("node", "n", "hub").distinct().checkpoint()
    release(nodes.sparkSession)
    return pairs, stars


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and body (32-bit hashes of its words) of the wanted nodes."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(row >> np.uint64(32)).astype("<u4").tobytes() for _, row in word_rows(texts_of(batch.column(1)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["node", "body"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi")
    return map_batches(texts, one, "node long, body binary").distinct()


def _alike(a: pa.Array, b: pa.Array) -> list[bool]:
    """Whether the bodies of each pair have a similarity of SIMILARITY or more, by alignment."""
    read = lambda x: [np.frombuffer(v, dtype="<u4").view(np.int32) for v in x.to_pylist()]
    both = list(zip(read(a), read(b)))
    return within(both, [int(max(len(x), len(y)) * (1 - SIMILARITY) + 1e-9) for x, y in both])


def _links(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs whose alignment shows a similarity of SIMILARITY or more."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select(["a", "b"]).filter(pa.array(_alike(batch.column(2), batch.column(3)), type=pa.bool_()))

    a, b = bodies.toDF("a", "body_a"), bodies.toDF("b", "body_b")
    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "body_a", "body_b"), one, "a long, b long")


def _marks(body: bytes) -> np.ndarray:
    """Labelled hashes of a body's words."""
    return labelled(np.frombuffer(body, dtype="<u4").astype(np.uint64), 12)


def _with_hubs(stars: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each star (hub, node, n, root, rest) with linked, whether node and hub are alike, and the hub's words taken from rest.

    rest: labelled hashes of the words that no hub so far has, in text order (null: all words).
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, hubs = batch.column("body"), batch.column("hub_body")
        linked, rests = _alike(own, hubs), []
        for rest, body, hub in zip(batch.column("rest").to_pylist(), own.to_pylist(), hubs.to_pylist()):
            words = _marks(body) if rest is None else np.frombuffer(rest, dtype="<u8")
            rests.append(words[~np.isin(words, _marks(hub))].tobytes())
        arrays = [batch.column(c) for c in ("hub", "node", "n", "root")]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(linked, type=pa.bool_()), pa.array(rests, type=pa.binary())], names=["hub", "node", "n", "root", "linked", "rest"])

    joined = stars.join(bodies, "node").join(bodies.toDF("hub", "hub_body"), "hub").select("hub", "node", "n", "root", "rest", "body", "hub_body")
    return map_batches(joined, one, "hub long, node long, n long, root long, linked boolean, rest binary")


def _of_nodes(rows: DataFrame) -> DataFrame:
    """node, n, root and rest, where words are left, of rows of _with_hubs; only hubs with some text that is not linked count.

    A node has no more hubs than samples, so its list is bounded.
    """
    apart = rows.groupBy("hub").agg(F.bool_and("linked").alias("all")).where("not all").select("hub").checkpoint()
    some = rows.join(apart, "hub").groupBy("node", "n").agg(F.least(F.min("root"), F.min(F.when(F.col("linked"), F.col("hub")))).alias("root"), F.collect_list("rest").alias("rests"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rests = []
        for several in batch.column("rests").to_pylist():
            first, *others = (np.frombuffer(x, dtype="<u8") for x in sorted(several, key=len))
            for x in others:
                first = first[np.isin(first, x)]
            rests.append(first.tobytes())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "root")), pa.array(rests, type=pa.binary())], names=["node", "n", "root", "rest"])

    return map_batches(some, one, "node long, n long, root long, rest binary").where(F.octet_length("rest") > 0)


def _weights(rows: DataFrame) -> np.ndarray:
    """By slots of the words' hashes: how much rarer than usual ones common words are drawn. The table has a fixed size (2 MB)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.concatenate([np.frombuffer(x, dtype="<u8") for x in batch.column(0).to_pylist()]) % np.uint64(SLOTS)
        slots, times = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(times)], names=["slot", "times"])

    times = np.ones(SLOTS)
    for x in map_batches(rows.select("rest"), count, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).collect():
        times[x.slot] = x.times
    return np.minimum(1, USUAL / times)


def _shared_pairs(stars: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of nodes of large buckets to hubs, pairs of them to align), see above."""
    spark, weights = stars.sparkSession, None
    stars = stars.select("hub", "node", "n", F.lit(None).cast("long").alias("root"), F.lit(None).cast("binary").alias("rest"))

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for rest in batch.column("rest").to_pylist():
            words = np.frombuffer(rest, dtype="<u8")
            keys.append(np.unique(ordered_samples(words, INNER, weights[words % np.uint64(SLOTS)])).view(np.int64))
        index = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in keys]))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in ("node", "n", "root")), pa.array(np.concatenate(keys), type=pa.int64())], names=["node", "n", "root", "key"])

    links, pairs = [], []
    while True:
        rows = _with_hubs(stars, bodies).checkpoint()
        release(spark)
        links.append(rows.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        rows = _of_nodes(rows).checkpoint()
        if weights is None:
            weights = _weights(rows)
        each = map_batches(rows, keyed, "node long, n long, root long, key long")
        # a bucket whose texts are all linked to one hub has nothing to tell
        one_root = (F.count("root") == F.count(F.lit(1))) & (F.min("root") == F.max("root"))
        sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"), one_root.alias("one")).where("size > 1 and not coalesce(one, false)").drop("one")
        found, large = _buckets(each, sizes)
        pairs.append(found.checkpoint())
        stars = large.where("node <> hub").select("node", "hub").distinct().join(rows, "node").select("hub", "node", "n", "root", "rest").checkpoint()
        release(spark)
        if not stars.take(1):
            break
    every = lambda parts: reduce(DataFrame.union, parts).distinct()
    return every(links), every(pairs)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    spark = docs.sparkSession
    scan = _scan(docs).checkpoint()
    some = scan.where("whole is not null and doc is not null")
    least = some.groupBy("whole").agg(F.min("doc").alias("doc"))
    nodes = some.join(least, ["whole", "doc"], "left_semi").withColumnRenamed("doc", "node").checkpoint()
    scan = scan.select("doc", "whole").checkpoint()
    del some, least
    release(spark)
    pairs, stars = _candidates(nodes)
    nodes = nodes.select("whole", "node").distinct().checkpoint()
    release(spark)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(stars.select("node")).union(stars.select("hub")).distinct()
    bodies = _bodies(docs, wanted).checkpoint()
    release(spark)
    links = None
    if stars.take(1):
        links, more = _shared_pairs(stars, bodies)
        pairs = pairs.union(more).distinct()
    found = _links(pairs, bodies)
    links = found if links is None else links.union(found)
    of_text = nodes
    own_nodes = scan.where("whole is not null and doc is not null").select("doc", "whole").distinct().join(of_text, "whole")
    several = own_nodes.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc", "a")
    same_doc = own_nodes.join(several, "doc").where("node > a").select("a", F.col("node").alias("b"))
    links = links.union(same_doc).distinct().checkpoint()
    release(spark)
    labels = components(links)
    own = scan.select("doc", "whole").join(of_text, "whole", "left").select("doc", F.coalesce("node", "doc").alias("node"))
    return own.join(labels, "node", "left").select(F.col("doc").alias("doc_id"), F.coalesce("label", "node").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each class, with all columns; rows without doc_id stay only if no other row has their text.

    Blank texts are no copies of each other and stay, but a repeated row stays once.
    """
    found = classes(docs).checkpoint()
    lead = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias(OWN + "times")).withColumnRenamed("doc_id", OWN + "doc").checkpoint()
    same = docs["doc_id"].cast("long") == lead[OWN + "doc"]
    kept = docs.join(lead, same, "left_semi")
    if lead.where(F.col(OWN + "times") > 1).take(1):
        often = lead.where(F.col(OWN + "times") > 1)
        kept = docs.join(lead.where(F.col(OWN + "times") == 1), same, "left_semi").unionByName(
            docs.join(often, docs["doc_id"].cast("long") == often[OWN + "doc"], "left_semi").dropDuplicates(["doc_id"])
        )
    if found.where("class_id is null").take(1):
        kept = kept.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
    return kept


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
