"""Substring dedup with difference-cover anchors.

A window is 50 consecutive words. Words covered by a window whose word sequence also starts in a document
with a smaller doc_id are removed. Positions whose number modulo 31 lies in the perfect difference set
COVER are anchors. For any two positions i and j there is a shift k < 31 with both i + k and j + k in the
cover, so two equal 50-word windows hold equal 20-word runs (50 - 31 + 1) that both begin at anchors:

1. anchors: only the 20-word runs at cover positions (6 of 31) are hashed; runs seen in a smaller document
   mark places worth looking at. Exact copies are set aside first: the copy with the smallest doc_id speaks
   for all, and every other copy of 50 words or more is removed whole.
2. extension: around marked anchors all 50-word windows are hashed, with 128 bits, in both the documents
   that lose text and the ones that keep it; a window goes if its least doc_id is smaller than its own.

Both steps only ever take minima by hash, which are pre-aggregated before the shuffle, so a run that a third
of all documents share costs one row per task; the join back to the places is an ordinary equi-join whose
large partitions adaptive execution may split. No pairs of documents are built.

Defined cases: words are runs of non-blank characters, unchanged; null text has none; rows with a null
doc_id take no part and lose nothing; rows of one doc_id do not remove each other's words, and a repeated
row gives a repeated result row; doc_id is an integer (a text that is none raises an error under ANSI mode); an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenscope.llm.common import OWN, map_batches, release, spread_hash, table, texts_of, window_hashes

WINDOW = 50
PERIOD = 31
#: Fixed value: a perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
RUN = WINDOW - PERIOD + 1

_cache: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D; bytes.split() parts at exactly these."""
    return text.encode().split()


def anchor_positions(n_words: int) -> np.ndarray:
    at = np.arange(max(0, n_words - RUN + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def whole_hash(joined: bytes) -> bytes:
    return hashlib.blake2b(joined, digest_size=16).digest()


def _variant(joined: bytes) -> int:
    return xxhash.xxh32_intdigest(joined) >> 1


def _scan(docs: DataFrame) -> DataFrame:
    """doc, whole, variant, n_words, kept_sha256 (with nothing removed) and the runs at anchors, for each row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs_ = batch.column(0)
        wholes, variants, counts, shas, runs = [], [], [], [], []
        none = np.empty(0, np.int64)
        for doc, text in zip(docs_.to_pylist(), texts_of(batch.column(1))):
            words = words_of(text)
            joined = b" ".join(words)
            counts.append(len(words))
            variants.append(_variant(joined))
            shas.append(hashlib.sha256(joined).hexdigest())
            part = doc is not None and len(words) >= WINDOW
            wholes.append(whole_hash(joined) if part else None)
            runs.append(_signed(window_hashes(spread_hash(words, _cache), RUN, 1)[anchor_positions(len(words))]) if part else none)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), type=pa.int32()), pa.array(np.concatenate(runs), type=pa.int64()))
        return pa.RecordBatch.from_arrays(
            [docs_, pa.array(wholes, type=pa.binary()), pa.array(variants, type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array(shas), lists],
            names=["doc", "whole", "variant", "n_words", "kept_sha256", "runs"],
        )

    kinds = "doc long, whole binary, variant long, n_words long, kept_sha256 string, runs array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), one, kinds)


def _own_places(places: list[int] | None, joined: bytes, variants: bool) -> np.ndarray:
    """Numbers of the places that belong to this text. A place is variant * 2**32 + number; variants tell the texts of one doc_id apart."""
    at = np.array(places or [], dtype=np.int64)
    return at[(at >> 32) == (_variant(joined) if variants else 0)] & 0xFFFFFFFF


def _windows(marked: DataFrame, variants: bool) -> DataFrame:
    """Hashes of all windows that hold a marked anchor; marked has doc, text and anchors (places)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for doc, text, marks in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
            words = words_of(text)
            joined = b" ".join(words)
            marks, last = _own_places(marks, joined, variants), len(words) - WINDOW
            if last < 0 or not len(marks):
                continue
            at = anchor_positions(len(words))[marks]
            wanted = np.zeros(last + 2, dtype=np.int64)
            np.add.at(wanted, np.clip(at - (WINDOW - RUN), 0, last + 1), 1)
            np.add.at(wanted, np.clip(at + 1, 0, last + 1), -1)
            starts = np.flatnonzero(np.cumsum(wanted[: last + 1]) > 0)
            hashes = spread_hash(words, _cache)
            out[0].append(np.full(len(starts), doc, dtype=np.int64))
            out[1].append(starts + ((_variant(joined) if variants else 0) << 32))
            out[2].append(_signed(window_hashes(hashes, WINDOW, 2)[starts]))
            out[3].append(_signed(window_hashes(hashes, WINDOW, 3)[starts]))
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]), type=pa.int64()) for x in out], names=["doc", "place", "h1", "h2"])

    return map_batches(marked, one, "doc long, place long, h1 long, h2 long")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur in more than one document, with the least of them."""
    return rows.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select(*keys, "least")


def _copies(scan: DataFrame) -> DataFrame:
    """(doc, whole) of the documents whose whole word sequence a smaller doc_id has."""
    each = scan.where("whole is not null").select("doc", "whole").distinct()
    firsts = each.groupBy("whole").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("whole", "first")
    return each.join(firsts, "whole").where("doc > first").select("doc", "whole")


@dataclass
class Removals:
    """scan: all rows; copies: doc, whole of what goes entirely; marked: doc, text of the rest that shares runs; found: doc, starts of its windows that go."""

    scan: DataFrame
    copies: DataFrame
    marked: DataFrame
    found: DataFrame
    variants: bool


def find(docs: DataFrame) -> Removals:
    """Each phase ends in a checkpoint, after which the shuffles behind it can be deleted."""
    spark = docs.sparkSession
    scan = _scan(docs).checkpoint()
    copies = _copies(scan).checkpoint()
    several = scan.where("doc is not null").groupBy("doc").agg(F.min("variant").alias("a"), F.max("variant").alias("b"))
    variants = bool(several.where("a < b").take(1))
    release(spark)
    alone = scan.where("whole is not null").join(copies, ["doc", "whole"], "left_anti")
    runs = alone.select("doc", "variant", F.posexplode("runs").alias("number", "run")).select(
        "doc", "run", (F.shiftleft(F.col("variant") if variants else F.lit(0).cast("long"), 32) + F.col("number")).alias("place")
    )
    common = _shared(runs, ["run"]).checkpoint()
    release(spark)
    marks = runs.join(common, "run").groupBy("doc").agg(F.collect_set("place").alias("anchors")).checkpoint()
    release(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    marked = texts.join(marks, "doc").select("doc", "text", "anchors").checkpoint()
    release(spark)
    windows = _windows(marked, variants)
    shared = _shared(windows, ["h1", "h2"]).checkpoint()
    release(spark)
    hits = windows.join(shared, ["h1", "h2"]).where("doc > least")
    found = hits.groupBy("doc").agg(F.collect_set("place").alias("starts")).checkpoint()
    release(spark)
    return Removals(scan, copies, marked.select("doc", "text"), found, variants)


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    """Words outside the windows that begin at starts."""
    if not len(starts):
        return words
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + WINDOW, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) for every row."""
    r = find(docs)
    variants = r.variants

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, starts in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
            words = words_of(text)
            joined = b" ".join(words)
            kept = kept_words(words, _own_places(starts, joined, variants))
            out.append((doc, _variant(joined), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        doc, variant, n, sha = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, type=pa.int64()), pa.array(variant, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(sha)], names=["doc", "variant", "cut", "cut_sha"]
        )

    cuts = map_batches(r.marked.join(r.found, "doc"), one, "doc long, variant long, cut long, cut_sha string").dropDuplicates(["doc", "variant"])
    rows = r.scan.drop("runs").join(r.copies.withColumn("copy", F.lit(True)), ["doc", "whole"], "left").join(cuts, ["doc", "variant"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("cut_sha", "kept_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of text (the rest joined by one space) and n_chars, where there is one, counted anew.

    Texts that lose nothing stay as they are; a text that loses all words becomes empty. No row goes.
    """
    r = find(docs)
    variants, names = r.variants, docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    whole = r.copies.groupBy("doc").agg(F.collect_set("whole").alias(OWN + "copies"))
    edits = r.found.withColumnRenamed("starts", OWN + "starts").join(whole, "doc", "full").withColumnRenamed("doc", OWN + "doc")
    kinds = [docs.schema[n] for n in names]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        texts, starts, copies = (batch.column(i).to_pylist() for i in (at_text, len(names), len(names) + 1))
        changed = []
        for i, text in enumerate(texts):
            if starts[i] or copies[i]:
                words = words_of(text or "")
                joined = b" ".join(words)
                if copies[i] and whole_hash(joined) in copies[i]:
                    texts[i] = ""
                    changed.append(i)
                elif len(kept := kept_words(words, _own_places(starts[i], joined, variants))) < len(words):
                    texts[i] = b" ".join(kept).decode()
                    changed.append(i)
        if changed:
            columns[at_text] = pa.array(texts, type=columns[at_text].type)
            if at_chars is not None:
                counts = columns[at_chars].to_pylist()
                for i in changed:
                    counts[i] = len(texts[i])
                columns[at_chars] = pa.array(counts, type=columns[at_chars].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    joined = docs.join(edits, docs["doc_id"].cast("long") == edits[OWN + "doc"], "left")
    return map_batches(joined.select(*[docs[n] for n in names], OWN + "starts", OWN + "copies"), one, StructType(kinds))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


#: The definition itself: every window of every document by its words.
SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as i from d),
h as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as k from s),
m as (select k, min(doc_id) as least from h group by k),
g as (select doc_id, i, max(i) over (partition by doc_id order by i range between 49 preceding and current row) as x from h join m using (k) where doc_id > least),
c as (select distinct doc_id, unnest(range(i, i + 50)) as p from g),
n as (select doc_id, list(p) as gone from c group by doc_id),
k as (select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
 case when gone is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(gone, z[2])), lambda z: z[1]) end as kept from d left join n using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""
