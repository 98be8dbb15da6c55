"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs are its lines; long ones are held as pieces of at least LEAST words that end with a sentence, or
after MOST words, so that a change touches few pieces. The set of the pieces' 64-bit digests is sketched: each digest goes
into three of the CELLS cells, one of each third, and a cell holds the number, the exclusive or of the digests and that of
their hashes. The sketch of a whole text is its fingerprint, see ``encode``.

Two sketches are subtracted cell by cell, so that shared digests vanish. Peeling takes the cells that hold one digest
(number 1 or -1 and the right hash), removes these digests from their other cells, and so on; if all cells end up empty, the
digests that differ are known. If not, the attempt failed and is made again with a sketch four times as large: the digests
are dealt by two more of their bits to four sketches with other positions, and only those that still fail are dealt
further (``differences``). What LEVELS levels leave, if anything, is compared directly. Likeness is the Jaccard likeness
of the sets of digests, from the numbers and the differences. All this happens within a row, by array functions; the work
grows with the number of pieces times the logarithm of their number.

``versions`` gives each document its edited text: the next document in ascending doc_id comes by a join on doc_id. Only ids
are put in order (dealt by ranges, a window per range, the ranges' first ids linked), and only as many characters as a
text needs are sent, with the digests.

Defined cases: null text counts as empty; a text without words has an empty sketch, and two empty sketches have likeness 1;
repeated pieces count once; a null doc_id comes before all others; rows with the same doc_id have the same next document,
and of several rows with the next doc_id the one counts whose asked-for start is least, of equal ones the least list of digests; the
only doc_id is its own next; every row gives one row, repeated ones too; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenscope.llm.common import table

LEAST, MOST = 4, 16
PIECE = (
    rf"(?:\S++[^\S\n]++){{{LEAST - 1}}}(?:\S++(?<![.!?])[^\S\n]++){{0,{MOST - LEAST}}}\S++"
    rf"|\S++(?:[^\S\n]++\S++){{0,{LEAST - 2}}}"
)
THIRD, CELLS = 8, 24
#: Most rounds of peeling, most enlargements.
ROUNDS, LEVELS = 8, 16
LONGS = "array<bigint>"
CELL = "struct<n:bigint,k:bigint,f:bigint>"
NO_KEY = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's pieces, in the order of the text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))


def places(level: Column) -> Column:
    """(mask, bits) of each cell at a level: a digest is in the cell if its bits under mask are bits, all of the lower half."""
    first = F.pmod(level * 7, F.lit(23)).cast("int")
    shift = lambda i: first + 3 * F.call_function("div", i, F.lit(THIRD)).cast("int")
    left = lambda x, n: F.call_function("shiftleft", x.cast("long"), n)
    return F.transform(
        F.sequence(F.lit(0), F.lit(CELLS - 1)),
        lambda i: F.struct(left(F.lit(7), shift(i)).alias("mask"), left(F.pmod(i, F.lit(THIRD)), shift(i)).alias("bits")),
    )


def cell(n: Column, k: Column, f: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), f.alias("f"))


def sketch(keys: Column, at: Column) -> Column:
    """CELLS cells of digests; at: the cells' places."""
    zero = cell(*[F.lit(0).cast("long")] * 3)
    inside = lambda p: F.filter(keys, lambda d: d.bitwiseAND(p.mask) == p.bits)
    return F.transform(at, lambda p: F.aggregate(inside(p), zero, lambda c, d: cell(c.n + 1, c.k.bitwiseXOR(d), c.f.bitwiseXOR(F.xxhash64(d)))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: cell(x.n - y.n, x.k.bitwiseXOR(y.k), x.f.bitwiseXOR(y.f)))


def peel(cells: Column, at: Column) -> Column:
    """struct(cells, plus, minus, going): what can't be taken out, the digests of the first sketch alone and of the second alone."""
    empty = F.array().cast(LONGS)
    start = F.struct(cells.alias("cells"), empty.alias("plus"), empty.alias("minus"), F.lit(True).alias("going"))

    def removed(cells: Column, keys: Column) -> Column:
        def one(c: Column, p: Column) -> Column:
            here = F.filter(keys, lambda x: x.k.bitwiseAND(p.mask) == p.bits)
            less = F.aggregate(here, c, lambda c, x: cell(c.n - x.n, c.k.bitwiseXOR(x.k), c.f.bitwiseXOR(x.f)))
            return F.when((c.n == 0) & (c.k == 0), c).otherwise(less)

        return F.zip_with(cells, at, one)

    def round_(s: Column, _: Column) -> Column:
        single = F.array_distinct(F.filter(s.cells, lambda c: (F.abs(c.n) == 1) & (c.f == F.xxhash64(c.k))))

        def take(keys: Column) -> Column:
            of = lambda sign: F.transform(F.filter(keys, lambda x: x.n == sign), lambda x: x.k)
            stop = F.struct(s.cells.alias("cells"), s.plus.alias("plus"), s.minus.alias("minus"), F.lit(False).alias("going"))
            more = F.struct(removed(s.cells, keys).alias("cells"), F.concat(s.plus, of(1)).alias("plus"), F.concat(s.minus, of(-1)).alias("minus"), F.lit(True).alias("going"))
            return F.when(F.size(keys) == 0, stop).otherwise(more)

        return F.when(~s.going, s).otherwise(let(single, take))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def is_empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c.n == 0) & (c.k == 0) & (c.f == 0))


def differences(a: Column, b: Column, first_a: Column, first_b: Column) -> Column:
    """struct(plus, minus, level): digests of a alone, of b alone, and how often sketches had to be enlarged.

    first_a and first_b are the sketches of level 0, the fingerprints.
    """
    none = F.array().cast(LONGS)
    parts = f"array<struct<a:{LONGS},b:{LONGS}>>"
    start = F.struct(F.array(F.struct(a.alias("a"), b.alias("b"))).cast(parts).alias("open"), none.alias("plus"), none.alias("minus"), F.lit(0).alias("level"))

    def attempt(p: Column, level: Column, at: Column) -> Column:
        cells = F.when(level == 0, subtract(first_a, first_b)).otherwise(subtract(sketch(p.a, at), sketch(p.b, at)))
        return F.struct(p.a.alias("a"), p.b.alias("b"), peel(cells, at).alias("r"))

    def step(s: Column, level: Column) -> Column:
        part = lambda keys, q: F.filter(keys, lambda d: F.call_function("shiftrightunsigned", d, F.lit(62) - 2 * level).bitwiseAND(F.lit(3).cast("long")) == q)

        def settle(tried: Column) -> Column:
            good = F.filter(tried, lambda t: is_empty(t.r.cells))
            bad = F.filter(tried, lambda t: ~is_empty(t.r.cells))
            four = F.flatten(F.transform(bad, lambda t: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.struct(part(t.a, q).alias("a"), part(t.b, q).alias("b")))))
            return F.struct(
                four.cast(parts).alias("open"),
                F.concat(s.plus, F.flatten(F.transform(good, lambda t: t.r.plus))).alias("plus"),
                F.concat(s.minus, F.flatten(F.transform(good, lambda t: t.r.minus))).alias("minus"),
                level.alias("level"),
            )

        return F.when(F.size(s.open) == 0, s).otherwise(let(places(level), lambda at: let(F.transform(s.open, lambda p: attempt(p, level, at)), settle)))

    def rest(s: Column) -> Column:
        left = lambda x, y: F.flatten(F.transform(s.open, lambda p: F.array_except(p[x], p[y])))
        return F.struct(F.concat(s.plus, left("a", "b")).alias("plus"), F.concat(s.minus, left("b", "a")).alias("minus"), s.level.alias("level"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, rest)


def held(cells: Column) -> Column:
    """Number of digests in a sketch: each is in one cell of the first third."""
    return F.aggregate(F.slice(cells, 1, THIRD), F.lit(0).cast("long"), lambda n, c: n + c.n)


def likeness(first_a: Column, first_b: Column, found: Column) -> Column:
    """Shared digests over all; found: the differences."""
    both = held(first_a) + F.size(found.minus)
    return F.when(both == 0, F.lit(1.0)).otherwise((held(first_a) - F.size(found.plus)) / both)


def encode(cells: Column) -> Column:
    """Cells as text: number (4 bytes), digests and hashes (8 bytes each), all in base 64."""
    wide = lambda x, n: F.lpad(F.hex(x), n, "0")
    text = F.base64(F.unhex(F.array_join(F.transform(cells, lambda c: F.concat(wide(c.n, 8), wide(c.k, 16), wide(c.f, 16))), "")))
    return F.translate(text, "\r\n", "")


def next_ids(docs: DataFrame) -> DataFrame:
    """key, next, need for each key of docs (key, text): the next larger key, the least after the largest; need: most characters asked of it.

    Keys are dealt by ranges; the window runs within a range, and the last key of a range gets the first of the next range
    that has any. Only these first keys, one a range, are gathered.
    """
    keys = docs.groupBy("key").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("need"))
    keys = keys.repartitionByRange("key").withColumn("range", F.spark_partition_id()).checkpoint()
    first = keys.groupBy("range").agg(F.min("key").alias("key"))
    first = first.select("range", F.coalesce(F.lead("key").over(Window.orderBy("range")), F.min("key").over(Window.partitionBy())).alias("after"))
    return keys.join(first, "range").select("key", "need", F.coalesce(F.lead("key").over(Window.partitionBy("range").orderBy("key")), "after").alias("next"))


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, next_digests for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(NO_KEY)))
    asked = next_ids(rows).select(F.col("next").alias("key"), F.col("key").alias("to"), "need")
    sent = rows.join(asked, "key").select("to", F.struct(F.expr("substring(text, 1, need)").alias("start"), digests(F.col("text")).alias("digests"), "doc_id").alias("sent"))
    # doc_id goes along only so that both joins read the same columns of rows, and so share one shuffle of the texts
    sent = sent.groupBy(F.col("to").alias("key")).agg(F.min("sent").alias("sent"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("sent.start", F.lit(1), quarter))
    return rows.join(sent, "key").select("doc_id", "text", edited.alias("edited"), F.col("sent.digests").alias("next_digests"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how often sketches were enlarged."""
    pieces = versions(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(F.col("edited")).alias("edited"),
        F.col("next_digests").alias("next"),
        places(F.lit(0)).alias("at"),
    )
    sketched = pieces.select("*", *[sketch(F.col(c), F.col("at")).alias(f"{c}_cells") for c in ("own", "edited", "next")])
    found = sketched.select("*", *[differences(F.col("own"), F.col(c), F.col("own_cells"), F.col(f"{c}_cells")).alias(f"{c}_found") for c in ("edited", "next")])
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encode(F.col("own_cells")).alias("fingerprint"),
        encode(F.col("edited_cells")).alias("edited_fingerprint"),
        *[likeness(F.col("own_cells"), F.col(f"{c}_cells"), F.col(f"{c}_found")).alias(f"near_{c}") for c in ("edited", "next")],
        *[F.col(f"{c}_found.level").alias(f"enlarged_{c}") for c in ("edited", "next")],
    )


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
