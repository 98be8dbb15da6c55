"""Audit of how far the sources of a language diverge in their words.

Terms are runs of letters (A-Z, a-z and everything beyond ASCII), only A-Z lower-cased. A language keeps the terms that at
least MIN_DOCS of its documents hold. Each group (lang, source), and each language, gives each kept term a share of
SCALE with one added count of two (see ``share``), zeros included; two shares p and q are ``apart`` by
(p - q)^2 / (p + q), a chi-square distance of integers. All arithmetic is exact.

Plan: tasks count the terms of their rows (occurrences and documents together) and send sums per group and term; all of a
term meets once, by (lang, term), where it is kept or dropped. Only counts above zero are ever rows. Zeros are filled in by
arithmetic: a group gives all the terms it lacks one share, ``z``, so that the sum over the kept terms for two sources is what
all zeros would give, plus what each source's own counts change against the other's zeros (its terms of equal count
together), plus what changes once more where both hold a term, by a self-join on (lang, term). Two sources are
summed once, since the distance is symmetric; only sums per pair of sources leave the tasks.

Defined cases: null text, lang and source count as empty strings; repeated rows are documents of their own; doc_id isn't
read, so null or repeated ids change nothing; a group without terms has zero counts; a language without kept terms gives
its pairs of sources the value 0 and no terms; a source alone in its language has no pairs; an empty table gives an empty
result; columns other than text, lang and source are never read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenscope.llm.common import release, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Parts that the rows of a language are dealt into where its groups are too many to broadcast.
SALTS = 128
#: Groups that are broadcast at most; more are joined by shuffles.
FEW = 2_000
#: Counts that a task holds before it sends them on, and bytes of a text whose terms are cut at a time.
HELD, PIECE = 600_000, 1 << 22

#: Bytes of UTF-8: A-Z lower-cased, what is in no term a space; bytes beyond ASCII stay.
_LETTERS = bytes(ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)) + bytes(range(128, 256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of a long one part by part, cut between terms."""
    text = text.translate(_LETTERS)
    while len(text) > PIECE:
        cut = text.find(b" ", PIECE)
        if cut < 0:
            break
        yield text[:cut].split()
        text = text[cut:]
    yield text.split()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (rows that hold it), summed over up to HELD of them; sums of one key may come again."""
    groups: dict = defaultdict(lambda: (Counter(), Counter()))

    def sums() -> Iterator[pa.RecordBatch]:
        columns: tuple[list, ...] = ([], [], [], [], [])
        while groups:
            (lang, source), (n, docs) = groups.popitem()
            for column, values in zip(columns, ([lang] * len(n), [source] * len(n), n, n.values(), map(docs.__getitem__, n))):
                column.extend(values)
            if len(columns[0]) > 50_000 or not groups:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])
                columns = ([], [], [], [], [])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = groups[lang, source]
            held -= len(n)
            distinct: set[bytes] = set()
            for terms in _pieces(text):
                n.update(terms)
                distinct.update(terms)
            docs.update(distinct)
            held += len(n)
            if held > HELD:
                yield from sums()
                held = 0
    yield from sums()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, everywhere (occurrences in the language), held: (source, n) of each source that has the term."""
    sums = docs.select(_text("lang"), _text("source"), _text("text").cast("binary").alias("text")).mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    # dealt once, by (lang, term): what follows groups by more or by just these
    counts = sums.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    found = counts.withColumns({"in_docs": F.sum("docs").over(of_term)}).where(F.col("in_docs") >= min_docs)
    return found.groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.collect_list(F.struct("source", "n")).alias("held"))


def share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * v)); decimals, as the product may pass 64 bits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (F.expr(n) + 2).cast("decimal(20,0)")
    below = (F.col(total) + 2 * F.col("v")).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, below)


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def per_group(groups: DataFrame, rows: DataFrame, keys: list[str], by: str, few: bool) -> DataFrame:
    """Rows with their groups, by keys; groups are broadcast if few, else rows are dealt by a hash of a column too, so that no language is one task's."""
    if few:
        return rows.join(F.broadcast(groups), keys)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return groups.withColumn("salt", salts).join(rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")), [*keys, "salt"]).drop("salt")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, v (kept terms), of_lang, of_group (occurrences of kept terms), z (share of a term that the group lacks; null if v is 0)."""
    of_group = kept.select("lang", F.explode("held").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("of_group"))
    return (
        docs.select(_text("lang"), _text("source"))
        .distinct()
        .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("everywhere").alias("of_lang")), "lang", "left")
        .join(of_group, ["lang", "source"], "left")
        .fillna(0, ["v", "of_lang", "of_group"])
        .withColumn("z", F.when(F.col("v") > 0, share("0", "of_group")))
    )


def ranked(df: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """Rows with their rank in the group, by value, then item."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = df.withColumn("rank", F.row_number().over(order))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has each other source of the language, part 'term' the top terms of the group."""
    kept = kept_terms(docs, min_docs).checkpoint()
    release(docs.sparkSession)
    groups = group_totals(docs, kept).checkpoint()
    few = groups.count() <= FEW
    item = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    rows = kept.select("lang", "term", "everywhere", F.explode("held").alias("x")).select("lang", "term", "everywhere", "x.source", "x.n")

    zeros = per_group(item, groups, ["lang"], "source", few).where("source < item").withColumn("value", F.coalesce(F.col("v") * apart("z", "y"), F.lit(0)))
    counts = per_group(groups, rows.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), ["lang", "source"], "n", few)
    own = per_group(item, counts.withColumn("p", share("n", "of_group")), ["lang"], "n", few).where("source != item")
    own = own.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("terms") * (apart("p", "y") - apart("z", "y"))).alias("value"))
    shares = per_group(groups, rows, ["lang", "source"], "term", few).withColumn("p", share("n", "of_group"))
    one = shares.select("lang", "term", "source", "p", "z")
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("z").alias("y"))
    both = one.join(other, ["lang", "term"]).where("source < item").withColumn("value", apart("p", "q") - apart("p", "y") - apart("z", "q") + apart("z", "y"))
    parts = (x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (own, both))
    once = reduce(DataFrame.unionByName, parts, zeros.select("lang", "source", "item", "value"))
    once = once.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = once.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    terms = shares.withColumn("q", share("everywhere", "of_lang")).where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    return ranked(pairs, "pair").union(ranked(terms, "term", top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') as text
  from documents
), terms as (
  select doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) as term from docs
), counts as (
  select lang, source, term, count(*) as n from terms group by all
), kept as (
  select lang, term, count(*) as everywhere from terms group by all having count(distinct doc) >= {MIN_DOCS}
), langs as (
  select lang, count(*) as v, sum(everywhere) as of_lang from kept group by lang
), groups as (
  select distinct lang, source from docs
), filled as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.everywhere, l.v, l.of_lang,
         sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as of_group
  from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), dense as (
  select lang, source, term, n,
         1 + ({SCALE}::hugeint * (n + 2)) // (of_group + 2 * v) as p,
         1 + ({SCALE}::hugeint * (everywhere + 2)) // (of_lang + 2 * v) as q
  from filled
), sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from dense where n > 0 and p > q
), placed as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from found
)
select lang, source, part, item, value, rank from placed where part = 'pair' or rank <= {TOP}
"""
