"""Quality rules with risk-controlled cutoffs.

Every document gets base counts (see ``base_counts``) and three badness scores from 0 to 100:
symbols per 100 words, shouted words per 100 words, and words of repeated three-word windows per 100
words. Each stratum (lang) has a cutoff for each rule; a document is rejected if a score is above its rule's cutoff.

The scores are of unlike scale, so each rule gets its own from the stratum's rows: the lift of a score s is the share of the labelled
bad documents with s or more (less one standard deviation of their number) over the share of the rows with s or more, among
rows that no label calls good. At level t every rule rejects the scores from its least one whose lift is PATH / t or
more; from lift 1 on nothing more is rejected. So the levels are one nested path of cutoff vectors, along which each rule acts as far as
bad documents show it, and which is fixed without a look at the good labelled documents. A stratum in which every good document
is labelled has no rows to compare bad ones with, and gets no cutoffs: leave some unlabelled.

The vector comes from the labelled documents. For a stratum with n good ones (quality 1, base rules passed), of which k(t) are
rejected at level t by any rule, level t is safe if P(X <= k(t)) <= delta' for X ~ Binomial(n, alpha): then the exact
(Clopper-Pearson) upper bound of the stratum's false rejection rate, by all rules together, is at most alpha. Levels are
tested from 0 upwards and testing stops at the first that is not safe (fixed-sequence testing: what a higher level rejects
holds what a lower one does); between strata delta is divided by the strata's shares of all rows (Bonferroni with weights that
no label touches). So with probability 1 - delta no stratum loses more than alpha of its good documents. Of the safe levels
the one is taken that best sets the stratum's labelled bad documents apart, so that good ones are not rejected for nothing. A
stratum with too few labels gets no cutoffs: there the base rules alone decide.

Defined cases: null or blank text has no words and fails the base rules; null lang is a stratum of its
own, as is an empty one; labels with nulls, or for unknown documents, count for nothing; when a document has several labels
the lowest counts; repeated rows are judged each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from operator import le

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenscope.llm.common import OWN, map_batches, table, texts_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RULES = ("symbol", "shout", "repeat")
FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "symbol_score int, shout_score int, repeat_score int"
)
ALPHA, DELTA, MIN_WORDS = 0.02, 0.05, 50
#: The last level of the path of cutoffs, where lift is 1.
PATH = 100
#: How many times the share of rejected good documents counts against the share of rejected bad ones, among safe cutoffs.
GOOD_WEIGHT = 10


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    ids = np.array([put(w, len(seen)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:n] * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple:
    """The values of FEATURES for one text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = repeated_words(words)
    shouted = sum(map(str.isupper, text.split())) if n else 0
    score = lambda x: min(100, 100 * x // n) if n else 100
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, score(symbols), score(shouted), score(repeats)


def _columns(texts: list[str]) -> list[pa.Array]:
    rows = list(map(base_counts, texts))
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int32()] * 3
    return [pa.array(list(x), type=t) for x, t in zip(zip(*rows), kinds)]


NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and FEATURES for every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *_columns(texts_of(batch.column(2)))], names=["doc_id", "lang", *NAMES]
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"), one, f"doc_id long, lang string, {FEATURES}")


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in terms)))


def is_safe(k: int, n: int, alpha: float, delta: float) -> bool:
    return n > 0 and k < alpha * n and log_binomial_tail(k, n, alpha) <= math.log(delta)


def choose_level(good: list[int], n: int, bad: list[int], n_bad: int, alpha: float, delta: float) -> int | None:
    """Of the safe levels the one that sets most of the bad apart from the good, the lowest of equals; good[t], bad[t]: good and bad ones rejected at level t.

    Safe are the levels from 0 upwards until the first that is not.
    """
    best, gain = None, -1.0
    for t, (k, found) in enumerate(zip(good, bad)):
        if not is_safe(k, n, alpha, delta):
            break
        now = found / max(1, n_bad) - GOOD_WEIGHT * k / n
        if now > gain:
            best, gain = t, now
    return best


STRATUM = [f"{OWN}known", f"{OWN}lang"]


def _by_rule(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each rule, with its number and score."""
    scores = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"{r}_score").alias("score")) for i, r in enumerate(RULES)])
    return rows.select(*STRATUM, *columns, F.inline(scores))


def levels(each: DataFrame) -> DataFrame:
    """STRATUM, rule, score, level of each score above 0 that occurs in each (STRATUM, good, scores, m): at most 300 a stratum; no level: never rejected."""
    others = F.sum(F.when(F.coalesce("good", F.lit(False)), 0).otherwise(F.col("m")))
    counts = _by_rule(each, "good", "m").groupBy(*STRATUM, "rule", "score").agg(others.alias("rows"), F.sum(F.when(~F.col("good"), F.col("m")).otherwise(0)).alias("bad"))
    of_rule = Window.partitionBy(*STRATUM, "rule")
    more = of_rule.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tails = counts.select(*STRATUM, "rule", "score", *[F.sum(c).over(w).alias(name) for c in ("rows", "bad") for w, name in ((more, c), (of_rule, f"all_{c}"))])
    sure = F.col("bad") - F.sqrt("bad")
    level = F.when(sure > 0, F.ceil(PATH * F.col("rows") * F.col("all_bad") / (F.col("all_rows") * sure)))
    least = F.min(F.when(level <= PATH, level)).over(of_rule.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    return tails.where("score > 0").select(*STRATUM, "rule", "score", least.cast("int").alias("level"))


def fit_cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, tuple[int, ...]]:
    """stratum -> cutoffs of RULES. All rows of feats and all labels count; the driver gets at most some 500 numbers a stratum."""
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"))
    )
    scores = [f"{r}_score" for r in RULES]
    rows = feats.where("not base_failed").select("doc_id", F.col("lang").isNotNull().alias(STRATUM[0]), F.coalesce("lang", F.lit("")).alias(STRATUM[1]), *scores)
    each = rows.join(labelled, "doc_id", "left").groupBy(*STRATUM, "good", *scores).agg(F.count(F.lit(1)).alias("m")).checkpoint()
    path = levels(each).checkpoint()
    of_label = _by_rule(each.where("good is not null"), "good", "m", *scores).join(path, [*STRATUM, "rule", "score"], "left")
    of_label = of_label.groupBy(*STRATUM, "good", *scores).agg(F.min("level").alias("level"), F.first("m").alias("m"))
    counts = of_label.groupBy(*STRATUM, "good", "level").agg(F.sum("m").alias("m")).collect()
    sizes = {(x[0], x[1]): x.m for x in each.groupBy(*STRATUM).agg(F.sum("m").alias("m")).collect()}
    found = path.collect()
    out = {}
    for stratum in {(x[0], x[1]) for x in counts if x.good}:
        rejected, n = {True: [0] * (PATH + 1), False: [0] * (PATH + 1)}, {True: 0, False: 0}
        for x in counts:
            if (x[0], x[1]) == stratum:
                n[x.good] += x.m
                for t in range(PATH + 1 if x.level is None else x.level, PATH + 1):
                    rejected[x.good][t] += x.m
        t = choose_level(rejected[True], n[True], rejected[False], n[False], alpha, delta * sizes[stratum] / sum(sizes.values()))
        if t:
            own = [x for x in found if (x[0], x[1]) == stratum and x.level is not None and x.level <= t]
            out[stratum[1] if stratum[0] else None] = tuple(min((x.score - 1 for x in own if x.rule == i), default=100) for i in range(len(RULES)))
    return out


def accepted(cutoffs: dict[str | None, tuple[int, ...]]) -> Column:
    """Whether a row of features passes the base rules and its stratum's cutoffs."""
    bad = F.col("base_failed")
    for lang, cuts in sorted(cutoffs.items(), key=str):
        above = [F.col(f"{r}_score") > c for r, c in zip(RULES, cuts)]
        bad = bad | (F.col("lang").eqNullSafe(F.lit(lang)) & (above[0] | above[1] | above[2]))
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, lang, FEATURES and kept for every row. Features are computed once and cut off from the texts by a checkpoint."""
    feats = features(docs).checkpoint()
    return feats.withColumn("kept", accepted(fit_cutoffs(feats, labels, alpha, delta)))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; rows are filtered where they are read, without a join. Only scores are kept for the fit."""
    cutoffs = fit_cutoffs(features(docs).select("doc_id", "lang", "base_failed", *[f"{r}_score" for r in RULES]).checkpoint(), labels, alpha, delta)
    none = (100,) * len(RULES)
    names = docs.columns
    at_text, at_lang = names.index("text"), names.index("lang")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(at_lang).to_pylist()
        rows = map(base_counts, texts_of(batch.column(at_text)))
        mask = [not r[5] and all(map(le, r[6:], cutoffs.get(lang, none))) for r, lang in zip(rows, langs)]
        return batch.filter(pa.array(mask, type=pa.bool_()))

    return map_batches(docs, one, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "symbol_score", "shout_score", "repeat_score")
