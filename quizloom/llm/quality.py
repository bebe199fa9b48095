"""Quality rules with risk-controlled thresholds.

Each document gets a few text statistics.  A base rule rejects documents that are too
short or repeat themselves.  Beyond it there are rules (a statistic above a cutoff), whose
cutoffs are chosen together for each stratum on a labelled holdout.  A candidate is one cutoff,
or none, for every rule; it rejects what any of its rules rejects.  It is allowed if the share of good
documents that it so rejects falsely is, by the exact (Clopper-Pearson) binomial upper bound, at
most ``max_false_rejection`` in the stratum.  All bounds hold together with probability
1 - ``delta``: delta is divided by the number of bounds computed (Bonferroni, over strata and
candidates), so any allowed candidate may be picked.  The one picked rejects most bad documents, a
good one weighing as much as ``WEIGHT`` bad ones; ties go to the larger cutoffs.  A stratum in
which nothing is allowed or gains, as one with few labels, gets no cutoffs, whatever others get.

The text statistics are computed by an Arrow function, one row at a time and independent of
others, and written; texts are never shuffled.  The holdout is summed to at most
``2 * (cutoffs + 1) ** rules`` rows per stratum before it is gathered there, so a task's group doesn't
grow with the labels, and nothing but the number of strata reaches the driver.

Defined results: a null text has no words; a null key is kept as a row and matches no
label; a document labelled more than once counts once, as bad if any label is bad; null
labels are ignored; a null stratum is a stratum of its own; rows that share a key are all rows of
the holdout; an empty table or a holdout without good documents gives no cutoffs, so only the
base rule rejects; further columns, of whatever name, are carried or ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_a_batch, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules: a share in thousandths of what it is taken from; above the cutoff a document is rejected.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
}
WEIGHT = 20
#: Candidate cutoffs, fixed before any label is seen.
CUTOFFS = (10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500)
#: Strata whose cutoffs may be broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 100_000


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = WORD.findall(text)
    n = len(words)
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            until = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATS]))
def _stats(texts: pa.Array) -> pa.Array:
    rows = [text_stats(x.as_py() or "") for x in texts]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(STATS), names=list(STATS))


def with_stats(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of ``text``; only the text goes to Python, and only numbers come back."""
    return df.select(*keep, _stats(F.col(text)).alias("__stats")).select(*keep, "__stats.*")


def base_failed() -> Column:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _share(rule: str) -> Column:
    part, of = RULES[rule]
    return F.coalesce(F.floor(F.col(part) * 1000 / F.when(F.col(of) > 0, F.col(of))), F.lit(0)).cast("int")


def upper_bound(bad: int, n: int, error: float) -> float:
    """Exact binomial upper bound: the largest rate at which ``bad`` or fewer of ``n`` still have probability ``error``."""
    if n == 0 or bad >= n:
        return 1.0

    def at_most(p: float) -> float:
        log_p, log_q = math.log(p), math.log1p(-p)
        top = -math.inf
        logs = []
        for k in range(bad, -1, -1):
            x = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * log_p + (n - k) * log_q
            top = max(top, x)
            if x < top - 50:  # what is left adds nothing that a double could show
                break
            logs.append(x)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and at_most(mid) > error else (low, mid)
    return high


def most_allowed(n: int, error: float, limit: float) -> int:
    """The most false rejections among ``n`` good documents whose upper bound is within ``limit``; -1 if none is."""
    low, high = -1, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if upper_bound(mid, n, error) <= limit else (low, mid - 1)
    return low


def best_cutoffs(good: np.ndarray, bad: np.ndarray, error: float, limit: float) -> tuple[int, ...] | None:
    """One cutoff's place for every rule, len(CUTOFFS) for none, from how many documents exceed how many
    cutoffs of each rule; None if no candidate is allowed and gains."""
    kept_good, kept_bad = good, bad
    for axis in range(good.ndim):
        kept_good, kept_bad = kept_good.cumsum(axis), kept_bad.cumsum(axis)
    false = good.sum() - kept_good
    gain = (bad.sum() - kept_bad) - WEIGHT * false
    gain = np.where(false <= most_allowed(int(good.sum()), error, limit), gain, 0)
    if gain.max() <= 0:
        return None
    return max(zip(*np.nonzero(gain == gain.max()), strict=True), key=lambda at: (sum(at), at))


def choose_cutoffs(scored: DataFrame, labels: DataFrame, key: str, stratum: str, max_false_rejection: float, delta: float) -> DataFrame:
    """(stratum, one cutoff or null for every rule) from the labelled part of ``scored``."""
    truth = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("__quality"))
    held = scored.where(~base_failed()).join(truth, key)
    # how many cutoffs a share exceeds: counts of those are all that a bound needs
    level = lambda rule: F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: c < _share(rule))).alias(rule)
    counts = written(held.select(F.col(stratum).alias("s"), (F.col("__quality") >= 1).alias("good"), *map(level, RULES)).groupBy("s", "good", *RULES).count())
    n_strata = counts.select("s").distinct().count()
    levels = len(CUTOFFS) + 1
    error = delta / max(1, n_strata * levels ** len(RULES))

    def choose(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tables = np.zeros((2,) + (levels,) * len(RULES), "i8")
        np.add.at(tables, tuple(rows[c].to_numpy().astype("i8") for c in ("good", *RULES)), rows["count"].to_numpy())
        best = best_cutoffs(tables[1], tables[0], error, max_false_rejection)
        cutoffs = [[CUTOFFS[i] if i < len(CUTOFFS) else None] for i in best or ()] or [[]] * len(RULES)
        own = [] if best is None else [key[0].as_py()]
        return pa.table([pa.array(own, pa.string()), *(pa.array(c, pa.int32()) for c in cutoffs)], names=["s", *RULES])

    schema = T.StructType([T.StructField("s", T.StringType()), *(T.StructField(r, T.IntegerType()) for r in RULES)])
    return written(counts.withColumn("s", F.col("s").cast("string")).groupBy("s").applyInArrow(choose, schema))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    carry: list[str] | None = None,
    max_false_rejection: float = 0.05,
    delta: float = 0.05,
) -> DataFrame:
    """(key, stratum, carried columns, statistics, base_failed, kept) for every document."""
    keep = list(dict.fromkeys([key, stratum, *(carry or [])]))
    # texts are read once; the labels meet a few numbers per document, not texts
    scored = written(with_stats(rows_a_batch(docs, 500), keep, text))
    cutoffs = choose_cutoffs(scored, labels, key, stratum, max_false_rejection, delta).withColumnsRenamed({"s": "__s", **{r: f"__{r}" for r in RULES}})
    few = cutoffs.count() <= BROADCAST_STRATA
    judged = scored.join(F.broadcast(cutoffs) if few else cutoffs, F.col(stratum).cast("string").eqNullSafe(F.col("__s")), "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_share(rule) > F.col(f"__{rule}"), F.lit(False))
    return judged.select(*scored.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the statistics, base_failed and kept."""
    return judge(docs, labels).select("doc_id", *STATS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    columns = docs.columns
    own = {c: f"__c{i}" for i, c in enumerate(columns)}  # so that no column's name clashes with a statistic's
    inner = docs.toDF(*own.values())
    truth = labels.select(F.col("doc_id").alias(own["doc_id"]), "quality")
    good = judge(inner, truth, own["doc_id"], own["text"], own["lang"], carry=list(own.values())).where("kept")
    return good.select(*(F.col(n).alias(c) for c, n in own.items()))
