"""Quality rules whose cutoffs carry an exact binomial guarantee on false rejections."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, staged

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Each rule: a metric that is high in bad text, and its cutoffs from the most lenient on; a text above the cutoff is rejected.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", [3.0 - 0.1 * i for i in range(29)]),
    "repeated_word_share": ("n_repeat_words", "n_words", [1.0 - 0.025 * i for i in range(38)]),
    "duplicate_line_share": ("n_dup_lines", "n_lines", [0.95 - 0.05 * i for i in range(18)]),
    "chars_per_word": ("word_chars", "n_words", [16.0 - 0.5 * i for i in range(22)]),
}


def text_stats(text: str) -> tuple[int, ...]:
    """STATS of one whole text. Words are runs without ASCII white space; n_lines are lines with a word; n_dup_lines those
    equal to an earlier line; n_repeat_words the words inside a 3-word window that the text has twice or more."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            cols = zip(*map(text_stats, part.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "stratum", "same", *STATS])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed from the largest term down."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def select_cutoff(good: list[int], bad: list[int], grid: list[float], alpha: float, delta: float, cost: float) -> float | None:
    """The cutoff to use, None if none is certified. good and bad: documents above each cutoff, then (last) all of them.

    Cutoffs are tested from the most lenient on, each at level delta, up to the first that fails (fixed-sequence testing, so
    the grid needs no correction of its own): one is certified if alpha exceeds the exact (Clopper-Pearson) upper bound of
    the rate of good documents rejected, that is, if so few rejections have probability delta or less at rate alpha. Of the
    certified ones the best by bad minus cost times good rejections is taken, the most lenient of equals.
    """
    best, chosen = 0.0, None
    for j, cutoff in enumerate(grid):
        if not good[-1] or binomial_tail(good[j], good[-1], alpha) > delta:
            break
        if (gain := bad[j] - cost * good[j]) > best:
            best, chosen = gain, cutoff
    return chosen


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    strata: tuple[str, ...] = ("en", "de", "fr", "es"),
    alpha: float = 0.04,
    delta: float = 0.05,
    cost: float = 10.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """Judge every whole text: a row with id, STATS, base_failed, reasons (rules that reject it) and kept.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. The others meet RULES, whose
    cutoffs are selected for each stratum from all labelled documents (label_col 1 good, 0 bad) that pass the base; the
    metrics are fixed beforehand, so the labelled set serves as the holdout. With probability 1 - delta, in every stratum at
    once, at most alpha of the good texts are rejected (texts with several copies count once; near copies are not told apart): each rule has alpha / rules, and delta is divided by rules times
    strata (Bonferroni). Without enough labels no cutoff is certified and the rule rejects nothing.

    Strata are the values given and one more for all others, nulls included, so the collected counts have a fixed size.
    Null text is empty and fails the base. A document with both labels counts as good, and so does a text of which any copy is. Repeated rows are judged alike; labels
    without a document or value are left out; an empty table gives an empty result; other columns are not read.
    """
    stratum = F.when(F.col(stratum_col).isin(*strata), F.col(stratum_col)).otherwise("")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", "stratum", F.xxhash64("text").alias("same"), "text")
    stats = staged(src.mapInArrow(_stats, "doc_id long, stratum string, same long, " + ", ".join(f"{c} long" for c in STATS)), "stats")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    metric = {r: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for r, (a, b, _) in RULES.items()}

    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("good"))
    level = lambda r: F.size(F.filter(F.array(*(F.lit(c) for c in RULES[r][2])), lambda c: metric[r] <= c))
    # Copies are one trial, not several: the bound is of independent ones.
    trials = stats.where(~failed).join(known, "doc_id").groupBy("stratum", "same").agg(F.max("good").alias("good"), *(F.max(c).alias(c) for c in STATS))
    rows = trials.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES))).alias("x"))
    hist = rows.groupBy("stratum", "good", "x.rule", "x.level").agg(F.count("*").alias("n")).collect()  # at most strata x 2 x rules x cutoffs
    tests = len(RULES) * (len(strata) + 1)
    cutoffs: dict[str, list] = {r: [] for r in RULES}
    for s in (*strata, ""):
        for r, (_, _, grid) in RULES.items():
            above = {}
            for g in (0, 1):
                own = Counter({x["level"]: x["n"] for x in hist if (x["stratum"], x["rule"], x["good"]) == (s, r, g)})
                above[g] = [sum(n for lv, n in own.items() if lv <= j) for j in range(len(grid))] + [sum(own.values())]
            c = select_cutoff(above[1], above[0], grid, alpha / len(RULES), delta / tests, cost)
            if c is not None:
                cutoffs[r].append((s, c))
    reasons = F.array_compact(F.array(*(F.when(~failed & F.coalesce(F.expr("false") if not cuts else _any(F.col("stratum"), metric[r], cuts), F.lit(False)), F.lit(r)) for r, cuts in cutoffs.items())))
    out = stats.withColumn("base_failed", failed).withColumn("reasons", reasons)
    return out.select(F.col("doc_id").alias(id_col), *STATS, "base_failed", "reasons", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"))


def _any(stratum, metric, cuts: list[tuple[str, float]]) -> F.Column:
    test = F.lit(False)
    for s, c in cuts:
        test = test | ((stratum == s) & (metric > c))
    return test
