"""Scores of answers and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.overlap import rouge_l_f1
from ..functions.text import is_abstention, is_blank


def score_answers(df: DataFrame, answer: str, reference: str) -> DataFrame:
    """df with rouge_l_f1 (0.0 where either side is blank) and abstained."""
    both = ~is_blank(answer) & ~is_blank(reference)
    return df.withColumn("rouge_l_f1", F.when(both, rouge_l_f1(answer, reference)).otherwise(F.lit(0.0))).withColumn("abstained", is_abstention(answer))


def masked_pairs(df: DataFrame, left: str, right: str, scorer, default: float = 0.0) -> Column:
    """A score only where both texts are non-blank, the default elsewhere. scorer: two columns to a column."""
    return F.when(~is_blank(left) & ~is_blank(right), scorer(F.col(left), F.col(right))).otherwise(F.lit(default))


def summary(df: DataFrame, rouge: Column, judge: Column, abstained: Column, retried: Column | None = None, recovered: Column | None = None, by: list[str] | None = None, match: Column | None = None) -> DataFrame:
    """Means and rates: rows, mean_rouge_l, mean_match (of vector matching, if given), mean_judge, judge_percent (of 4),
    abstention_percent, retries and recoveries. An empty benchmark has no means and is an error."""
    if df.isEmpty():
        raise ValueError("An empty benchmark has no metrics")
    no = F.lit(False)
    out = [
        F.count("*").alias("n"),
        F.round(F.avg(rouge), 6).alias("mean_rouge_l"),
        *([F.round(F.avg(match), 6).alias("mean_match")] if match is not None else []),
        F.round(F.avg(judge), 6).alias("mean_judge"),
        F.round(F.avg(judge) / 4 * 100, 6).alias("judge_percent"),
        F.round(F.avg(abstained.cast("int")) * 100, 6).alias("abstention_percent"),
        F.count_if(retried if retried is not None else no).alias("retries"),
        F.count_if(recovered if recovered is not None else no).alias("recovered"),
    ]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def retrieval_diagnostics(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row with questions, mean documents used and mean context tokens; and (source, n), how often each source was used."""
    one = packed.agg(F.count("*").alias("questions"), F.round(F.avg(F.size("used")), 6).alias("mean_used"), F.round(F.avg("context_tokens"), 6).alias("mean_context_tokens"))
    by = packed.select(F.explode("used").alias("u")).groupBy(F.col("u.source").alias("source")).agg(F.count("*").alias("n"))
    return one, by
