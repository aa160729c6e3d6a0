"""Leakage audits, set comparisons and corpus profiles."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_digest


def shared_keys(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """The distinct keys that both sides hold."""
    return left.select(key.alias("key")).intersect(right.select(key.alias("key")))


def pairwise_overlap(df: DataFrame, split: str, key: Column) -> DataFrame:
    """(a, b, shared): for each pair of splits the number of distinct keys in both, zero included.

    Each key carries the set of its splits, so one shuffle serves all pairs.
    """
    names = df.select(F.col(split).alias("s")).where("s is not null").distinct()
    pairs = names.select(F.col("s").alias("a")).join(names.select(F.col("s").alias("b")), F.col("a") < F.col("b"))
    held = df.select(key.alias("key"), F.col(split).alias("s")).distinct().groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("splits")).where(F.size("splits") > 1)
    hits = held.select(F.explode("splits").alias("a"), "splits").select("a", F.explode("splits").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(hits, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("shared"))


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many ids only the left side has, only the right side, and whether the sets are equal. One full outer join of distinct ids."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    out = both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def exact_overlap(corpus: DataFrame, held_out: DataFrame, text: str = "text") -> DataFrame:
    """Rows of the corpus whose text key is that of a held-out text."""
    keys = held_out.select(key_digest(text).alias("_key")).distinct()
    return corpus.withColumn("_key", key_digest(text)).join(keys, "_key", "left_semi").select(*corpus.columns)


def length_profile(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Rows by group and measure: n, min, median, mean, p95 (discrete) and max."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), c.cast("long").alias("v")) for n, c in measures.items()))).alias("m")).select(*by, "m.measure", "m.v")
    return long.groupBy(*by, "measure").agg(
        F.count("v").alias("n"),
        F.min("v").alias("min"),
        F.median("v").alias("median"),
        F.round(F.avg("v"), 6).alias("mean"),
        F.expr("percentile_disc(0.95) within group (order by v)").cast("long").alias("p95"),
        F.max("v").alias("max"),
    )


def top_values(df: DataFrame, value: Column, n: int = 15) -> DataFrame:
    """The n most frequent values with their counts, ties by value."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(n)


def term_occurrences(df: DataFrame, text: str, terms: dict[str, str]) -> DataFrame:
    """For each term (name to pattern): rows that contain it and occurrences in all. One pass for all terms."""
    counted = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("term"), F.regexp_count(text, F.lit(p)).alias("k")) for n, p in terms.items()))).alias("x"))
    return counted.groupBy("x.term").agg(F.count_if(F.col("x.k") > 0).alias("rows_with"), F.coalesce(F.sum("x.k"), F.lit(0)).cast("long").alias("occurrences"))


def role_sequences(df: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """(roles, n): how many conversations have each sequence of roles."""
    turns = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, role))).alias("t"))
    return turns.groupBy(F.array_join(F.transform("t", lambda t: t[role]), "/").alias("roles")).agg(F.count("*").alias("n"))


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    return functools.reduce(lambda rest, r: F.when(r[1], F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(otherwise))


def funnel(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): rows by the first rule that removes them; 'kept' for those that none does."""
    return df.groupBy(first_match(rules, "kept").alias("reason")).agg(F.count("*").alias("n"))


def contiguous_prefix(df: DataFrame, stage: str, position: str) -> DataFrame:
    """By stage: saved rows, and whether their positions are exactly 0 to n - 1."""
    out = df.groupBy(stage).agg(F.count("*").alias("saved"), F.min(position).alias("lo"), F.max(position).alias("hi"), F.count_distinct(position).alias("distinct"))
    return out.select(stage, "saved", ((F.col("lo") == 0) & (F.col("hi") == F.col("saved") - 1) & (F.col("distinct") == F.col("saved"))).alias("contiguous"))


def table_fingerprint(df: DataFrame, cols: list[str]) -> Column:
    """sha-256 over the sha-256 of each row in order of the first column. For tables with few rows: manifests, benchmarks."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols)), 256)
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(cols[0]).alias("k"), row.alias("h")))), lambda x: x["h"]), ""), 256)


def content_sums(cols: list[str]) -> list[Column]:
    """Aggregates that add up over parts of a table: rows, and two sums of 64-bit row hashes."""
    h = lambda seed: F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.sum(h(1)).cast("string").alias("d1"), F.sum(h(2)).cast("string").alias("d2")]


def sums_digest(rows: int, d1: str | int, d2: str | int) -> str:
    return hashlib.sha256(f"{rows}:{d1}:{d2}".encode()).hexdigest()


def content_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row for a table of any size: rows, and an order-free digest, by partial aggregation."""
    return df.agg(*content_sums(cols)).select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "d1", "d2"), 256).alias("digest"))


def contained(docs: DataFrame, items: DataFrame, text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """(doc columns but the text, item columns but t): documents that hold an item's text t to the letter.

    Items are a stated set, compared with all documents in blocks of block_chars characters, which are broadcast; a pass over the
    documents for each block.
    """
    keep = [c for c in docs.columns if c != text] + [c for c in items.columns if c != "t"]
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    parts = [docs.join(F.broadcast(items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)), F.contains(F.col(text), F.col("t"))).select(*keep) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts)
