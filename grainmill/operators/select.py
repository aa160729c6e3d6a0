"""Deduplication, caps, seeded selection, splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_hash


def first_per_key(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The row with the smallest `order` for each key (order must be unique).

    An aggregation finds the smallest order, with map-side combine, and a semi-join takes the rows: unlike a window, no task
    sorts all copies of a frequent key.
    """
    first = df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(order).alias("_first"))
    return df.join(first.select(F.col("_first").alias(order)), order, "left_semi").select(*df.columns)


def cap_per_key(df: DataFrame, keys: list[Column], most: int, order: list[Column]) -> DataFrame:
    """At most `most` rows for each key, the first by order. row_number() <= n is planned with a group limit below the shuffle,
    so a frequent key sends no more than `most` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def _limits(df: DataFrame, group: str, id_col: str, seed: int, quota: DataFrame) -> DataFrame:
    """(_g, _cut, _last) for quotas (_g, _quota): the first _quota rows of a group by seeded hash are those whose hash prefix is
    below _cut, and of those at _cut the ones up to _last.

    Cuts come from counts of hash prefixes (65,536 for each group), so only the one bucket that each falls into is ranked.
    """
    h = seeded_hash(id_col, seed)
    counts = df.groupBy(F.col(group).alias("_cg"), F.substring(h, 1, 4).alias("_b")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("_cg").orderBy("_b"))).withColumn("all", F.sum("c").over(Window.partitionBy("_cg")))
    at = upto.join(quota, F.col("_cg").eqNullSafe(F.col("_g")))
    cut = at.groupBy("_g").agg(F.min(F.when(F.col("upto") >= F.col("_quota"), F.struct("_b", (F.col("_quota") - F.col("upto") + F.col("c")).alias("rank")))).alias("x"), F.first("_quota").alias("_quota"))
    cut = cut.select("_g", F.when(F.col("_quota") <= 0, F.lit("")).otherwise(F.coalesce("x._b", F.lit("~"))).alias("_cut"), F.col("x.rank").alias("_rank"))
    edge = _beside(df.select(F.col(group).alias("_eg"), F.col(id_col).alias("_id"), h.alias("_h")), "_eg", cut).where(F.substring("_h", 1, 4) == F.col("_cut"))
    ranked = edge.withColumn("_n", F.row_number().over(Window.partitionBy("_eg").orderBy("_h", "_id"))).where(F.col("_n") == F.col("_rank"))
    last = ranked.select(F.col("_eg"), F.struct("_h", "_id").alias("_last"))
    return cut.join(last, F.col("_g").eqNullSafe(F.col("_eg")), "left").select("_g", "_cut", "_last")


#: Groups whose numbers are broadcast; more are joined.
FEW_GROUPS = 10_000


def _beside(df: DataFrame, group: str, numbers: DataFrame) -> DataFrame:
    """df with the columns of its group's row in numbers (_g, ...). The size is checked before it is broadcast."""
    few = numbers.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return df.join(F.broadcast(numbers) if few else numbers, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _inside(id_col: str, seed: int) -> Column:
    h = seeded_hash(id_col, seed)
    at = F.struct(h.alias("_h"), F.col(id_col).alias("_id"))
    return F.when(F.substring(h, 1, 4) < F.col("_cut"), True).otherwise(F.coalesce((F.substring(h, 1, 4) == F.col("_cut")) & (at <= F.col("_last")), F.lit(False)))


def round_robin(df: DataFrame, group: str, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows dealt over the groups in turn: each gives its first row by seeded hash, then its second, and so on; ties by group.

    Only the quota of each group is computed centrally (one number for each group); its rows are found by hash prefix, and only
    the n selected ones are numbered.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("c"))
    # With rounds 1, 2, ... a group of c rows takes part in the first c rounds; quotas follow from the sizes alone.
    ranked = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("c", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("left", F.count("*").over(Window.orderBy("c", group).rowsBetween(0, Window.unboundedFollowing)))
    full = ranked.withColumn("all", F.col("before") + F.col("left") * F.col("c") <= n)
    rest = full.withColumn("open", F.sum(F.when(~F.col("all"), 1).otherwise(0)).over(Window.partitionBy())).withColumn("taken", F.sum(F.when(F.col("all"), F.col("c")).otherwise(0)).over(Window.partitionBy()))
    level = F.floor((F.lit(n) - F.col("taken")) / F.greatest(F.col("open"), F.lit(1)))
    extra = F.row_number().over(Window.partitionBy("all").orderBy(group)) <= (F.lit(n) - F.col("taken")) - level * F.col("open")
    quota = rest.select(F.col(group).alias("_g"), F.when(F.col("all"), F.col("c")).otherwise(F.least(F.col("c"), level + extra.cast("long"))).alias("_quota"))
    picked = _beside(df, group, _limits(df, group, id_col, seed, quota)).where(_inside(id_col, seed)).drop("_cut", "_last")
    w = Window.partitionBy(group).orderBy(seeded_hash(id_col, seed), F.col(id_col))
    return picked.withColumn("round", F.row_number().over(w))


def largest_remainder(df: DataFrame, group: str, part: int) -> DataFrame:
    """(group, total, quota): `part` rows shared out in proportion to the groups' sizes, leftovers to the largest remainders, ties by group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("total"))
    every = Window.partitionBy()
    exact = F.col("total") * F.lit(part) / F.sum("total").over(every)
    s = sizes.withColumn("floor", F.floor(F.col("total") * F.lit(part) / F.sum("total").over(every))).withColumn("rest", F.round(exact - F.col("floor"), 9))
    left = F.lit(part) - F.sum("floor").over(every)
    n = F.row_number().over(Window.orderBy(F.desc("rest"), F.asc(group)))
    return s.withColumn("left", left).withColumn("n", n).select(group, "total", (F.col("floor") + (F.col("n") <= F.col("left")).cast("long")).alias("quota"))


def stratified_split(df: DataFrame, group: str, id_col: str, part: int, seed: int, names: tuple[str, str] = ("rest", "part")) -> DataFrame:
    """df with a column split: of each group its quota by largest remainder, in seeded order, is names[1], the others names[0]."""
    quota = largest_remainder(df, group, part).select(F.col(group).alias("_g"), F.col("quota").alias("_quota"))
    made = _beside(df, group, _limits(df, group, id_col, seed, quota))
    return made.withColumn("split", F.when(_inside(id_col, seed), names[1]).otherwise(names[0])).drop("_cut", "_last")


def seeded_split(df: DataFrame, id_col: str, ratio: float, seed: int, names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """df with a column split by a plain seeded order: exactly floor(rows * ratio) rows are names[1].

    The cut is found from counts of hash prefixes (65,536 buckets), so only the one bucket that it falls into is ranked.
    """
    h = seeded_hash(id_col, seed)
    bucket = F.substring(h, 1, 4)
    counts = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("b")))
    want = F.floor(F.lit(ratio) * F.sum("c").over(Window.partitionBy()))
    cut = run.withColumn("want", want).where((F.col("upto") - F.col("c") < F.col("want")) & (F.col("upto") >= F.col("want"))).select(F.col("b").alias("_b"), (F.col("want") - F.col("upto") + F.col("c")).alias("_rank"))
    edge = df.select(F.col(id_col).alias("_id"), h.alias("_h"), bucket.alias("_x")).join(cut, F.col("_x") == F.col("_b"))
    edge = edge.withColumn("_n", F.row_number().over(Window.orderBy("_h", "_id"))).where(F.col("_n") == F.col("_rank")).select(F.struct("_h", "_id").alias("_last"))
    last = F.broadcast(edge)  # one row
    made = df.withColumn("_key", F.struct(h.alias("_h"), F.col(id_col).alias("_id"))).join(last, F.lit(True), "left")
    return made.withColumn("split", F.when(F.col("_key") <= F.col("_last"), names[1]).otherwise(names[0])).drop("_key", "_last")


def batched(df: DataFrame, position: str, size: int) -> DataFrame:
    """df with the number of its batch of `size` consecutive positions."""
    if size < 1:
        raise ValueError("Batch size must be positive")
    return df.withColumn("batch", F.floor(F.col(position) / size))
