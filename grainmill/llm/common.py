"""Helpers that the operators of this package share: the shared scratch folder, staged tables, components, words."""

from __future__ import annotations

import functools
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters; bytes.split() splits at exactly these.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="grainmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark deletes the shuffle files of a query at its end where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, in folders by a column if given, and read it back: lineage ends there
    and lost executors cost nothing before it. The shuffle files behind it, which nothing reads again, are deleted."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/grainmill-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


class Buckets:
    """A Parquet table in the shared folder whose rows are dealt to buckets by columns, each file sorted by them: groupings and
    joins by them need no other shuffle.

    Each add() appends; read() has all rows so far. The engine's catalog knows the table until close(); what was read before
    stays readable, and so do the files.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, *cols: str):
        self.spark, self.n, self.cols = spark, buckets, cols
        self.path, self.table = f"{scratch_dir(spark)}/grainmill-{name}-{uuid.uuid4().hex}", f"grainmill_{uuid.uuid4().hex}"

    def add(self, df: DataFrame, dealt: bool = False) -> Buckets:
        """dealt: the rows of df lie in such buckets already, as those made from such tables alone do."""
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            rows = df if dealt else df.repartition(self.n, *self.cols)
            rows.write.format("parquet").mode("append").option("compression", "zstd").option("path", self.path).bucketBy(self.n, *self.cols).sortBy(*self.cols).saveAsTable(self.table)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self, files: bool = False) -> None:
        """Take the table out of the catalog, and delete its files where nothing reads them any more."""
        if files:
            out = self.read()
            out._staged_path = self.path
            dropped(out)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._staged_path
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Shared:
    """A broadcast value whose classes workers need not have installed; get() unpacks it in a task."""

    def __init__(self, spark: SparkSession, value):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self.packed.value)


def beside(docs: DataFrame, keep: list[str], text_col: str, new: str) -> tuple[DataFrame, list[str], bool]:
    """docs as a struct src of the columns in keep (but for `new`, which gives way to the column to be made), and the text
    beside it unless src has it; then those columns, and whether src has it."""
    cols = [c for c in keep if c != new]
    inside = text_col in cols
    src = docs.select(F.struct(*(F.col(c) for c in cols)).alias("src"), *([] if inside else [F.col(text_col).alias("text")]))
    return src, cols, inside


def ascii_lower(c) -> F.Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(c, n: int) -> F.Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % n


def collected(spark: SparkSession) -> None:
    """A garbage collection on the driver: what finished rounds have broadcast is released there and on executors only then, and
    a driver of little memory fills up between two rounds."""
    spark._jvm.System.gc()


def matched(rows: DataFrame, entries: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows with the columns of their entry; entries are unique by `on`, and count says how many of the `total` rows each has.

    An entry with a thousandth of the rows or a little more meets them by broadcast (there are a thousand of those at most), so
    that no key's rows meet in one task; the others are joined by merge. Rows without an entry go, as do the columns count.
    """
    more = [c for c in entries.columns if c not in on and c != count]
    # A power of two, so that plans of like inputs have the same code and the driver compiles it once.
    often = F.col(count) * 1000 >= 1 << max(total - 1, 0).bit_length()
    hot = entries.where(often).select(*(F.col(c).alias(f"_{c}") for c in on), F.struct(*more, F.lit(1).alias("_")).alias("_hot"))
    met = functools.reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in on))
    some = rows.join(F.broadcast(hot), met, "left").drop(*(f"_{c}" for c in on))
    rest = some.where("_hot is null").drop("_hot").join(entries.where(~often).select(*on, *more).hint("merge"), on).select(*rows.columns, *more)
    return some.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in more)).unionByName(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): a staged row (node, component) for each node, component the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a hash aggregation over edges with map-side
    combine; the number of rounds grows with the logarithm of the nodes. A node with very many neighbours is never gathered:
    its minimum is aggregated, then met by matched().
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        joined = matched(both, least, ["a"], "n", 2 * n)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = mark(now)
    for _ in range(rounds):
        # A star reads its edges in several places: one plan of both would hold the large star once for each of them.
        large = staged(star(now, True, seen[0]), "edges")
        after = staged(star(large, False, seen[0]), "edges")
        dropped(now, large)
        collected(now.sparkSession)
        now, before = after, seen
        seen = mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = staged(nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    dropped(now)
    return out
