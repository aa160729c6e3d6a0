"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Buckets, ascii_lower, dropped, matched, staged

#: What tells lines apart: 128 bits of hash.
KEY = ("h1", "h2")


def line_key(line) -> F.Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line whose key has min_chars code points or more: doc, row (hash of the text), pos, and 128 bits of key hash.

    Rows without an id take no part: they own no line and lose none.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), line_key)
    found = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.posexplode(lines).alias("pos", "key"))
    return found.where(F.length("key") >= min_chars).select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


class LineRuns:
    """A log-structured store of line hashes: sorted runs (h1, h2, docs, top), by level, that share no line.

    docs counts the documents of the batch that brought the line and top is the largest id among them. A batch is
    merge-anti-joined with every run; its fresh lines become one run at level 0. When a level has `fanout` runs, they are
    merged into one run of the next level, so every line is rewritten once per level. A run is a table in `buckets` buckets by
    hash, sorted, and all runs share the buckets: joins read them without an exchange, and a merge of runs is a full outer
    sort-merge join, bucket by bucket. Lines that came again are kept apart in `again`, a row per line and batch.

    Batches hold distinct documents; a document's rows belong in one batch.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.again: Buckets | None = None

    def _table(self, name: str) -> Buckets:
        return Buckets(self.spark, name, self.buckets, *KEY)

    def runs(self) -> list[DataFrame]:
        return [r.read() for level in self.levels for r in level]

    def fresh(self, lines: DataFrame) -> DataFrame:
        """Lines of a batch that no run has: a merge-anti-join against each run in turn."""
        for r in self.runs():
            lines = lines.join(r.select(*KEY).hint("merge"), list(KEY), "left_anti")
        return lines

    def _merged(self, a: Buckets, b: Buckets) -> Buckets:
        """Two sorted runs without common lines as one; they are deleted."""
        same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
        both = a.read().alias("a").join(b.read().alias("b").hint("merge"), same, "full").select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*KEY, "docs", "top")))
        out = self._table("run").add(both, dealt=True)
        a.close(files=True)
        b.close(files=True)
        return out

    def add(self, lines: DataFrame) -> None:
        """Add the fresh lines of a batch of hashed lines as a run of its own, count the others as come again; compact full levels."""
        batch = self._table("batch").add(lines.select(*KEY, "doc").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("top")))
        own = batch.read()
        run = self._table("run").add(self.fresh(own), dealt=True)
        if self.runs():
            self.again = self.again or self._table("again")
            self.again.add(own.join(run.read().select(*KEY).hint("merge"), list(KEY), "left_anti"), dealt=True)
        batch.close(files=True)
        self.levels[0].append(run)
        at = 0
        while len(self.levels[at]) >= self.fanout:
            full, self.levels[at] = self.levels[at], []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(functools.reduce(self._merged, full))
            at += 1

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, docs, top) of lines in min_docs documents or more, staged: the second pass, over the lines that came again
        (summed over batches, then looked up in each run) and those that one batch alone brought often enough."""
        out = []
        for run in self.runs():
            if self.again:
                several = self.again.read().groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
                same = (F.col("r.h1") == F.col("m.h1")) & (F.col("r.h2") == F.col("m.h2"))
                docs = F.col("r.docs") + F.coalesce("m.docs", F.lit(0))
                run = run.alias("r").join(several.alias("m").hint("merge"), same, "left").select("r.h1", "r.h2", docs.alias("docs"), F.greatest("r.top", "m.top").alias("top"))
            out.append(run.where(F.col("docs") >= min_docs))
        whole = functools.reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "h1 long, h2 long, docs long, top long")
        return staged(whole, "repeated")

    def close(self) -> None:
        """Delete the store."""
        for r in [*([self.again] if self.again else []), *(r for level in self.levels for r in level)]:
            r.close(files=True)


def dedup_new(batch: DataFrame, store: LineRuns, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The incremental form: drop from each text the lines that earlier batches hold, then add the batch's own lines to the store.

    Null and empty texts are one empty line; rows without an id lose nothing; repeated rows are treated alike; an empty batch
    gives an empty result and adds an empty run.
    """
    lines = staged(hashed_lines(batch, min_chars, id_col, text_col), "lines")
    gone = staged(lines.join(store.fresh(lines), ["doc", "row", "pos"], "left_anti"), "gone")
    store.add(lines)
    dropped(lines)
    return _without(batch, gone, id_col, text_col)


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with three columns more: line_count, lines_dropped and kept_text (the text without the lines at (doc, row, pos) in gone)."""
    at = gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone_"))
    src = docs.select(F.struct(*docs.columns).alias("src"))
    src = src.withColumn("id", F.col("src")[id_col]).withColumn("hash", F.xxhash64(F.col("src")[text_col]))
    made = src.join(at, (F.col("id") == F.col("doc")) & (F.col("hash") == F.col("row")), "left")
    text = F.coalesce(F.col("src")[text_col], F.lit(""))
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone_")
    kept = F.when(F.col("gone_").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.try_element_at(lines, i + 1)), "\n"))
    new = {"line_count": F.size(lines).cast("long"), "lines_dropped": F.coalesce(F.size("gone_"), F.lit(0)).cast("long"), "kept_text": kept}
    made = made.select("src", *(c.alias(n) for n, c in new.items()))  # before the columns of docs come out, whose names may be any
    return made.select(*(F.col("src")[c].alias(c) for c in docs.columns if c not in new), *new)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of min_chars code points or more that min_docs documents or more hold stay only in the largest id that holds them.

    The documents enter a LineRuns store in `batches` batches by hash of the id; each batch is merge-anti-joined with the runs
    and adds its fresh lines. A second pass finds the lines in min_docs documents or more and drops theirs. Returns docs with
    line_count, lines_dropped and kept_text. Keys are compared by 128 bits of hash.

    Null or empty text is one empty line. Repeated rows with the same id are one document: each such row is treated alike. Rows
    without an id own nothing and keep all lines. An empty table gives an empty result. Other columns of docs pass
    through; one named like a new column gives way to it.
    """
    lines = hashed_lines(docs, min_chars, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    lines = staged(lines, "lines", by="batch")
    store = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        store.add(lines.where(F.col("batch") == b))
    again = store.repeated(min_docs)
    store.close()
    held = matched(lines.select("doc", "row", "pos", *KEY), again, list(KEY), "docs", lines.count()).where(F.col("doc") < F.col("top")).select("doc", "row", "pos").distinct()
    gone = staged(held, "gone")
    dropped(lines, again)
    return _without(docs, gone, id_col, text_col)
