"""The vector table: Parquet by source, with a manifest beside it; rows are added once, by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators.audit import content_sums, sums_digest
from .files import config_fingerprint, read_json, write_json


def unindexed(corpus: DataFrame, index: DataFrame, id_col: str = "id", content: str | None = None) -> DataFrame:
    """Rows of the corpus that the index lacks: by id alone, or (content given) also those whose content hash has changed."""
    if content is None:
        return corpus.join(index.select(id_col), id_col, "left_anti")
    have = index.select(F.col(id_col).alias("_id"), F.col("content_hash").alias("_h"))
    return corpus.join(have, (F.col(id_col) == F.col("_id")) & (F.sha2(content, 256) == F.col("_h")), "left_anti")


class VectorTable:
    """A folder with records/ (id, source, embedding, content_hash, record) by source, and manifest/."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def read(self) -> DataFrame:
        if not self._exists("records"):
            raise FileNotFoundError(f"no vector table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/records")

    def sources(self) -> DataFrame:
        """(source, n): what the table holds, by source."""
        return self.read().groupBy("source").agg(F.count("*").alias("n"))

    def check(self) -> int:
        """The rows, if they are as many as the manifest says."""
        n = self.count()
        if n != self.manifest()["documents"]:
            raise ValueError(f"the table has {n} rows, its manifest {self.manifest()['documents']}")
        return n

    def count(self) -> int:
        return self.read().count()

    def lookup(self, ids: list[str]) -> DataFrame:
        return self.read().where(F.col("id").isin(*ids))

    def build(self, corpus: DataFrame, embed, config: dict, rebuild: bool = False) -> dict:
        """Embed and add the records that are not there yet; all anew with rebuild. embed: DataFrame with id and text to one with
        id and embedding. The anti-join comes before the embedder, so that known records cost no embedding. Returns the manifest."""
        new = corpus.dropDuplicates(["id"])
        fresh = rebuild or not self._exists("records")
        if not fresh:
            new = unindexed(new, self.read())
        vectors = embed(new.select("id", F.col("retrieval_text").alias("text"))).select("id", l2_normalize("embedding").cast("array<float>").alias("embedding"))
        rows = new.join(vectors, "id").select("id", "source", "embedding", F.sha2("retrieval_text", 256).alias("content_hash"), F.struct(*corpus.columns).alias("record"))
        seen = Observation()
        size = F.size("embedding")
        rows.observe(seen, *content_sums(["id", "content_hash"]), F.min(size).alias("lo"), F.max(size).alias("hi")).write.mode("overwrite" if fresh else "append").partitionBy("source").parquet(f"{self.path}/records")
        added = seen.get
        old = {} if fresh else self.manifest()
        sums = [int(added[k] or 0) + int(o) for k, o in zip(("rows", "d1", "d2"), old.get("sums", [0, 0, 0]))]
        dims = {d for d in (added["lo"], added["hi"], old.get("embedding_dimension")) if d is not None}
        if sums[0] != self.count():  # an earlier build was lost between its rows and its manifest
            whole = self.read().agg(*content_sums(["id", "content_hash"]), F.min(size).alias("lo"), F.max(size).alias("hi")).first()
            sums, dims = [int(whole[k] or 0) for k in ("rows", "d1", "d2")], {whole["lo"], whole["hi"]}
        if len(dims) > 1:
            raise ValueError("vectors of different lengths")
        digest = sums_digest(*sums)
        manifest = {"configuration": config, "documents": sums[0], "corpus_sha256": digest, "fingerprint": config_fingerprint({**config, "documents": sums[0], "corpus_sha256": digest}), "embedding_dimension": next(iter(dims), None), "sums": [str(x) for x in sums]}
        write_json(self.spark, manifest, f"{self.path}/manifest")
        return manifest

    def manifest(self) -> dict:
        return read_json(self.spark, f"{self.path}/manifest")
