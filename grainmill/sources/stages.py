"""A store of stage results for resumable runs: Parquet by stage, bound to one configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import contiguous_prefix
from ..operators.validate import ValidationError
from .files import config_fingerprint, read_json, write_json

ITEMS = "position long, value string"


class StageStore:
    """(position, value) rows of each stage. A batch is written aside and moved into place by one rename, so a lost job leaves
    nothing half-done; what is saved of a stage is always a prefix 0 to n - 1."""

    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path = spark, path.rstrip("/")
        own = config_fingerprint(config)
        if self._fs().exists(self._at("run")):
            if read_json(spark, f"{self.path}/run").get("fingerprint") != own:
                raise ValidationError("the saved run has another configuration")
        else:
            write_json(spark, {"fingerprint": own}, f"{self.path}/run")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def read(self, stage: str) -> DataFrame:
        """What is saved of a stage; raises unless it is a contiguous prefix."""
        fs, at = self._fs(), self._at(f"items/stage={stage}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], ITEMS)
        rows = self.spark.read.schema(ITEMS).parquet(*(s.getPath().toString() for s in fs.listStatus(at)))
        state = contiguous_prefix(rows.withColumn("stage", F.lit(stage)), "stage", "position").first()
        if state and not state["contiguous"]:
            raise ValidationError(f"{stage} is not a contiguous prefix")
        return rows

    def append(self, stage: str, rows: DataFrame) -> None:
        aside, name = self._at(f"tmp/{uuid.uuid4().hex}"), f"items/stage={stage}/batch-{uuid.uuid4().hex}"
        rows.select(F.col("position").cast("long"), F.col("value").cast("string")).write.parquet(aside.toString())
        fs = self._fs()
        fs.mkdirs(self._at(f"items/stage={stage}"))
        if not fs.rename(aside, self._at(name)):
            raise OSError(f"could not move {aside.toString()}")

    def finish(self) -> None:
        self._fs().delete(self._at(""), True)
