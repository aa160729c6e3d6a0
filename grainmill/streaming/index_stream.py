"""Keep a vector table up to date from a stream of corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import VectorTable


def corpus_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def index_stream(corpus: DataFrame, table: VectorTable, embed, config: dict, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Add each micro-batch to the table. A batch that is replayed after a failure finds its ids there and adds nothing."""
    writer = corpus.writeStream.foreachBatch(lambda batch, _: table.build(batch, embed, config)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
