"""JSON-lines and JSON files, and digests of files and tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank

CORPUS = "id string, source string, title string, question string, context_text string, retrieval_text string, metadata map<string,string>"
MESSAGES = "array<struct<role:string,content:string>>"
TRAINING = f"prompt {MESSAGES}, completion {MESSAGES}"
BENCHMARK = "id string, question string, reference_answer string, metadata map<string,string>"
ANSWERABLE = "id string, question string, answer string, metadata struct<answerable:boolean,original_split:string>"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped, a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_checked(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): rejects has the lines that are no JSON object or do not fit the schema, with the reason."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    lines = spark.read.text(path).where(~is_blank("value"))
    parsed = lines.withColumn("v", F.try_parse_json("value")).withColumn("row", F.from_json("value", kind))
    object_ = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    known = F.array(*(F.lit(f.name) for f in kind.fields))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    extra = F.size(F.array_except(keys, known)) > 0
    missing = F.size(F.array_except(known, keys)) > 0
    reason = F.when(F.col("v").isNull(), "not JSON").when(~object_, "not an object").when(extra, "unknown key").when(missing, "missing key").when(F.col("row").isNull(), "wrong type")
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select("row.*"), marked.where("reason is not null").select("value", "reason")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Overwrite path with df as JSON lines, nulls kept, in one pass that also counts; returns the rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON document, read through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).take(1)
    if not rows:
        raise FileNotFoundError(path)
    return json.loads(rows[0][0])


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One pretty-printed document in the folder path, through Spark's file systems; the old one is replaced."""
    text = json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read. A file must fit a row (2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def config_fingerprint(config: dict) -> str:
    """sha-256 of a configuration as JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
