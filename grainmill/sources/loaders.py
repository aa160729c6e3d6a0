"""Loaders that check what they read, sinks that overwrite nothing, and the retrieval artifact."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.audit import content_fingerprint
from ..operators.validate import ValidationError, chat_rules, question_rules, require_count, require_none
from .files import ANSWERABLE, BENCHMARK, CORPUS, TRAINING, config_fingerprint, file_digests, read_json, read_jsonl, read_jsonl_checked, write_json, write_jsonl

SOURCES = ("stackoverflow", "techqa")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in spark.checkpoint.dir; in a temporary folder in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/grainmill-{name}-{uuid.uuid4().hex}"


def _present(spark: SparkSession, path: str, what: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")


def digest(spark: SparkSession, path: str) -> str:
    """sha-256 of a file; of a folder's files in order of their digests."""
    rows = [r["sha256"] for r in file_digests(spark, path).where(F.col("length") > 0).orderBy("sha256").collect()]
    return rows[0] if len(rows) == 1 else config_fingerprint({"files": rows})


def strict_rows(spark: SparkSession, path: str, schema: str, what: str) -> DataFrame:
    """Rows of a JSON-lines file. Missing file, empty file, or a line that is no object with exactly the schema's keys: an error,
    which names the line (by its number in a single file, else by its text)."""
    _present(spark, path, what)
    rows, rejects = read_jsonl_checked(spark, path, schema)
    bad = rejects.orderBy("value").first()
    if bad:
        n = line_number(spark, path, bad["value"])
        raise ValidationError(f"{what}, line {n}: {bad['reason']}")
    if rows.isEmpty():
        raise ValidationError(f"{what} is empty: {path}")
    return rows


def line_number(spark: SparkSession, path: str, value: str) -> int:
    """The first line, from 1, with this text; blank lines count. Only the lines before it are numbered, a partition at a time."""
    for n, row in enumerate(spark.read.text(path).toLocalIterator(), 1):
        if row["value"] == value:
            return n
    return 0


def load_training(spark: SparkSession, path: str) -> DataFrame:
    """Training rows: exact keys and valid turns, with the constant chat_template_kwargs beside them."""
    rows = strict_rows(spark, path, TRAINING, "training data")
    numbered = rows.withColumn("at", F.sha2(F.to_json(F.struct("prompt", "completion")), 256))
    require_none(chat_rules(numbered, "at"))
    return rows.withColumn("chat_template_kwargs", F.struct(F.lit(False).alias("enable_thinking")))


def _gated(spark: SparkSession, path: str, schema: str, what: str, expected_count: int | None, expected_sha256: str | None, answerable: bool) -> DataFrame:
    _present(spark, path, what)
    if expected_sha256 is not None and digest(spark, path) != expected_sha256:
        raise ValidationError(f"{what} is not the file expected")
    rows = read_jsonl(spark, path, schema)
    if expected_count is not None:
        require_count(rows, expected_count)
    if answerable:
        out = rows.select("id", "question", F.col("reference_answer").alias("answer"), F.lit("heldout").alias("split"), F.lit(True).alias("answerable"))
        require_none(question_rules(out, True))
    else:
        out = rows.select("id", "question", "answer", F.col("metadata.original_split").alias("split"), F.col("metadata.answerable").alias("answerable"))
        require_none(question_rules(out, False))
    return out


def load_general(spark: SparkSession, path: str, expected_count: int | None = 1000, expected_sha256: str | None = None) -> DataFrame:
    """Held-out questions, all answerable: (id, question, answer, split, answerable), count and digest checked."""
    return _gated(spark, path, BENCHMARK, "benchmark", expected_count, expected_sha256, True)


def load_answerable(spark: SparkSession, path: str, expected_count: int | None = 902, expected_sha256: str | None = None) -> DataFrame:
    """Questions some of which can't be answered: the same columns, count and digest checked."""
    return _gated(spark, path, ANSWERABLE, "benchmark", expected_count, expected_sha256, False)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    _present(spark, path, "corpus")
    return read_jsonl(spark, path, CORPUS)


def write_results(results: DataFrame, metrics: dict, folder: str, resumes: str | None = None) -> int:
    """Predictions as JSON lines and metrics as a JSON document in a folder; returns the rows written. A folder that is there is
    never overwritten; a run that resumes must resume in its own folder."""
    spark = results.sparkSession
    if resumes is not None and not (resumes.rstrip("/") + "/").startswith(folder.rstrip("/") + "/"):
        raise ValidationError(f"{resumes} does not belong to {folder}")
    if resumes is None and exists(spark, folder):
        raise FileExistsError(folder)
    n = write_jsonl(results, f"{folder}/predictions")
    write_json(spark, metrics, f"{folder}/metrics")
    return n


def retrieval_configuration(manifest: dict, benchmark_sha256: str, **settings) -> dict:
    """What a retrieval artifact depends on: the index, the benchmark and the settings."""
    return {"corpus_sha256": manifest["corpus_sha256"], "index_fingerprint": config_fingerprint(manifest), "benchmark_sha256": benchmark_sha256, **settings}


def write_artifact(records: DataFrame, configuration: dict, folder: str) -> dict:
    """Retrieved contexts (position, id, question, ...) as JSON lines with a manifest of configuration, rows and digest."""
    spark = records.sparkSession
    records.write.mode("errorifexists").parquet(f"{folder}/records")
    have = spark.read.parquet(f"{folder}/records")
    seen = content_fingerprint(have.select(*(F.to_json(F.struct(c)).alias(c) for c in have.columns)), have.columns).first()
    manifest = {"configuration": configuration, "rows": seen["rows"], "records_sha256": seen["digest"]}
    write_json(spark, manifest, f"{folder}/manifest")
    return manifest


def read_artifact(spark: SparkSession, folder: str, configuration: dict, examples: DataFrame) -> DataFrame:
    """The records, if they are fresh: the same configuration, digest, and the examples' (position, id, question) row for row."""
    _present(spark, f"{folder}/manifest", "retrieval artifact")
    manifest, have = read_json(spark, f"{folder}/manifest"), spark.read.parquet(f"{folder}/records")
    seen = content_fingerprint(have.select(*(F.to_json(F.struct(c)).alias(c) for c in have.columns)), have.columns).first()
    if manifest["configuration"] != configuration or manifest["records_sha256"] != seen["digest"]:
        raise ValidationError("the retrieval artifact is stale or changed")
    both = have.select("position", F.struct("id", "question").alias("a")).join(examples.select("position", F.struct("id", "question").alias("b")), "position", "full")
    if not both.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
        raise ValidationError("the retrieval artifact does not match the questions or their order")
    return have


def looked_up(examples: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """examples with the record of each; one without a record is an error."""
    lost = examples.join(records.select(key), key, "left_anti").select(key).orderBy(key).first()
    if lost:
        raise KeyError(lost[0])
    return examples.join(records, key)


def same_length(**sides: DataFrame) -> None:
    """Raise unless all sides have as many rows: what is joined by position must not lose any."""
    sizes = {name: df.count() for name, df in sides.items()}
    if len(set(sizes.values())) > 1:
        raise ValidationError(f"results of different lengths: {sizes}")


def previews(df: DataFrame, order: str, cols: list[str], n: int = 3) -> DataFrame:
    """The first n rows by order."""
    return df.orderBy(order).select(*cols).limit(n)


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """One row: the sorted keys that are wanted and not there. For keys of configurations, not of corpora."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti").agg(F.array_sort(F.collect_list(key)).alias("missing"))


def audit_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows by seeded hash of the id, numbered; the engine keeps the first n of each partition."""
    from ..functions.text import seeded_hash

    first = df.withColumn("_h", seeded_hash(id_col, seed)).orderBy("_h", id_col).limit(n)
    return first.withColumn("position", F.row_number().over(Window.orderBy("_h", id_col)) - 1).drop("_h")


def post_audit(df: DataFrame, id_col: str, prompt: str, response: str, held_out: DataFrame | None = None) -> DataFrame:
    """(check, n) over what a curation kept, all 0 if it passed: blank prompts or responses, repeated ids, repeated prompts, and
    prompts of the held-out rows."""
    from ..functions.text import key_digest

    # One row for each key, so that each text is read for its key once.
    rows = df.select(key_digest(prompt).alias("k"), F.lit(1).alias("own"), is_blank(prompt).cast("int").alias("p"), is_blank(response).cast("int").alias("r"))
    if held_out is not None:
        rows = rows.unionByName(held_out.select(key_digest(prompt).alias("k"), F.lit(0).alias("own"), F.lit(0).alias("p"), F.lit(0).alias("r")))
    keys = rows.groupBy("k").agg(F.sum("own").alias("c"), F.sum("p").alias("p"), F.sum("r").alias("r"), F.min("own").alias("held"))
    found = {"blank_prompt": F.sum("p"), "blank_response": F.sum("r"), "repeated_prompt": F.count_if(F.col("c") > 1)}
    if held_out is not None:
        found["held_out_prompt"] = F.count_if((F.col("c") > 0) & (F.col("held") == 0))
    counts = keys.agg(F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for name, n in found.items())).alias("x"))
    ids = df.groupBy(id_col).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    return counts.select(F.inline("x")).unionByName(ids.select(F.lit("repeated_id").alias("check"), "n"))
