"""The registered queries: each runs one operator over its whole table and derives the contract's columns from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, lm_score, minhash, oracles, packing, quality_rules, secrets, toxicity, url_filter
from .common import crc_mod

#: Where the vocabulary files of public tokenizers are installed.
TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_join(F.transform("leaks", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["end"].cast("string"), x["edits"].cast("string"))), ",")
    return out.select("doc_id", F.size("leaks").cast("long").alias("n_items"), (F.size("leaks") > 0).alias("contaminated"), items.alias("leaks"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = secrets.span_text(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts made from all conversations, parsed by a model learnt from those whose crc32(conv_id as text) mod 5 is not 0."""
    raw = chat_format.transcripts_of(table(spark, sf_dir, "conversations"))
    model = chat_format.train_parser(raw.where(crc_mod("conv_id", 5) != 0))
    raw = raw.withColumn("roles", F.array_join(F.transform("turns", lambda t: t["role"]), "/"))
    out = chat_format.parse_transcripts(raw, model, ["conv_id", "part", "roles"], parts_of=("conv_id", "part"))
    found = F.array_join(F.transform("turns", lambda t: t["role"]), "/")
    return out.select("conv_id", "part", (crc_mod("conv_id", 5) == 0).alias("held_out"), F.size("turns").cast("long").alias("n_turns"), found.alias("found_roles"), (found == F.col("roles")).alias("right"), F.sha2("rendered", 256).alias("rendered_sha256"), "continues")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_minhash_near_dedup, op4_url_filter, op5_toxicity, op6_benchmark_decontamination, op7_secret_scan, op8_lm_score, op9_chat_format, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
