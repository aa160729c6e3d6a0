"""Validation rules: each gives (row key, rule) violations; a strict form raises on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank


class ValidationError(ValueError):
    pass


def violations(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, rule) for every rule that a row breaks; rules are conditions that hold for bad rows."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def require_none(found: DataFrame) -> None:
    """Raise ValidationError on the first violation by key and rule."""
    first = found.orderBy(*found.columns).first()
    if first:
        raise ValidationError(f"{first[found.columns[1]]}: row {first[found.columns[0]]}")


def require_count(df: DataFrame, expected: int) -> None:
    n = df.count()
    if n != expected:
        raise ValidationError(f"Expected {expected} rows, found {n}")


def conversation_rules(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, rule) for conversations in long form: roles in the domain, a system turn only first, user and assistant in turns
    from user on, no blank content, an assistant at the end, and turn numbers without gaps or repeats."""
    w = Window.partitionBy(conv).orderBy(turn)
    before = F.lag(role).over(w)
    after_system = F.when(before == "system", F.lit(None)).otherwise(before)
    t = df.select(
        conv,
        (~F.col(role).isin("system", "user", "assistant")).alias("bad_role"),
        ((F.col(role) == "system") & before.isNotNull()).alias("late_system"),
        ((F.col(role) != "system") & F.when(after_system.isNull(), F.col(role) != "user").otherwise(F.col(role) == after_system)).alias("no_turns"),
        is_blank(text).alias("blank"),
        F.struct(turn, role).alias("at"),
    )
    g = t.groupBy(conv).agg(*(F.max(F.coalesce(c, F.lit(True))).alias(c) for c in ("bad_role", "late_system", "no_turns", "blank")), (F.max("at")[role] != "assistant").alias("open_end"), (F.count_distinct(f"at.{turn}") != F.max(f"at.{turn}") - F.min(f"at.{turn}") + 1).alias("gap"), (F.count("*") != F.count_distinct(f"at.{turn}")).alias("repeat"))
    return violations(g, conv, [("role_domain", F.col("bad_role")), ("system_not_first", F.col("late_system")), ("roles_do_not_alternate", F.col("no_turns")), ("blank_content", F.col("blank")), ("no_final_assistant", F.col("open_end")), ("turn_gap", F.col("gap") | F.col("repeat"))])


def chat_rules(df: DataFrame, key: str, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """(key, rule) for training rows in nested form: prompt and completion are arrays of (role, content)."""
    p, c = F.coalesce(F.col(prompt), F.array().cast("array<struct<role:string,content:string>>")), F.coalesce(F.col(completion), F.array().cast("array<struct<role:string,content:string>>"))
    all_ = F.concat(p, c)
    body = F.filter(all_, lambda m, i: ~((i == 0) & (m["role"] == "system")))
    turns = F.transform(body, lambda m, i: F.coalesce(m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(True)))
    return violations(
        df,
        key,
        [
            ("empty_prompt", F.size(p) == 0),
            ("one_completion", F.size(c) != 1),
            ("role_domain", F.exists(all_, lambda m: F.coalesce(~m["role"].isin("system", "user", "assistant"), F.lit(True)))),
            ("blank_content", F.exists(all_, lambda m: is_blank(m["content"]))),
            ("roles_do_not_alternate", F.exists(turns, lambda x: x)),
            ("no_final_assistant", F.coalesce(F.try_element_at(all_, F.lit(-1))["role"] != "assistant", F.lit(True))),
        ],
    )


def chat_batch_rules(df: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """(key, rule) for prompts to a model: not empty, known roles, no blank content."""
    m = F.col(messages)
    return violations(df, key, [("empty", F.coalesce(F.size(m), F.lit(0)) <= 0), ("role_domain", F.exists(m, lambda x: ~x["role"].isin("system", "user", "assistant"))), ("blank_content", F.exists(m, lambda x: is_blank(x["content"])))])


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def question_rules(df: DataFrame, answerable: bool = True) -> DataFrame:
    """(id, rule) for benchmark questions: id, question, answer and, where answerable is False, split and an answerable flag.

    Ids are counted by aggregation and joined back, so a repeated id needs no window over its rows.
    """
    many = repeated(df.where(F.col("id").isNotNull()), "id").select(F.col("id").alias("_id"))
    marked = df.join(many, F.col("id") == F.col("_id"), "left")
    rules = [("blank_id", is_blank("id")), ("repeated_id", F.col("_id").isNotNull()), ("blank_question", is_blank("question"))]
    if answerable:
        rules += [("blank_answer", is_blank("answer"))]
    else:
        rules += [
            ("split_domain", F.coalesce(~F.col("split").isin("train", "dev"), F.lit(True))),
            ("no_flag", F.col("answerable").isNull()),
            ("answer_missing", F.col("answerable") & is_blank("answer")),
            ("answer_not_null", ~F.col("answerable") & F.col("answer").isNotNull()),
        ]
    return violations(marked, "id", rules)


def over_length(df: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """One row: rows, the longest length and how many are over the limit."""
    counted = df.select(tokens.alias("tokens"))  # else the engine counts the tokens for each measure
    return counted.agg(F.count("*").alias("n"), F.max("tokens").alias("longest"), F.count_if(F.col("tokens") > limit).alias("over"))


def unique_keys(df: DataFrame, key: Column, name: str) -> None:
    """Raise if a key occurs twice: as many distinct keys as rows."""
    n, distinct = df.agg(F.count("*"), F.count_distinct(key)).first()
    if n != distinct:
        raise ValidationError(f"{name} repeats {n - distinct} prompts")


def no_overlap(left: DataFrame, right: DataFrame, key: Column, names: tuple[str, str]) -> None:
    """Raise, with their number, if the two sides share keys."""
    from .audit import shared_keys

    n = shared_keys(left, right, key).count()
    if n:
        raise ValidationError(f"{names[0]} and {names[1]} share {n} prompts")


def template_rules(df: DataFrame, key: str, messages: str, rendered: str, foreign: str = "[INST]", rows: int = 3) -> DataFrame:
    """(key, rule) for the first `rows` rows by key: a chat template must keep every content and hold no sign of another one."""
    first = df.orderBy(key).limit(rows)
    return violations(first, key, [("content_dropped", F.exists(messages, lambda m: ~F.contains(F.col(rendered), m["content"]))), ("foreign_template", F.contains(F.col(rendered), F.lit(foreign)))])


def provenance_gate(manifest: dict, digests: dict[str, str], paths: dict[str, str] | None = None) -> None:
    """Raise unless the manifest's audit passed, its digests equal those given, no two files are the same (by content, and by
    path where paths are given) and no split overlaps."""
    if paths and len(set(paths.values())) < len(paths):
        raise ValidationError("The benchmark is a file to train or validate on")
    if manifest.get("audit", {}).get("passed") is not True:
        raise ValidationError("The audit did not pass")
    for name, digest in digests.items():
        if manifest.get(f"{name}_sha256") != digest:
            raise ValidationError(f"{name} is not the file that was audited")
    if len(set(digests.values())) < len(digests):
        raise ValidationError("Two splits are the same file")
    for pair, counts in manifest.get("split_overlap_checks", {}).items():
        if any(counts.values()):
            raise ValidationError(f"{pair} overlap")
