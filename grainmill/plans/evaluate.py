"""The resumable evaluation run: answers, then judgements, then scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.judge import judge_or_recover
from ..operators.metrics import score_answers, summary
from ..operators.validate import ValidationError
from ..sources.stages import StageStore

JUDGE = "Question:\n%s\n\nReference (%s):\n%s\n\nRate this answer from 0 to 4 as JSON with score and reason:\n%s"


def _run_stage(store: StageStore, stage: str, todo: DataFrame, model, batch: int) -> DataFrame:
    """Process the positions that are not saved, `batch` of them per commit, in order."""
    saved = store.read(stage).count()
    n = todo.count()
    if saved > n:
        raise ValidationError(f"{stage} has more rows than the dataset")
    for at in range(saved, n, batch):
        store.append(stage, model(todo.where((F.col("position") >= at) & (F.col("position") < at + batch))))
    return store.read(stage)


def evaluate(examples: DataFrame, store: StageStore, generate, judge, commit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of examples with position 0 to n - 1, id, question and reference (null: unanswerable).

    Stages join by position; a stage that is complete runs no model. generate and judge: DataFrame (position, prompt) to
    (position, value).
    """
    answers = _run_stage(store, "answer", examples.select("position", F.col("question").alias("prompt")), generate, commit).withColumnRenamed("value", "answer")
    asked = examples.join(answers, "position")
    prompt = F.format_string(JUDGE, "question", F.when(F.col("reference").isNull(), "none").otherwise("given"), F.coalesce("reference", F.lit("No reference exists.")), "answer")
    first = _run_stage(store, "judge", asked.select("position", prompt.alias("prompt")), judge, commit).withColumnRenamed("value", "said")
    todo = asked.join(first, "position").select("position", prompt.alias("prompt"), judge_or_recover("said", F.lit("")).isNull().alias("bad"))

    def again(rows: DataFrame) -> DataFrame:
        return rows.select("position").join(judge(rows.where("bad").select("position", "prompt")), "position", "left")

    # Retries are a stage as well, null where none was needed, so a resumed run repeats no call.
    retry = _run_stage(store, "retry", todo, again, commit).withColumnRenamed("value", "retry")
    decided = asked.join(first, "position").join(retry, "position").withColumn("d", judge_or_recover("said", F.coalesce("retry", F.lit(""))))
    results = score_answers(decided, "answer", "reference").select("position", "id", "question", "reference", "answer", "rouge_l_f1", "abstained", F.col("d.score").alias("judge_score"), F.col("d.reason").alias("judge_reason"), F.col("d.recovered").alias("judge_recovered"), F.col("d.retried").alias("judge_retried"))
    if not results.where("judge_score is null").isEmpty():
        raise ValidationError("the judge's output can't be read")
    return results, summary(results, F.col("rouge_l_f1"), F.col("judge_score"), F.col("abstained"), F.col("judge_retried"), F.col("judge_recovered"))
