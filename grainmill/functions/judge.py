"""Parsing of what a judging model has written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, trim_ws

# Fixed value: an answer cut off inside its reason, from which the score can still be read.
PARTIAL = r'\A\s*\{\s*"score"\s*:\s*([0-4])\s*,\s*"reason"\s*:\s*"'
# Fixed value: the reason that stands for one that was cut off.
RECOVERED = "Judge explanation incomplete; score recovered from matching initial and retry outputs."


def parse_judge(output) -> Column:
    """struct(score int, reason string) of the first JSON object with an integer score 0 to 4 and a string reason; else null.

    The whole output is tried first, then each stretch from { to the next }. Types are strict: 3.0, "3" and true are no score.
    """
    x = F.coalesce(_c(output), F.lit(""))
    candidates = F.concat(F.array(x), F.regexp_extract_all(x, F.lit(r"(?s)\{.*?\}"), F.lit(0)))

    def read(c: Column) -> Column:
        v = F.try_parse_json(c)
        score, reason = F.try_variant_get(v, "$.score", "variant"), F.try_variant_get(v, "$.reason", "variant")
        n = F.try_variant_get(v, "$.score", "int")
        ok = (F.schema_of_variant(score) == "BIGINT") & (F.schema_of_variant(reason) == "STRING") & n.between(0, 4)
        return F.when(ok, F.struct(n.alias("score"), trim_ws(F.try_variant_get(v, "$.reason", "string")).alias("reason")))

    return F.try_element_at(F.filter(F.transform(candidates, read), lambda r: r.isNotNull()), F.lit(1))


def judge_or_recover(first, retry) -> Column:
    """struct(score, reason, recovered, retried): the first output's decision, else the retry's, else a score that the cut-off
    starts of both agree on; null where none can be had."""
    a, b = parse_judge(first), parse_judge(retry)
    made = lambda r, recovered, retried: F.struct(r["score"].alias("score"), r["reason"].alias("reason"), F.lit(recovered).alias("recovered"), F.lit(retried).alias("retried"))
    pa, pb = (F.nullif(F.regexp_extract(F.coalesce(_c(x), F.lit("")), PARTIAL, 1), F.lit("")) for x in (first, retry))
    partial = F.struct(pa.cast("int").alias("score"), F.lit(RECOVERED).alias("reason"))
    return F.when(a.isNotNull(), made(a, False, False)).when(b.isNotNull(), made(b, False, True)).when(pa == pb, made(partial, True, True))
