"""Secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matched, staged

# The kinds in their listed order, the pattern of each, and the least length of the part that counts.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of 32 or more: shorter runs never fit, so each match is a whole run
#: What may be a credential of an unknown kind: 20 or more characters of the usual alphabets.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Matches folded into one array at a time.
FOLD = 64
KINDS = ("assign", "access", "hex", "owned")


def _spans(text, pattern: str, kind: int, holds=None) -> F.Column:
    """Array of (start, kind, end, found) of the matches of pattern, leftmost and non-overlapping, in code points.

    The texts between matches give the places: the n-th match starts after n + 1 of those and n matches. holds: a test of
    a match; a match that fails it is dropped, its characters stay used up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    span = "array<struct<start:int,kind:int,end:int,found:string>>"
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("m")))
    # Folded block by block: an array that grows one by one would be copied as often as there are matches.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int")), lambda b: F.slice(pairs, b * FOLD + 1, F.lit(FOLD)))

    def put(acc, x):
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("found")))).alias("out"))

    def block(acc, x):
        inner = F.aggregate(x, F.struct(acc["at"].alias("at"), F.array().cast(span).alias("out")), put)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    step = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")), block, lambda acc: F.flatten(acc["out"]))
    none = F.array().cast(span)
    spans = F.when(text.rlike(pattern), step).otherwise(none)
    return F.filter(spans, holds) if holds else spans


def _live_looking(value) -> F.Column:
    """Digits and letters together, and 10 or more different characters: neither a word nor a filler."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """Secrets in every whole text: a row for each document with id, n_assign, n_access, n_hex and spans.

    spans is an array of (start, kind, end, verdict) by start and kind: kinds 0 to 2 are the base patterns, kind 3 the
    candidates that the corpus marks as owned. Each base match and each long token is a candidate; its hash is counted over
    the whole corpus by distinct repositories (repo_col) and owners (owner_col). A value held by more than max_owners owners
    or max_repos repositories is a copied example ('example'), any other one 'live'. Base spans stay with either verdict;
    live-looking tokens outside base spans are added only when owned.

    Hot values are counted per (value, owner, repository) first and meet their counts by matched(), so no value is gathered
    in one task. Null text is empty.
    Repeated rows give one result each. Null owners or repositories count as one of their own. An empty table gives an empty
    result. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("\x00")).alias("repo"),
        F.xxhash64(text).alias("row"),
        text.alias("t"),
    )
    base = src.select(
        "id",
        "owner",
        "repo",
        "row",
        F.concat(
            _spans(F.col("t"), ASSIGN, 0, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 8),
            _spans(F.col("t"), ACCESS, 1, lambda s: F.length(s["found"]) >= 16),
            _spans(F.col("t"), HEX, 2),
        ).alias("base"),
        _spans(F.col("t"), CANDIDATE, 3, lambda s: _live_looking(s["found"])).alias("more"),
    )
    outside = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    base = staged(
        base.select("id", "owner", "repo", "row", F.transform(F.concat("base", outside), lambda s: F.struct(s["start"], s["kind"], s["end"], F.xxhash64(F.when(s["kind"] == 0, F.regexp_extract(s["found"], ASSIGN, 1)).otherwise(s["found"])).alias("value"))).alias("spans")),
        "secrets",
    )
    each = base.where(F.size("spans") > 0).select("id", "owner", "repo", "row", F.explode("spans").alias("s"))
    owners = each.select(F.col("s.value").alias("value"), "owner", "repo").distinct().groupBy("value", "owner").agg(F.count("*").alias("repos"))
    freq = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).join(each.groupBy(F.col("s.value").alias("value")).agg(F.count("*").alias("n")), "value")
    judged = (
        matched(each.withColumn("value", F.col("s.value")), freq, ["value"], "n", each.count())
        .select("id", "row", F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.when((F.col("owners") > max_owners) | (F.col("repos") > max_repos), "example").otherwise("live").alias("verdict")).alias("s"))
        .where("s.kind < 3 or s.verdict = 'live'")
        .groupBy("id", "row")
        .agg(F.array_sort(F.array_distinct(F.collect_list("s"))).alias("spans"))
    )
    n = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    keys = base.select(F.col("id"), F.col("row"))
    out = keys.join(judged, keys["id"].eqNullSafe(judged["id"]) & (keys["row"] == judged["row"]), "left").select(keys["id"].alias(id_col), judged["spans"])
    none = F.array().cast("array<struct<start:int,kind:int,end:int,verdict:string>>")
    return out.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.coalesce("spans", none).alias("spans"))


def span_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
