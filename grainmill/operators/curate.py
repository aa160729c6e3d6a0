"""A curation pass over prompt and response records: removal rules, rewrites, topics, caps. The rules are our own."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, fold, is_blank, key_digest, once, squeeze_ws, trim_ws, word_count
from .audit import first_match
from .select import cap_per_key, first_per_key

#: Removal rules by name, in order: the first that holds is the reason. Phrases are case-folded.
REFUSALS = ("i can only help with", "outside my area", "cannot help with that topic")
BYPASS = ("disable the firewall", "turn off antivirus", "bypass security")
#: Left-overs of templates, and whole answers that say nothing.
ARTIFACTS = ("{{", "lorem ipsum", "[insert")
GENERIC = ("it depends.", "please contact support.", "see the documentation.")
#: Topics by keyword, in order; the first match wins.
TOPICS = {
    "network": ("vpn", "network", "wifi", "router", "dns"),
    "mail": ("mail", "outlook", "inbox"),
    "databases": ("sql", "database", "query"),
    "security": ("password", "token", "login", "secret"),
    "storage": ("disk", "backup", "storage", "file"),
    "hardware": ("driver", "printer", "laptop", "screen"),
    "meetings": ("teams", "meeting", "call"),
    "office": ("excel", "word document", "spreadsheet", "powerpoint"),
    "operating_system": ("windows", "registry", "boot"),
    "unix": ("linux", "ubuntu", "bash"),
    "cloud": ("cloud", "server", "virtual machine"),
    "developer_tools": ("git", "compiler", "ide "),
    "enterprise": ("sap", "crm", "erp"),
    "performance": ("slow", "performance", "memory"),
    "software": ("install", "software", "update"),
    "identity": ("who are you", "your name"),
    "recovery": ("restore", "recover"),
}


def any_phrase(folded: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a folded text holds one of the phrases."""
    return functools.reduce(lambda a, b: a | b, (folded.contains(p) for p in phrases), F.lit(False))


def removal_rules(response, labels: tuple[str, ...] = (), aliases: tuple[str, ...] = (), min_words: int = 3, noise_share: float = 0.2, folded: Column | None = None) -> list[tuple[str, Column]]:
    """(reason, condition) in order, for a response; folded: its folded form where that is at hand."""
    x = F.coalesce(_c(response), F.lit(""))
    folded = fold(x) if folded is None else folded
    odd = F.length(F.regexp_replace(x, r"[\p{L}\p{N}\p{P}\s]", ""))
    return [
        ("empty", is_blank(x)),
        ("bare_label", trim_ws(x).isin(*labels) | trim_ws(x).rlike(r"\A[a-z]+(?:_[a-z]+)+\z")),
        ("too_short", word_count(x) < min_words),
        ("refusal", any_phrase(folded, REFUSALS)),
        ("persona", functools.reduce(lambda a, b: a | b, (x.contains(a) for a in aliases), F.lit(False))),
        ("security_bypass", any_phrase(folded, BYPASS)),
        ("artifact", any_phrase(folded, ARTIFACTS)),
        ("generic", squeeze_ws(folded).isin(*GENERIC)),
        ("noise", odd > noise_share * F.length(x)),
    ]


def rewrite(df: DataFrame, text: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df with the text rewritten by (flag, pattern, replacement) in order, and flags: those that changed it."""
    now, flags = F.coalesce(F.col(text), F.lit("")), []
    for flag, pattern, replacement in rules:
        flags.append(F.when(now.rlike(pattern), F.lit(flag)))
        now = F.regexp_replace(now, pattern, replacement)
    return df.withColumn("flags", F.array_compact(F.array(*flags))).withColumn(text, now)


def topic(c, topics: dict[str, tuple[str, ...]] = TOPICS, otherwise: str = "other") -> Column:
    """The first topic of which the text holds a keyword. The text is folded once for all of them."""
    return once(fold(_c(c)), lambda x: first_match([(name, any_phrase(x, words)) for name, words in topics.items()], otherwise))


def score_filter(df: DataFrame, min_question: int, min_answer: int, question: str, answer: str) -> DataFrame:
    """Rows whose question and answer scores reach the least ones; null scores do not."""
    return df.where((F.col(question) >= min_question) & (F.col(answer) >= min_answer))


def curate(df: DataFrame, id_col: str, prompt: str, response: str, response_cap: int = 5, identity: Column | None = None, identity_cap: int = 8, **rules) -> DataFrame:
    """Records that pass the removal rules, one for each prompt and response, one for each prompt, at most response_cap for each
    response and identity_cap with identity in all; the first by id stay."""
    reason = once(fold(F.coalesce(F.col(response), F.lit(""))), lambda x: first_match(removal_rules(response, folded=x, **rules)))
    keyed = df.where(reason.isNull()).withColumns({"_p": key_digest(prompt), "_r": key_digest(response)})
    # One aggregation for both: the first row of a prompt is the first of its prompt and response as well.
    kept = first_per_key(keyed, [F.col("_p")], id_col)
    kept = cap_per_key(kept, [F.col("_r")], response_cap, [F.col(id_col)]).drop("_p", "_r")
    if identity is not None:
        own = kept.where(F.coalesce(identity, F.lit(False))).orderBy(id_col).limit(identity_cap)
        kept = kept.where(~F.coalesce(identity, F.lit(False))).unionByName(own)
    return kept
