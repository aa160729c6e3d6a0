"""Chat messages: roles, rendering, lengths, prompts for judging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _c, token_count, trim_ws


def role_of(role) -> Column:
    """human and user are the user, system is the system, all others the assistant."""
    r = F.lower(trim_ws(F.coalesce(_c(role), F.lit(""))))
    return F.when(r.isin("human", "user"), "user").when(r == "system", "system").otherwise("assistant")


def render(messages, generation: bool = False) -> Column:
    """Messages, an array of (role, content), as one text: each in marks of its role, and an open assistant turn if asked for."""
    parts = F.transform(_c(messages), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(parts, ""), F.lit("<|im_start|>assistant\n" if generation else ""))


def message_tokens(messages, count: Callable[[Column], Column] = token_count, generation: bool = False) -> Column:
    """Tokens of the rendered messages, by any counting function of a column."""
    return count(render(messages, generation))


def decoded(output) -> Column:
    """A model's output without white space at its ends."""
    return trim_ws(F.coalesce(_c(output), F.lit("")))


def optional(record: str, *path: str) -> Column:
    """A field of nested maps or structs, null where a step is missing."""
    at = F.col(record)
    for name in path:
        at = F.try_element_at(at, F.lit(name))
    return at


def suffix(name, sep: str = ".") -> Column:
    """What follows the last separator; the whole without one."""
    return F.substring_index(_c(name), sep, -1)


def constant_struct(**fields) -> Column:
    """The same struct in every row."""
    return F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))
