"""Unicode-aware text functions as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.isspace has it, line breaks as str.splitlines has them, and the first without the second.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
INLINE = r"[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
#: The same white space as single characters, and the line breaks of one character.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BREAK_CHARS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
#: Words, and each other sign that is not white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# What counts as an answer that abstains.
ABSTENTIONS = (
    r"\bi (?:do not|don't) know\b",
    r"\bi (?:do not|don't) have enough (?:information|context)\b",
    r"\b(?:cannot|can't|unable to) (?:answer|determine|provide)\b",
    r"\b(?:not enough|insufficient) (?:information|context)\b",
    r"\bno (?:relevant )?information (?:is |was )?provided\b",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, f) -> Column:
    """f(c), with c computed once for each row however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def trim_ws(c) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def squeeze_ws(c) -> Column:
    """Each run of Unicode white space as one space, none at the ends."""
    others = WS_CHARS.replace(" ", "")
    return F.btrim(F.regexp_replace(F.translate(_c(c), others, " " * len(others)), " {2,}", " "))


def is_blank(c) -> Column:
    """Null, or nothing but white space; reads no further than the first other character."""
    return ~F.coalesce(_c(c).rlike(WS.replace("[", "[^", 1)), F.lit(False))


def clean_text(c) -> Column:
    """Null to '', written-out \\n to a line break, line breaks alike, blanks in a line squeezed, at most one empty line."""
    x = F.coalesce(_c(c).cast("string"), F.lit(""))
    x = F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\r\n"), F.lit("\n"))
    # A carriage return before one that was just taken is part of a pair again; the others are breaks of their own.
    x = F.translate(F.replace(trim_ws(x), F.lit("\r\n"), F.lit("\n")), BREAK_CHARS + "\t", "\n" * len(BREAK_CHARS) + " ")
    x = F.regexp_replace(x, " {2,}", " ")
    x = F.regexp_replace(x, rf"{INLINE}+\n{INLINE}*|\n{INLINE}+", "\n")
    return trim_ws(F.regexp_replace(x, r"\n{3,}", "\n\n"))


@functools.cache
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """The code points whose full case folding differs from themselves: one to one, and one to many."""
    one, many = [], []
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (f := chr(i).casefold()) != chr(i):
            (one if len(f) == 1 else many).append((chr(i), f))
    return "".join(a for a, _ in one), "".join(b for _, b in one), tuple(many)


#: Stands for the characters that fold to several, but for the sharp s, while a text is looked through for them.
ODD = "\ue000"


def casefold(c) -> Column:
    """Full Unicode case folding. Texts of ASCII, and those whose only character that folds to several is the sharp s, take
    shorter ways; the others are gone through once for each such character. A regular expression of all of them, or as many
    nested calls, take far longer."""
    x = _c(c)
    source, target, many = _folding()
    odd = [m for m in many if m[0] != "ß"]
    usual = F.translate(x, source + "".join(a for a, _ in odd), target + ODD * len(odd))
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in many))
    full = F.aggregate(pairs, F.translate(x, source, target), lambda y, m: F.replace(y, m[0], m[1]))
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).when(F.contains(usual, F.lit(ODD)), full).otherwise(F.replace(usual, F.lit("ß"), F.lit("ss")))


fold = casefold


def text_key(c) -> Column:
    """The key by which texts count as the same: cleaned, case-folded, white space squeezed.

    Of cleaning, only the written-out \\n is left to do: all else changes white space to white space, which is squeezed here.
    """
    x = F.coalesce(_c(c).cast("string"), F.lit(""))
    return squeeze_ws(casefold(F.replace(x, F.lit("\\n"), F.lit("\n"))))


def key_digest(c) -> Column:
    """sha-256 of the key, for grouping and joining where the key itself is not asked for: no texts are shuffled."""
    return F.sha2(text_key(c), 256)


def join_question(title, body) -> Column:
    """Title and body apart by an empty line; one alone where the other is empty or both are the same."""
    t, b = clean_text(title), clean_text(body)
    both = (t != "") & (b != "") & (text_key(title) != text_key(body))
    return F.when(both, F.concat(t, F.lit("\n\n"), b)).otherwise(F.when(b != "", b).otherwise(t))


def tokens(c) -> Column:
    """Case-folded words and signs, in order."""
    return F.regexp_extract_all(fold(F.coalesce(_c(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(c) -> Column:
    return F.size(tokens(c)).cast("long")


def word_count(c) -> Column:
    """Runs without Unicode white space."""
    x = squeeze_ws(F.coalesce(_c(c), F.lit("")))
    return F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, " "))).cast("long")


def is_abstention(c) -> Column:
    """Whether an answer is empty or says that it does not know."""
    x = squeeze_ws(F.replace(fold(F.coalesce(_c(c), F.lit(""))), F.lit("’"), F.lit("'")))
    return (x == "") | functools.reduce(lambda a, b: a | b, (x.rlike("(?U)" + p) for p in ABSTENTIONS))


def seeded_hash(c, seed: int) -> Column:
    """A fixed pseudo-random order of ids: sha-256 of 'seed:id'."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _c(c).cast("string")), 256)


def preview(c, most: int = 320, ends: int = 160) -> Column:
    """A long text as its two ends."""
    x = _c(c)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, ends), F.lit(" ... "), F.right(x, F.lit(ends))))
