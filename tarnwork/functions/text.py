"""Column functions for text with byte-exact, ASCII-only case rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space, for trimming.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
WORD = "[A-Za-z0-9_]"


def ascii_lower(c: Column) -> Column:
    """A-Z only; ASCII text takes the faster ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def any_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def contains_any(c: Column, tokens: Iterable[str]) -> Column:
    """Some token occurs; beyond a few tokens one expression, so that many of these compile as one stage."""
    tokens = list(tokens)
    return any_of(F.contains(c, F.lit(t)) for t in tokens) if len(tokens) < 3 else c.rlike(spelled(shortest(tokens)))


def quoted(tokens: Iterable[str]) -> str:
    """Alternation of literal tokens, for Java's and RE2's dialects alike."""
    return "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", t) for t in tokens)


def shortest(tokens: Iterable[str]) -> list[str]:
    """The tokens that hold no other: one of them occurs where any does."""
    tokens = sorted(set(tokens))
    return [t for t in tokens if not any(o != t and o in t for o in tokens)]


def spelled(tokens: Iterable[str]) -> str:
    """The alternation of ``quoted``, by first characters: a place in a text is compared with few branches."""
    rests: dict[str, set[str]] = {}
    for t in tokens:
        rests.setdefault(t[:1], set()).add(t[1:])
    end = rests.pop("", None) is not None
    branches = []
    for first, tails in sorted(rests.items()):
        while len(tails) > 1 and len({t[:1] for t in tails}) == 1 and "" not in tails:  # a common start
            first, tails = first + min(tails)[0], {t[1:] for t in tails}
        branches.append(quoted([first]) + (spelled(tails) if len(tails) > 1 else quoted(tails)))
    body = "|".join(branches)
    return f"(?:{body}){'?' * end}" if end or len(branches) > 1 else body


def has_token(c: Column, tokens: Iterable[str]) -> Column:
    """Some token with no word character at either side."""
    return c.rlike(f"(?<!{WORD}){spelled(tokens)}(?!{WORD})")


def calls_named(c: Column, name: str) -> Column:
    """``name(`` as a call: not the end of a longer name, not behind a definition keyword and blanks."""
    from .fixed import DEFINITIONS

    before = F.split(c, rf"{name}\(", -1)  # what stands before each occurrence, and the rest
    definition = lambda p: any_of(F.endswith(F.rtrim(p, F.lit(BLANKS)), F.lit(d)) for d in DEFINITIONS)
    called = F.exists(F.slice(before, 1, F.size(before) - 1), lambda p: ~p.rlike(r"[\p{L}\p{N}_]\z") & ~definition(p))
    return F.contains(c, F.lit(f"{name}(")) & called


def eval_invoked(low: Column) -> Column:
    return F.contains(low, F.lit("eval ")) & low.rlike("(^|[^A-Za-z0-9])eval +[$`\"']")


def normal_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def is_file(path: Column, names: Iterable[str]) -> Column:
    """The path ends in one of these file names, as a whole component."""
    return base_name(path).isin(*names)


def lines(content: Column) -> Column:
    """Lines without terminators: one trailing CR goes, and there is no line after the last LF."""
    parts = F.split(content, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def utf8(content: Column) -> Column:
    """Text of raw bytes, bad sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def redacted(c: Column, chars: int) -> Column:
    """The first characters with secrets.<name> tokens blanked; tokens are runs of [A-Za-z0-9_.-]."""
    head = F.substring(c, 1, chars)
    return F.when(F.contains(ascii_lower(head), F.lit("secrets.")), F.regexp_replace(head, r"(?i)(?<![A-Za-z0-9_.-])secrets\.[A-Za-z0-9_.-]*", "secrets.<redacted>")).otherwise(head)
