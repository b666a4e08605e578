"""Rule tables as CASE expressions: the first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import plain_query

#: (label, pattern); ordered, matched against the plain lower-case question.
Rules = tuple[tuple[str, str], ...]


def first_rule(text: Column, rules: Rules, other: str = "none") -> Column:
    low = F.lower(plain_query(text))
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(F.rlike(low, F.lit(pattern)), F.lit(label)).otherwise(out)
    return out


def year_range(text: Column) -> tuple[Column, Column]:
    """(least, greatest) of ``1990-1995``, ``1995 to 1990`` or a single year; nulls without one."""
    pair = r"\b((?:19|20)\d\d)\s*(?:-|to)\s*((?:19|20)\d\d)\b"
    low = F.lower(plain_query(text))
    a, b = F.regexp_extract(low, pair, 1), F.regexp_extract(low, pair, 2)
    one = F.nullif(F.regexp_extract(low, r"\b((?:19|20)\d\d)(?:[^s\d]|$)", 1), F.lit("")).cast("int")
    first = F.when(a != "", F.least(a.cast("int"), b.cast("int"))).otherwise(one)
    last = F.when(a != "", F.greatest(a.cast("int"), b.cast("int"))).otherwise(one)
    return first, last


def decade_of(text: Column) -> Column:
    """The first year of ``1980s`` or ``80s`` (20th century), null without one."""
    low = F.lower(text)
    full = F.nullif(F.regexp_extract(low, r"\b((?:19|20)\d0)s\b", 1), F.lit("")).cast("int")
    short = F.nullif(F.regexp_extract(low, r"\b([2-9]0)s\b", 1), F.lit("")).cast("int")
    return F.coalesce(full, 1900 + short)


def keyword_class(text: Column, triggers: dict[str, tuple[str, ...]], extra: Column | None = None) -> tuple[Column, Column]:
    """(kind, confidence) by the number of trigger words; ``extra`` is added to the first kind's count.

    A clear winner has confidence 0.5 plus 0.1 a trigger, 0.8 at most; a tie is
    ``hybrid`` with 0.6, and nothing at all ``hybrid`` with 0.4.
    """
    low = F.lower(text)
    count = {}
    for kind, words in triggers.items():
        n = F.lit(0.0)
        for w in words:
            n = n + F.contains(low, F.lit(w)).cast("double")
        count[kind] = n
    kinds = list(triggers)
    if extra is not None:
        count[kinds[0]] = count[kinds[0]] + extra
    best = F.greatest(*count.values())
    leaders = sum((F.when(c == best, 1).otherwise(0) for c in count.values()), F.lit(0))
    name = F.lit("hybrid")
    for kind in reversed(kinds):
        name = F.when(count[kind] == best, F.lit(kind)).otherwise(name)
    clear = (best > 0) & (leaders == 1)
    confidence = F.when(clear, F.least(F.lit(0.8), 0.5 + 0.1 * best)).when(best > 0, F.lit(0.6)).otherwise(F.lit(0.4))
    return F.when(clear, name).otherwise(F.lit("hybrid")), F.round(confidence, 6)


def captured(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first group of the first pattern that matches, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def any_rule(text: Column, patterns: tuple[str, ...]) -> Column:
    low = F.lower(plain_query(text))
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(low, F.lit(p))
    return out


def rollout(key: Column, percent: int) -> Column:
    """A stable share of keys."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(100)) < percent


def token_budget(kind: Column, results: Column) -> Column:
    base = F.when(kind == "factual", 400).when(kind == "interpretive", 1200).otherwise(800)
    return F.least(F.lit(4096), base + results * 60).cast("long")


def year_range_as_written(text: Column) -> tuple[Column, Column]:
    """(first, last) of ``1990 to 1995`` or ``1990-1995`` in the order written, or a single year that no s follows; 1900 to 2029."""
    year = r"(19\d\d|20[0-2]\d)"
    low = F.lower(plain_query(text))
    a, b = (F.nullif(F.regexp_extract(low, rf"\b{year}\s*(?:-|to)\s*{year}\b", i), F.lit("")).cast("int") for i in (1, 2))
    one = F.nullif(F.regexp_extract(low, rf"\b{year}\b(?!s)", 1), F.lit("")).cast("int")
    return F.coalesce(a, one), F.coalesce(b, one)


def item_number(text: Column) -> Column:
    """The number of ``episode 12``, ``episode #12`` or ``ep. 12``."""
    return F.nullif(F.regexp_extract(F.lower(plain_query(text)), r"\b(?:episode|ep\.?)\s*(?:number\s*)?#?\s*(\d+)", 1), F.lit("")).cast("int")


def picker(text: Column) -> Column:
    """Whose pick is asked for: ``who did anna pick``, ``anna's pick``."""
    return captured(F.lower(plain_query(text)), (r"\bdid (\w+) (?:pick|cast|choose)\b", r"\b(\w+)'s (?:pick|choice)\b"))
