"""Text expressions.  All take and return Columns; null in gives null or an empty array out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: A small list of words that carry no topic, for the synthetic corpus as well as English.
STOPWORDS = ("the", "and", "of", "to", "in", "is", "it", "that", "for", "was", "with", "are", "this", "from", "what", "which", "who", "how")


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII word characters, apostrophes and hyphens, longer than one character."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\w'-]{2,}"), F.lit(0))


def query_terms(text: Column, stopwords=STOPWORDS, least: int = 3) -> Column:
    """Distinct words of a question in order, without short and stop words; odd characters vanish."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s'-]", "")
    words = F.filter(F.split(kept, r"\s+"), lambda x: F.length(x) >= least)
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, stopwords))))


def expand_terms(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """Each term followed by its synonyms, one hop, first occurrences only."""
    if not synonyms:
        return F.array_distinct(terms)
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), empty)))))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def word_count(text: Column) -> Column:
    body = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, " "))).cast("long")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_title(text: Column, prefixes: tuple[str, ...] = ("episode", "bonus", "special")) -> Column:
    """Without years in parentheses and leading labels such as ``Episode 12:``, trimmed, in lower case."""
    out = F.regexp_replace(text, r"\(\d{4}\)", "")
    for p in prefixes:
        out = F.regexp_replace(out, rf"(?i)^\s*{p}\s*\d*\s*:\s*", "")
    return F.lower(squeeze(out))


def alnum_title(text: Column) -> Column:
    """Lower case, years dropped, letters and digits only, single spaces."""
    out = F.regexp_replace(F.lower(text), r"\(\d{4}\)", " ")
    return squeeze(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def normal_name(text: Column, noise: tuple[str, ...] = ()) -> Column:
    """Lower case, odd characters and articles dropped, a trailing year and noise words removed."""
    out = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    out = F.regexp_replace(out, r"\b(the|a|an)\b", " ")
    out = F.regexp_replace(squeeze(out), r"\s*\d{4}$", "")
    for w in noise:
        out = F.regexp_replace(out, rf"\b{w}\b", " ")
    return squeeze(out)


def plain_query(text: Column) -> Column:
    """Curly quotes and long dashes as ASCII, single spaces."""
    return squeeze(F.translate(text, "‘’“”–—", "''\"\"--"))


def matchable(text: Column) -> Column:
    """For substring matches: plain, lower case, letters and digits with single spaces."""
    return squeeze(F.regexp_replace(F.lower(plain_query(text)), r"[^a-z0-9]+", " "))


def slug(text: Column, most: int = 40) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(out, 1, most), r"-+$", "")


def clip(text: Column, most: int = 240) -> Column:
    """Squeezed, with an ellipsis where longer than ``most``."""
    body = squeeze(text)
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most - 1), F.lit("…"))).otherwise(body)


def phrases(text: Column, width: int = 4, most: int = 5) -> Column:
    """The first distinct phrases of ``width`` words with a capital or a digit after the lead word."""
    def pick(words: Column) -> Column:
        starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, width), " "))
        return F.slice(F.array_distinct(F.filter(runs, lambda p: p.rlike(r"\s[^\s]*[A-Z0-9]"))), 1, most)

    # through a one-element array, so that the text is split once a row and not once a run
    words = F.array(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.element_at(F.transform(words, pick), 1)


def json_block(text: Column) -> Column:
    """The text from the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def boilerplate_hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns the text matches."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.rlike(text, F.lit(p)).cast("int")
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def excerpt(text: Column, terms: Column, most: int = 600) -> Column:
    """The window of ``most`` characters with the most term occurrences; the first such window wins.

    Windows start a third of their length before an occurrence; without any the
    text's beginning is shown.  Ellipses mark cut ends.
    """
    @F.arrow_udf(returnType="int")
    def starts(body: pa.Array, wanted: pa.Array, size: pa.Array) -> pa.Array:
        rows = (_densest(x.as_py(), w.as_py() or [], n.as_py(), most) if x.is_valid else None for x, w, n in zip(body, wanted, size))
        return pa.array(rows, pa.int32())

    # only texts that are cut go to Python
    cut = F.length(text) > most
    start = F.coalesce(starts(F.when(cut, F.lower(text)), terms, F.length(text)), F.lit(1))
    body = F.substr(text, start, F.lit(most))
    head = F.when(start > 1, F.lit("\u2026")).otherwise(F.lit(""))
    tail = F.when(start + most - 1 < F.length(text), F.lit("\u2026")).otherwise(F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, body, tail))


def _densest(text: str, terms: list[str | None], size: int, most: int) -> int | None:
    """1-based start of the first window with the most places of terms, in time linear in the text; None without any."""
    found = set()
    for term in filter(None, terms):
        at = text.find(term)
        while at >= 0:
            found.add(at + 1)
            at = text.find(term, at + len(term))
    if not found:
        return None
    spots = np.sort(np.fromiter(found, np.int64, len(found)))
    starts = np.clip(spots - most // 3, 1, max(1, size - most + 1))
    hits = np.searchsorted(spots, starts + most) - np.searchsorted(spots, starts)
    return int(starts[np.argmax(hits)])


def long_words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: F.length(w) > 2)


def sounder_like(text: Column, place: Column, cues: str) -> Column:
    """One of the first two turns that has a cue or at most three words."""
    return (place <= 1) & (F.rlike(F.lower(text), F.lit(cues)) | (word_count(text) <= 3))


def sample_like(text: Column, cues: str) -> Column:
    """Text with something in brackets or a cue."""
    return F.rlike(text, F.lit(r"\[.*\]")) | F.rlike(F.lower(text), F.lit(cues))


def interjection(text: Column, seconds: Column) -> Column:
    return (word_count(text) <= 2) | (seconds <= 1.2)
