"""Quality rules as a short-circuit cascade of SQL expressions.

A rule is a name and a condition that rejects a row.  Each rule's cost, that of
the counts it needs included, and its rejection share are estimated on a bounded
sample; the rules then stand in one CASE expression, most rejections per cost
first, so that a row pays for the rules up to the first that rejects it.  The
verdict does not depend on the order.  :func:`keep` works out every count inside
the rule that needs it; :func:`judge`, which reports the basic counts of each
row, takes those as given.  Everything runs as DataFrame expressions inside the
scan's tasks: there is no shuffle and no Python.

Defined results: a null text has no words and all its counts are 0.  Conditions
that are null do not reject.  Repeated rows get equal results; an empty table
gives an empty result; names of other columns do not matter, as only the id and
the text are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RUN, SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that occurs twice or more in the row."""

    def covered(starts: Column) -> Column:
        # sorted starts of repeated windows: each adds the words that the one before does not cover
        step = F.transform(starts, lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - starts[i - 1])))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twin = lambda x, i: F.when(
            ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (pairs[F.least(i + 1, last)]["h"] == x["h"])), x["at"]
        )
        return let(F.sort_array(F.array_compact(F.transform(pairs, twin))), covered)

    def from_windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, repeated)).otherwise(F.lit(0).cast("long"))

    def from_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (window - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window))), from_windows)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, let(hashed, from_hashes)).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    """How many lines with a word are equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


#: The basic counts of a text column that is not null.
COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda text: F.size(words_of(text)).cast("long"),
    "word_chars": lambda text: F.length(F.translate(text, SPACES, "")).cast("long"),
    "n_symbols": lambda text: (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": lambda text: repeated_words(words_of(text)),
}
Counts = Callable[[str], Column]


def given(name: str) -> Column:
    """A count as a column that :func:`measures` made."""
    return F.col(name)


def worked_out(name: str) -> Column:
    """A count as an expression of the text, evaluated where it stands."""
    return COUNTS[name](F.col("text"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the text, and the basic counts of each whole text."""
    rows = _texts(docs, id_col, text_col).withColumn("words", words_of(F.col("text")))
    of_words = {"n_words": F.size("words").cast("long"), "n_repeat_words": repeated_words(F.col("words"))}
    return rows.select(F.col(id_col), "text", *[of_words.get(name, count(F.col("text"))).alias(name) for name, count in COUNTS.items()])


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the counts by name (:func:`given` or :func:`worked_out`) and may use the column ``text``."""

    name: str
    rejects: Callable[[Counts], Column]


def _letters_share(pattern: str, most: float) -> Column:
    return F.length(F.regexp_replace("text", pattern, "")) < F.length("text") * (1 - most)


#: What every text must pass.
BASE = (
    Rule("few_words", lambda n: n("n_words") < 20),
    Rule("repeated_words", lambda n: n("n_repeat_words") * 100 > n("n_words") * 30),
)
#: Rejections that clean prose stays far from.
RULES = (
    Rule("symbols", lambda n: n("n_symbols") * 10 > n("n_words")),
    Rule("word_length", lambda n: (n("word_chars") < n("n_words") * 2) | (n("word_chars") > n("n_words") * 15)),
    Rule("duplicate_lines", lambda n: n("n_dup_lines") * 10 > F.size(F.split("text", "\n")) * 3),
    Rule("shouting", lambda n: _letters_share("[A-Z]", 0.5)),
    Rule("exclamations", lambda n: (F.length("text") - F.length(F.translate("text", "!", ""))) * 3 > n("n_words")),
    Rule("digits", lambda n: _letters_share("[0-9]", 0.3)),
)


def base_failed() -> Column:
    return BASE[0].rejects(given) | BASE[1].rejects(given)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        """Rejections per second; a rule that rejects nothing comes last, cheapest first."""
        return self.rejected / self.seconds if self.rejected else -self.seconds


#: A rule is timed over so many copies of the sample that it takes this long beyond an idle pass, or over the most copies.
TELLING_SECONDS, MOST_COPIES = 0.04, 512


def estimate(docs: DataFrame, rules=RULES, counts: Counts = given, sample_rows: int = 400, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[Estimate]:
    """Cost and rejection share of each rule on about ``sample_rows`` rows, picked by a hash of id and text.

    Seconds are those of one pass over the sample beyond a pass that asks for
    nothing: each rule runs once to be compiled, then over as many copies of
    the sample as it takes for its own work to stand out from the job's.
    The sample only decides the order of the rules, never a verdict.
    """
    spark = docs.sparkSession
    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    rows = _texts(docs.where(picked), id_col, text_col).select("text").collect()
    if not rows:
        return [Estimate(r.name, 1.0, 0.0) for r in rules]
    sample = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id long, text string")
    sample = (measures(sample) if counts is given else sample).cache()
    sample.count()

    def timed(condition: Column, copies: int) -> tuple[float, int]:
        """The shortest of some passes, the first of which is not counted."""
        many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy")) if copies > 1 else sample
        asked = many.agg(F.count_if(condition & F.col("_copy").isNotNull()) if copies > 1 else F.count_if(condition))
        best, hits = float("inf"), asked.first()[0]
        for _ in range(repeats):
            began = time.perf_counter()
            asked.first()
            best = min(best, time.perf_counter() - began)
        return best, hits // copies

    idle: dict[int, float] = {}
    found = []
    for rule in rules:
        copies, condition, before = 1, F.coalesce(rule.rejects(counts), F.lit(False)), None
        while True:
            if copies not in idle:
                idle[copies] = timed(F.lit(False), copies)[0]
            seconds, hits = timed(condition, copies)
            own = seconds - idle[copies]
            # a pause of the machine does not grow with the copies
            if copies >= MOST_COPIES or (before is not None and own >= max(TELLING_SECONDS, 2 * before)):
                break
            copies, before = copies * 8, own
        found.append(Estimate(rule.name, max(own, 1e-6) / copies, hits / len(rows)))
    sample.unpersist()
    return found


def ordered(rules, estimates: list[Estimate]) -> list[Rule]:
    """Most rejections per cost first; ties by name."""
    gain = {e.name: e.gain for e in estimates}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def first_rejection(rules, counts: Counts = given) -> Column:
    """The name of the first rule that rejects the row, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        out = F.when(rule.rejects(counts), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """Per row: the id, the counts, ``base_failed``, ``failed_rule`` (which rule comes first varies) and ``kept``."""
    order = ordered(rules, estimate(docs, rules, given, sample_rows, id_col=id_col, text_col=text_col))
    rows = measures(docs, id_col, text_col).withColumn("base_failed", base_failed())
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_rejection(order))
    return rows.withColumn("failed_rule", failed).select(
        F.col(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept")
    )


def keep(docs: DataFrame, rules=BASE + RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400, order: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns unchanged; a row pays for no rule after the first that rejects it."""
    order = order or ordered(rules, estimate(docs, rules, worked_out, sample_rows, id_col=id_col, text_col=text_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), text.alias("text"))
    return rows.where(first_rejection(order, worked_out).isNull()).select("_row.*")


def oracle_sql(table: str = "documents") -> str:
    """The same counts and verdict in DuckDB SQL."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    gone = lambda chars: f"length(text) - length(translate(text, '{chars}', ''))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: trim(x, {spaces}) <> '') AS lines FROM t),
d AS (SELECT *, list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS windows,
             row_number() OVER () AS rid FROM w),
e AS (SELECT rid, unnest(windows) AS win, generate_subscripts(windows, 1) AS pos FROM d),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS k FROM e) WHERE k > 1),
s AS (SELECT rid, sum(least({WINDOW}, coalesce(pos - prev, {WINDOW})))::BIGINT AS n
      FROM (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS prev FROM r) GROUP BY rid),
m AS (SELECT doc_id, text, len(words)::BIGINT AS n_words, length(translate(text, {spaces}, ''))::BIGINT AS word_chars,
             ({gone(SYMBOLS)})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN s USING (rid)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 15
            OR n_dup_lines * 10 > len(string_split(text, chr(10))) * 3
            OR length(regexp_replace(text, '[A-Z]', '', 'g')) < length(text) * 0.5
            OR ({gone('!')}) * 3 > n_words
            OR length(regexp_replace(text, '[0-9]', '', 'g')) < length(text) * 0.7) AS kept
FROM b"""
