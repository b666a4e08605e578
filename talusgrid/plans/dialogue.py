"""Dialogue operators over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ids
from ..functions.text import interjection, sample_like, sounder_like, token_estimate, word_count
from ..operators import dialogue
from .base import Suite, Tables

suite = Suite()
query = suite.query

#: Turns start where a steady reader of 15 characters a second would be.
_STARTS = "s AS (SELECT *, coalesce(sum(length(text) // 15 + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)"
_TIMES = f"{_STARTS}, tm AS (SELECT *, greatest(start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), start + 5)) AS stop FROM s)"


def _timed(t: Tables) -> DataFrame:
    w = dialogue.by_turn("conv_id", "turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.floor(F.length("text") / 15) + 1).over(w), F.lit(0)).cast("long")
    return dialogue.segment_times(t.conversations, "conv_id", "turn", start)


@query(rf"WITH {_TIMES} SELECT conv_id, turn, start, stop, stop - start AS duration, (start // 60)::VARCHAR || ':' || lpad((start % 60)::VARCHAR, 2, '0') AS stamp, len(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))::BIGINT AS n_words FROM tm WHERE start < 3600")
def segment_meta_lead(t: Tables) -> DataFrame:
    rows = _timed(t).where("start < 3600")
    return rows.select("conv_id", "turn", "start", F.col("end").alias("stop"), "duration", ids.stamp(F.col("start")).alias("stamp"), word_count(F.col("text")).alias("n_words"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, lag('[' || role || ']: ' || text) OVER w AS before, lead('[' || role || ']: ' || text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, before, after FROM c WHERE regexp_matches(text, '(?i)nation|heed') AND contains(lower(role), 'assist') ORDER BY conv_id, turn LIMIT 50""")
def grep_context(t: Tables) -> DataFrame:
    found = dialogue.grep(t.conversations, "conv_id", "turn", "role", "text", "nation|heed", "Assist")
    return found.select("conv_id", "turn", "before", "after")


@query(f"""WITH {_TIMES}, v AS (SELECT * FROM tm WHERE turn % 5 <> 3),
f AS (SELECT *, CASE WHEN lag(turn) OVER w IS NULL OR lag(role) OVER w <> role OR lag(turn) OVER w <> turn - 1 OR start - lag(stop) OVER w > 4 THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
SELECT conv_id, role, min(turn) AS first, max(turn) AS last, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY conv_id, island, role""")
def speaker_blocks(t: Tables) -> DataFrame:
    rows = _timed(t).where("turn % 5 <> 3")
    out = dialogue.speaker_blocks(rows, "conv_id", "turn", "role", "start", "end")
    return out.select("conv_id", "role", "first", "last", "start", F.col("end").alias("stop"), "n")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type FROM events),
tp AS (SELECT user_id, max(pos) AS top FROM e GROUP BY user_id), v AS (SELECT * FROM e WHERE event_type = 'error'),
f AS (SELECT *, CASE WHEN coalesce(pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) > 6, true) THEN 1 ELSE 0 END AS fresh FROM v),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f),
o AS (SELECT user_id, island, min(pos) AS first, least(max(pos) + 1, max(top)) AS last FROM i JOIN tp USING (user_id) GROUP BY user_id, island)
SELECT user_id, island::BIGINT AS island, first, last, last - first + 1 AS n FROM o WHERE last - first + 1 >= 2""")
def segment_islands(t: Tables) -> DataFrame:
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    rows = t.events.select("user_id", pos.alias("pos"), "event_type")
    return dialogue.segments(rows, "user_id", "pos", F.col("event_type") == "error")


@query("""WITH c AS (SELECT conv_id, turn, text, concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w) AS win FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + 2000 AS number, md5(win) AS digest FROM c WHERE regexp_matches(text, 'tion')""")
def catchphrase_windows(t: Tables) -> DataFrame:
    found = dialogue.hit_windows(t.conversations, "conv_id", "turn", "text", "tion")
    return found.select("conv_id", "turn", F.col("number").cast("long").alias("number"), F.md5("window").alias("digest"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n, min(turn) AS low FROM conversations GROUP BY conv_id),
b AS (SELECT *, unnest(range(0, CASE WHEN n <= 4 THEN 1 ELSE ((n - 4 + 2) // 3) + 1 END)) AS batch FROM n)
SELECT conv_id, batch::INT AS batch, low + batch * 3 AS first, least(low + batch * 3 + 4, low + n) - 1 AS last FROM b""")
def batched_windows(t: Tables) -> DataFrame:
    return dialogue.batches(t.conversations, "conv_id", "turn", 4, 1)


@query("""SELECT conv_id, coalesce(min(turn) FILTER (role = 'user' AND length(text) < 200 AND turn > 2), min(turn) FILTER (role = 'user' AND length(text) < 200)) AS next FROM conversations GROUP BY conv_id""")
def next_unassigned(t: Tables) -> DataFrame:
    return dialogue.next_unassigned(t.conversations, "conv_id", "turn", (F.col("role") == "user") & (F.length("text") < 200), 2)


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 <> 1 THEN 'HELPER' ELSE role END AS role FROM conversations")
def relabel(t: Tables) -> DataFrame:
    where = (F.col("role") == "assistant") & (F.col("turn") % 4 != 1)
    return dialogue.relabel(t.conversations, "role", where, " HELPER ").select("conv_id", "turn", "role")


@query()
def chunk_pack(t: Tables) -> DataFrame:
    return dialogue.pack(t.conversations, "conv_id", "turn", token_estimate(F.concat("role", F.lit(": "), "text")), 300, 40)


@query()
def marked_passages(t: Tables) -> DataFrame:
    return dialogue.passages(t.conversations, "conv_id", "turn", "text", r"\b(nation|tion)\b", ("heed", "ing", "ble"), 4)


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, min(n) AS first FROM h WHERE length(text) > 150 GROUP BY conv_id),
r AS (SELECT h.*, coalesce(max(contains(lower(text), 'or will')::INT) OVER (PARTITION BY h.conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM h JOIN f ON h.conv_id = f.conv_id AND n BETWEEN first AND first + 5)
SELECT conv_id, md5(split_part(string_agg(text, ' ' ORDER BY turn), '?', 1)) AS digest FROM r WHERE ended = 0 GROUP BY conv_id""")
def synopsis(t: Tables) -> DataFrame:
    found = dialogue.synopsis(t.conversations, "conv_id", "turn", "role", "text", "assistant")
    return found.select("conv_id", F.md5("synopsis").alias("digest"))


@query("SELECT trim(role) AS role, count(*) AS n FROM conversations WHERE NOT regexp_matches(trim(role), '(?i)^(speaker\\s*)?[a-z]$') GROUP BY 1")
def speaker_counts(t: Tables) -> DataFrame:
    rows = t.conversations.where(~ids.placeholder_speaker(F.col("role")))
    return rows.groupBy(F.trim("role").alias("role")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, n_roles, d.doc_id IS NOT NULL AS has_doc FROM c LEFT JOIN documents d ON d.doc_id = c.conv_id""")
def catalog_counts(t: Tables) -> DataFrame:
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"))
    return n.join(t.documents.select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("there")), "conv_id", "left").select("conv_id", "n_turns", "n_roles", F.col("there").isNotNull().alias("has_doc"))


@query("""SELECT conv_id, turn, regexp_matches(text, '(?i)^\\s*(yeah|ok|right)\\b') AS interjection, length(text) // 4 + (length(text) % 4 > 0)::INT AS tokens FROM conversations""")
def turn_flags(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.rlike("text", F.lit(r"(?i)^\s*(yeah|ok|right)\b")).alias("interjection"), token_estimate(F.col("text")).alias("tokens"))


@query("""WITH e AS (SELECT event_id, abs(value * 100000)::BIGINT AS ms FROM events), s AS (SELECT *, ms // 1000 AS t FROM e)
SELECT event_id, (t // 60) || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS clock, (t // 3600) || ':' || lpad((t % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS hours, (t + 30) // 60 AS minutes FROM s""")
def clock_formats(t: Tables) -> DataFrame:
    """Durations in both forms, and the minutes read back from the longer one."""
    ms = F.bround(F.abs(F.col("value") * 100_000), 0).cast("long")
    rows = t.events.select("event_id", ids.clock(ms).alias("clock"), ids.clock_hours(ms).alias("hours"))
    return rows.withColumn("minutes", ids.whole_minutes(F.col("hours")))


_NAME_SQL = "CASE turn % 6 WHEN 0 THEN 'Speaker ' || upper(text[1]) WHEN 1 THEN text[1] WHEN 2 THEN ' speaker' || text[1] || ' ' WHEN 3 THEN 'I' WHEN 4 THEN 'Speaker M' ELSE role END"


@query(f"""WITH s AS (SELECT {_NAME_SQL} AS name FROM conversations)
SELECT name, count(*) AS n, regexp_matches(trim(name), '^(speaker\\s*)?[a-z]$', 'i') AS any_letter, regexp_matches(trim(name), '^(speaker\\s*)?[a-hj-ln-z]$', 'i') AS unmapped, regexp_matches(name, '^Speaker [A-Z]$') AS numbered FROM s GROUP BY name""")
def placeholder_speakers(t: Tables) -> DataFrame:
    """Names of turns, odd ones among them, under the three tests for nobody known."""
    first = F.substring("text", 1, 1)
    kind = F.col("turn") % 6
    name = F.when(kind == 0, F.concat(F.lit("Speaker "), F.upper(first))).when(kind == 1, first).when(kind == 2, F.concat(F.lit(" speaker"), first, F.lit(" "))).when(kind == 3, "I").when(kind == 4, "Speaker M").otherwise(F.col("role"))
    rows = t.conversations.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return rows.select("name", "n", ids.placeholder_speaker(F.col("name")).alias("any_letter"), ids.unmapped_speaker(F.col("name")).alias("unmapped"), ids.numbered_speaker(F.col("name")).alias("numbered"))


SOUNDERS, SAMPLES = "theth|onthe", "ingin|clip"


@query(f"""WITH w AS (SELECT *, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n FROM conversations)
SELECT conv_id, turn, turn <= 1 AND (regexp_matches(lower(text), '{SOUNDERS}') OR n <= 3) AS sounder, regexp_matches(text, '\\[.*\\]') OR regexp_matches(lower(text), '{SAMPLES}') AS sample, n <= 2 OR length(text) / 15e0 <= 1.2e0 AS interjection FROM w""")
def review_flags(t: Tables) -> DataFrame:
    """Turns that may be sounders, samples or interjections; a turn lasts as long as its letters take to say."""
    text, seconds = F.col("text"), F.length("text") / 15.0
    return t.conversations.select("conv_id", "turn", sounder_like(text, F.col("turn"), SOUNDERS).alias("sounder"), sample_like(text, SAMPLES).alias("sample"), interjection(text, seconds).alias("interjection"))
