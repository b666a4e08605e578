"""File formats: nested transcripts, catalog CSV, month-partitioned logs, lexicons and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import ids

TRANSCRIPT = "episode_number string, episode_name string, dialogues array<struct<name:string,timestamp:string,text:string>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file below ``path`` with its name; files that are no transcripts are dropped."""
    read = spark.read.schema(TRANSCRIPT + ", _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    read = read.withColumn("file", F.col("_metadata.file_name"))
    return read.where("_corrupt_record IS NULL AND dialogues IS NOT NULL").drop("_corrupt_record")


def turns(transcripts: DataFrame) -> DataFrame:
    """One row per turn with its place: the order of turns matters."""
    rows = transcripts.select("episode_number", "episode_name", F.posexplode("dialogues").alias("turn", "d"))
    return rows.select("episode_number", "episode_name", "turn", F.col("d.name").alias("speaker"), ids.seconds(F.col("d.timestamp")).alias("start"), F.col("d.text").alias("text"))


def transcript_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Names and ids of the JSON files, those under ``raw`` left out, in order of the id's number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "length")
    entry = F.nullif(F.regexp_extract("path", r"episode_(\w+)\.json$", 1), F.lit(""))
    rows = files.where(~F.contains("path", F.lit("/raw/"))).select("path", entry.alias("entry"), "length")
    number = F.coalesce(F.nullif(F.regexp_extract("entry", r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return rows.withColumn("number", number).orderBy("number", "path")


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with quoted, multi-line fields; every column is text, rows without any value are dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    some = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "" for c in rows.columns])
    return rows.where(some)


def typed_catalog(rows: DataFrame, aliases: dict[str, list[str]], numbers: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """Columns by the first header that is there, blanks as null or the default, numbers as 0 where unreadable."""
    lower = {c.lower().strip(): c for c in rows.columns}
    out = []
    for name, headers in aliases.items():
        found = [F.col(f"`{lower[h.lower()]}`") for h in headers if h.lower() in lower]
        value = ids.blank_to_null(F.coalesce(*found)) if found else F.lit(None).cast("string")
        if name in numbers:
            value = F.coalesce(F.nullif(F.regexp_extract(value, r"^\s*(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0))
        elif defaults and name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        out.append(value.alias(name))
    return rows.select(*out)


def title_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"\((\d{4})\)\s*$", 1), F.lit("")).cast("int")


#: Times in logs keep their microseconds.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_monthly(rows: DataFrame, path: str, at: str) -> None:
    """Append JSON under ``month=YYYY-MM`` folders."""
    months = rows.withColumn("month", F.date_format(at, "yyyy-MM")).hint("rebalance", "month")
    months.write.mode("append").option("timestampFormat", TIMES).partitionBy("month").json(path)


def read_monthly(spark: SparkSession, path: str, schema: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of the months in range; only their folders are read."""
    rows = spark.read.schema(schema + ", month string").option("timestampFormat", TIMES).json(path)
    if first:
        rows = rows.where(F.col("month") >= first)
    return rows.where(F.col("month") <= last) if last else rows


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a tab-separated file; lines that begin with # and blank ones are passed over."""
    rows = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#|$)")))
    return rows.select(F.trim(F.split("value", "\t")[0]).alias("term"), F.get(F.split("value", "\t"), F.lit(1)).try_cast("long").alias("n"))


def write_lexicon(terms: DataFrame, path: str) -> None:
    terms.orderBy(F.desc("n"), "term").select(F.concat_ws("\t", "term", "n")).write.mode("overwrite").text(path)


def rounded_vectors(rows: DataFrame, vector: str, places: int = 6) -> DataFrame:
    """Doubles rounded by their binary value, halves away from zero; a small negative number becomes -0.0.

    Spark's ``round`` goes by the shortest decimal form instead, which has halves where the value has none.
    """
    def rounded(x: Column) -> Column:
        moved = x * 10.0**places
        whole = F.rint(moved)  # takes halves to the even neighbour
        out = F.when(F.abs(moved - whole) == 0.5, moved + F.signum(moved) * 0.5).otherwise(whole) / F.lit(10.0**places)
        return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)

    return rows.withColumn(vector, F.transform(vector, rounded))


def events_of_stream(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The data of the last complete event of server-sent event lines, per key."""
    field = F.regexp_extract(text, r"^(event|data):\s?(.*)$", 1)
    value = F.regexp_extract(text, r"^(event|data):\s?(.*)$", 2)
    w = Window.partitionBy(key).orderBy(order)
    named = lines.withColumn("_event", F.last(F.when(field == "event", value), ignorenulls=True).over(w)).withColumn("_field", field).withColumn("_value", value)
    done = named.where((F.col("_field") == "data") & (F.col("_event") == "complete"))
    return done.groupBy(key).agg(F.max_by("_value", order).alias("data"))
