"""Identifiers, time stamps and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sort_key(entry: Column) -> Column:
    """``12`` -> 12.0, a bonus entry ``12b3`` -> 12.03, anything else 0."""
    main, part = F.regexp_extract(entry, r"^(\d+)(?:b(\d+))?$", 1), F.regexp_extract(entry, r"^(\d+)(?:b(\d+))?$", 2)
    return F.when(main == "", F.lit(0.0)).otherwise(main.cast("double") + F.coalesce(F.nullif(part, F.lit("")).cast("double"), F.lit(0.0)) * 0.01)


def order_key(season: Column, entry: Column) -> Column:
    return season * 1000 + sort_key(entry)


def entry_label(season: Column, entry: Column) -> Column:
    """``S2E14``; entries that are no positive number are ``S2 Bonus``."""
    number = F.nullif(F.regexp_extract(entry, r"^0*([1-9]\d*)$", 1), F.lit(""))
    return F.when(number.isNull(), F.concat(F.lit("S"), season, F.lit(" Bonus"))).otherwise(F.concat(F.lit("S"), season, F.lit("E"), number))


def seconds(stamp: Column) -> Column:
    """``m:ss`` or ``h:mm:ss`` in seconds, else 0."""
    parts = F.split(stamp, ":")
    n = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    two, three = F.size(parts) == 2, F.size(parts) == 3
    return F.when(two, n(0) * 60 + n(1)).when(three, n(0) * 3600 + n(1) * 60 + n(2)).otherwise(F.lit(0).cast("long"))


def stamp(total: Column) -> Column:
    """Seconds as ``m:ss``, from an hour on ``h:mm:ss``."""
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    pad = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    short = F.concat(m.cast("string"), F.lit(":"), pad(s))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), pad(m), F.lit(":"), pad(s))).otherwise(short)


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def chunk_id(title: Column, number: Column) -> Column:
    return F.concat(F.regexp_replace(title, "[^a-zA-Z0-9]", "_"), F.lit("_"), number.cast("string"))


def chunk_parts(chunk: Column) -> tuple[Column, Column]:
    """(prefix, number) of a chunk id; null where there is no number after the last underscore."""
    pattern = r"^(.*)_(\d+)[^_]*$"
    return F.nullif(F.regexp_extract(chunk, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(chunk, pattern, 2), F.lit("")).cast("long")


def release_date(text: Column) -> Column:
    """Dates as month/day/year with four or two digits."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("M/d/yy"))).cast("date")


def log_month(log_id: Column) -> Column:
    """The month in an id ``prefix_<base-36 milliseconds>_<suffix>``."""
    ms = F.conv(F.upper(F.get(F.split(log_id, "_"), F.lit(1))), 36, 10).cast("long")
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def filled_fields(columns: dict[str, Column]) -> Column:
    """A map of the named values that are neither null nor empty."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[c.cast("string") for c in columns.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def blank_to_null(text: Column, blanks: tuple[str, ...] = ("", "n/a", "none")) -> Column:
    return F.when(F.lower(F.trim(text)).isin(*blanks), F.lit(None)).otherwise(text)


def placeholder_speaker(name: Column, exempt: tuple[str, ...] = ()) -> Column:
    """Names such as ``A`` or ``Speaker B`` that stand for nobody known."""
    out = F.rlike(F.trim(name), F.lit(r"(?i)^(speaker\s*)?[a-z]$"))
    return out & ~F.upper(F.trim(name)).isin(*exempt) if exempt else out


def _pad(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def clock(ms: Column) -> Column:
    """Milliseconds as ``m:ss``; minutes go on beyond an hour."""
    total = F.floor(ms / 1000).cast("long")
    return F.concat(F.floor(total / 60).cast("string"), F.lit(":"), _pad(total % 60))


def clock_hours(ms: Column) -> Column:
    """Milliseconds as ``h:mm:ss``, with the hours even if there are none."""
    total = F.floor(ms / 1000).cast("long")
    return F.concat(F.floor(total / 3600).cast("string"), F.lit(":"), _pad(F.floor(total % 3600 / 60).cast("long")), F.lit(":"), _pad(total % 60))


def whole_minutes(hms: Column) -> Column:
    """``h:mm:ss`` or ``mm:ss`` in minutes, halves rounded up; null for anything else."""
    parts = F.transform(F.split(hms, ":"), lambda x: x.try_cast("double"))
    n = lambda i: F.get(parts, F.lit(i))
    three, two = F.size(parts) == 3, F.size(parts) == 2
    return F.floor(F.when(three, n(0) * 60 + n(1) + n(2) / 60).when(two, n(0) + n(1) / 60) + 0.5).cast("long")


def unmapped_speaker(name: Column) -> Column:
    """:func:`placeholder_speaker` but for I and M, which are names here."""
    return placeholder_speaker(name, ("I", "M", "SPEAKER I", "SPEAKER M", "SPEAKERI", "SPEAKERM"))


def numbered_speaker(name: Column) -> Column:
    """Exactly ``Speaker`` and a capital."""
    return F.rlike(name, F.lit(r"^Speaker [A-Z]$"))
