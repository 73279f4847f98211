"""Written times in many forms and zones, normalised to UTC instants.

The text is parsed with a few anchored patterns into calendar parts. A time that carries its own offset is
shifted by it. A local time is matched as-of against the zone's offset intervals, expressed in local time and
exploded to one row per zone and year that occurs: two intervals that hold it mean an ambiguous time, none a nonexistent
one, exactly one gives the offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmere.session import sized, stage

# English month names, and zone abbreviations with their fixed offset in minutes.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
}

DAY_US = 86_400_000_000
#: Up to so many pairs of zone and year are broadcast.
ZONE_YEARS = 100_000

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?: ?([AaPp][Mm]))?"
_ZONE = r" ?([+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?(?: ?\[([A-Za-z0-9_/+-]+)\])?"
_WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*,? )?"
# Each pattern is rewritten to year|month|day|hour|minute|second|fraction|half|zone|region.
_FORMS = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ](\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,12}}))?)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:[Tt ]{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:[Tt ]{_CLOCK}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_WEEKDAY}(\d{{1,2}}) ([A-Za-z]{{3,9}})\.? (\d{{4}})(?: {_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_WEEKDAY}([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}})(?:,? {_CLOCK}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
]


def _number(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def parse_written_time(text: Column) -> Column:
    """Struct (epoch_us, local_us, offset_min, region, has_clock) of a written time.

    ``epoch_us`` is set for plain epoch numbers, ``local_us`` for calendar times that exist; ``offset_min`` for
    an explicit offset or abbreviation, ``region`` for a named zone. All are null for text that is no time.
    """
    s = F.regexp_replace(text, r"^[\s\p{Z}\"'“”‘’`]+|[\s\p{Z}\"'“”‘’`]+$", "")
    whole = F.regexp_extract(s, r"^(\d+)(?:[.,]\d+)?$", 1)
    part = F.regexp_extract(s, r"^\d+[.,](\d+)$", 1)
    micros = F.rpad(F.substring(part, 1, 6), 6, "0").try_cast("long")
    long_ = whole.try_cast("long")
    epoch = (
        F.when((F.length(whole) == 10) & (part == ""), long_ * 1_000_000)
        .when(F.length(whole) == 10, long_ * 1_000_000 + micros)
        .when((F.length(whole) == 13) & (part == ""), long_ * 1000)
        .when((F.length(whole) == 16) & (part == ""), long_)
    )
    parts = s
    for pattern, order in _FORMS:
        parts = F.regexp_replace(parts, pattern, order)
    p = F.split(F.when(F.length(s) <= 100, parts), r"\|")
    return F.struct(epoch.alias("epoch_us"), p.alias("p"))


def _calendar(p: Column) -> dict[str, Column]:
    """Columns of the split parts; null where they form no real time."""
    at = lambda i: F.try_element_at(p, F.lit(i))
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for k in dict.fromkeys((m, m[:3], m[:4])) for x in (k, i)])
    month = F.when(at(2).rlike(r"^\d+$"), at(2).try_cast("int")).otherwise(F.try_element_at(names, F.lower(at(2))))
    date = F.format_string("%04d-%02d-%02d", _number(at(1)), month, _number(at(3))).try_cast("date")
    date = F.when(F.size(p) == 10, F.when(_number(at(1)).between(1, 9999) & month.isNotNull(), date))
    hour, minute, second = _number(at(4)), _number(at(5)), F.coalesce(_number(at(6)), F.lit(0))
    half = F.lower(at(8))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    fraction = F.rpad(F.substring(at(7), 1, 6), 6, "0").try_cast("long")
    clock = F.when(
        hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59),
        ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000 + fraction,
    )
    dated = at(4) == ""
    local = F.unix_date(date).cast("long") * DAY_US + F.when(dated, F.lit(0).cast("long")).otherwise(clock)
    zone, region = at(9), at(10)
    digits = F.regexp_replace(F.substring(zone, 2, 10), ":", "")
    oh, om = _number(F.substring(digits, 1, 2)), F.coalesce(_number(F.substring(digits, 3, 2)), F.lit(0))
    signed = F.when((oh <= 18) & (om < 60), (oh * 60 + om) * F.when(zone.startswith("-"), -1).otherwise(1))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    known = F.try_element_at(table, F.upper(zone))
    offset = F.when(dated, F.lit(0)).when(zone.rlike(r"^[+-]"), signed).otherwise(known)
    named = F.when(zone.contains("/"), zone).when((zone == "") & (region != ""), region)
    bad = (zone != "") & offset.isNull() & named.isNull()
    return {"local_us": F.when(~bad, local), "offset_min": offset, "region": named, "has_clock": ~dated}


def _zone_years(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each zone name and year the intervals of constant offset, with local bounds in microseconds."""
    from zoneinfo import ZoneInfo, available_timezones

    if not available_timezones():
        raise RuntimeError("this worker has no zone database")
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    us = lambda t: (t - epoch) // timedelta(microseconds=1)
    day = timedelta(days=1)
    for batch in batches:
        rows = []
        for name, year in zip(batch["zone"], batch["year"]):
            try:
                z = ZoneInfo(name)
            except (KeyError, ValueError, OSError):  # no such zone
                continue
            off = lambda t, z=z: t.astimezone(z).utcoffset()
            t = datetime(max(year - 1, 1), 12, 28, tzinfo=timezone.utc) if year > 1 else datetime(1, 1, 3, tzinfo=timezone.utc)
            end = datetime(year + 1, 1, 5, tzinfo=timezone.utc) if year < 9999 else datetime(9999, 12, 29, tzinfo=timezone.utc)
            spans, start, now = [], None, off(t)
            while t < end:
                if (then := off(t + day)) != now:
                    lo, hi = t, t + day
                    while hi - lo > timedelta(seconds=1):
                        mid = (lo + (hi - lo) / 2).replace(microsecond=0)
                        lo, hi = (mid, hi) if off(mid) == now else (lo, mid)
                    spans.append((start, hi, now))
                    start, now = hi, then
                t += day
            local = []
            for a, b, o in [*spans, (start, None, now)]:
                shift = o // timedelta(microseconds=1)
                local.append({"lo": -(2**62) if a is None else us(a) + shift, "hi": 2**62 if b is None else us(b) + shift, "off": shift})
            rows.append((name, year, local))
        yield pd.DataFrame(rows, columns=["zone", "year", "spans"])


def zone_intervals(zone_years: DataFrame) -> DataFrame:
    """(zone, year, spans<lo, hi, off>) for the valid names in ``zone_years`` (zone, year), each pair once.

    Only the years that occur are worked out, so no year is too early or too late. A worker without a zone
    database is an error, an unknown name gives no row.
    """
    return zone_years.select("zone", "year").distinct().mapInPandas(_zone_years, "zone string, year int, spans array<struct<lo:long,hi:long,off:long>>")


def epoch_seconds(text: Column) -> Column:
    """The instant of a written time in seconds since 1970; UTC where it names no zone, null if it is no time.

    For headers of pages, which have no actor. A named region is not looked up and gives null.
    """
    t = parse_written_time(text)
    c = _calendar(t["p"])
    local = F.when(c["region"].isNull(), c["local_us"] - F.coalesce(c["offset_min"].cast("long"), F.lit(0).cast("long")) * 60_000_000)
    return F.coalesce(t["epoch_us"], local) / 1_000_000


def normalise_times(items: DataFrame, actors: DataFrame, key: str = "item_seq", fields: tuple[str, ...] = ("authored", "freshness")) -> DataFrame:
    """One row (key, field, written, utc_us, status) for each non-null written time of ``fields``.

    status: 'offset' (own offset, abbreviation, epoch number or date), 'zone' (one interval holds it),
    'ambiguous' (two: the first is taken), 'nonexistent' (none: the offset before the gap), 'utc' (neither the
    text nor the actor has a known zone), 'invalid' (utc_us is null). A time without zone takes the actor's home
    zone, else UTC; an unknown zone written in the text makes it invalid. Of several rows of one actor the smallest zone counts.
    Nulls give no row, empty texts are invalid, repeated rows come out as often as they go in, other columns
    are ignored, empty tables give an empty result.
    """
    home = actors.filter(F.col("write_actor").isNotNull()).groupBy("write_actor").agg(F.min("home_zone").alias("home_zone"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("written")) for f in fields]))
    rows = items.select(F.col(key).alias("key"), "write_actor", cells.alias("c")).select("key", "write_actor", "c.*").filter("written is not null")
    rows = rows.withColumn("t", parse_written_time(F.col("written"))).select("*", "t.epoch_us", "t.p").drop("t")
    rows = rows.withColumns(_calendar(F.col("p"))).drop("p")
    rows = rows.join(home, "write_actor", "left").withColumn(
        "zone", F.when(F.col("local_us").isNotNull() & F.col("epoch_us").isNull() & F.col("offset_min").isNull(), F.coalesce("region", "home_zone"))
    )
    rows = stage(rows.select("key", "field", "written", "epoch_us", "local_us", "offset_min", "region", "zone"))
    year = F.year(F.date_from_unix_date(F.floor(F.col("local_us") / DAY_US).cast("int")))
    rows = rows.withColumn("year", F.when(F.col("zone").isNotNull(), year))
    # One row for each zone and year that occurs, whatever the number of items.
    spans = sized(stage(zone_intervals(rows.filter("zone is not null"))), ZONE_YEARS)
    rows = rows.join(spans, ["zone", "year"], "left")
    held = F.filter("spans", lambda s: (s.lo <= F.col("local_us")) & (F.col("local_us") < s.hi))
    before = F.array_max(F.transform(F.filter("spans", lambda s: s.hi <= F.col("local_us")), lambda s: F.struct(s.hi, s.off)))
    rows = rows.withColumn("held", held)
    shift = F.when(F.size("held") > 0, F.array_max(F.transform("held", lambda s: s.off))).otherwise(before["off"])
    lost = F.col("spans").isNull() & F.col("region").isNotNull()
    status = (
        F.when(F.col("epoch_us").isNotNull(), "offset")
        .when(F.col("local_us").isNull(), "invalid")
        .when(F.col("offset_min").isNotNull(), "offset")
        .when(F.col("spans").isNull(), F.when(lost, "invalid").otherwise("utc"))
        .when(F.size("held") == 0, "nonexistent")
        .when(F.size("held") == 1, "zone")
        .otherwise("ambiguous")
    )
    utc = F.coalesce(
        F.col("epoch_us"),
        F.when(lost & F.col("offset_min").isNull(), None).otherwise(
            F.col("local_us") - F.coalesce(F.col("offset_min").cast("long") * 60_000_000, shift, F.lit(0).cast("long"))
        ),
    )
    return rows.select(F.col("key").alias(key), "field", "written", utc.alias("utc_us"), status.alias("status"))
