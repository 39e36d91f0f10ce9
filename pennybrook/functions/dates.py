"""Dates and times of statements: wall clocks of UTC+8 in, UTC instants stored, the real zone for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, nfkc, text, trim_all

OFFSET_MINUTES = 480
ZONE = "Asia/Shanghai"


def wall_clock(c: Column, fold=nfkc) -> Column:
    """Struct y, mo, d, hh, mi, ss of a printed date, or null: 8, 12 or 14 bare digits, else the first groups of digits."""
    parts = lambda s: F.struct(F.regexp_replace(s, r"\D", "").alias("digits"), F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)).alias("groups"), (~s.rlike("[-/年月]")).alias("bare"))
    return let(let(trim_all(fold(text(c))), parts), _clock)  # folding stays outside the lambdas, as it may be a Python function


def _clock(x: Column) -> Column:
    digits, groups = x["digits"], x["groups"]
    compact = x["bare"] & F.length(digits).isin(8, 12, 14)
    n = F.size(groups)

    def part(at: int, size: int, group: int, least_digits: int, least_groups: int) -> Column:
        packed = F.when(F.length(digits) >= least_digits, F.substring(digits, at, size)).otherwise("0")
        loose = F.when(n >= least_groups, F.get(groups, F.lit(group))).otherwise("0")
        return let(F.regexp_replace(F.when(compact, packed).otherwise(loose), "^0+(?=.)", ""), lambda v: F.when(F.length(v) <= 9, v.try_cast("int")))

    made = F.struct(part(1, 4, 0, 8, 3).alias("y"), part(5, 2, 1, 8, 3).alias("mo"), part(7, 2, 2, 8, 3).alias("d"), part(9, 2, 3, 12, 5).alias("hh"), part(11, 2, 4, 12, 5).alias("mi"), part(13, 2, 5, 14, 6).alias("ss"))
    fine = lambda w: w["y"].between(1900, 2200) & w["mo"].between(1, 12) & w["d"].between(1, 31) & w["hh"].between(0, 23) & w["mi"].between(0, 59) & w["ss"].between(0, 59)
    return F.when(compact | (n >= 3), let(made, lambda w: F.when(fine(w), w)))


def to_instant(c: Column, offset_minutes: int = OFFSET_MINUTES, fold=nfkc) -> Column:
    """The UTC instant of a printed time; dates that don't exist are null, an instant with a zone is taken as it is."""
    zone = f"{'+' if offset_minutes >= 0 else '-'}{abs(offset_minutes) // 60:02d}:{abs(offset_minutes) % 60:02d}"
    made = lambda w: F.try_make_timestamp(w["y"], w["mo"], w["d"], w["hh"], w["mi"], w["ss"].cast("decimal(8,6)"), F.lit(zone))
    printed = let(wall_clock(c, fold), made)
    raw = trim_all(text(c))
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(raw)).otherwise(printed)


def combine_date_time(date: Column, time: Column) -> Column:
    d, t = trim_all(text(date)), trim_all(text(time))
    return F.when((t == "") | d.rlike(r"\d{1,2}:\d{2}"), d).when(d == "", t).otherwise(F.concat(d, F.lit(" "), t))


def epoch_seconds(ts: Column) -> Column:
    return F.coalesce(F.unix_seconds(ts), F.lit(0).cast("long"))


def bucket_seconds(epoch: Column, minutes: int = 2) -> Column:
    """Start of the tumbling bucket that an epoch second lies in."""
    size = max(1, minutes) * 60
    return epoch - F.pmod(epoch, F.lit(size))


def local_text(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm in the real local zone, whatever the session's zone."""
    return F.date_format(F.from_utc_timestamp(_utc(ts), ZONE), "yyyy-MM-dd HH:mm")


def local_month(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(_utc(ts), ZONE), "yyyy-MM")


def local_day_start(ts: Column) -> Column:
    """The UTC instant of local midnight, at the fixed offset."""
    e = F.unix_seconds(ts) + OFFSET_MINUTES * 60
    return F.timestamp_seconds(e - F.pmod(e, F.lit(86_400)) - OFFSET_MINUTES * 60)


def _utc(ts: Column) -> Column:
    """A timestamp that the session prints as the instant's UTC wall clock."""
    return F.to_utc_timestamp(ts, F.current_timezone())
