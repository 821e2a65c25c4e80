"""Times, dates, courses, ids and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import _c, _t, stripped

TIME = r"^(?:(\d+):)?(\d{1,3}):(\d{2})$"


def parse_time(x: Column | str) -> Column:
    """Seconds of MM:SS (minutes of up to three digits) or H:MM:SS, else null."""
    t = _t(x)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, TIME, i), F.lit("")).cast("int"), F.lit(0))
    return F.when(t.rlike(TIME), part(1) * 3600 + part(2) * 60 + part(3))


def parse_time_loose(x: Column | str) -> Column:
    """parse_time, else of the first time within the text; a negative value has none."""
    t = F.coalesce(_c(x), F.lit(""))
    return F.when(t.rlike(r"^\s*-"), F.lit(None).cast("int")).otherwise(F.coalesce(parse_time(t), parse_time(F.regexp_extract(t, r"(\d{1,3}:\d{2}(?::\d{2})?)", 1))))


def sheet_duration(x: Column | str) -> Column:
    """A spreadsheet's MM:SS:00, which means minutes and seconds."""
    pattern = r"^(\d{1,3}):(\d{2}):00$"
    return F.when(_t(x).rlike(pattern), F.regexp_extract(_t(x), pattern, 1).cast("int") * 60 + F.regexp_extract(_t(x), pattern, 2).cast("int")).otherwise(parse_time(x))


def format_time(seconds: Column | str) -> Column:
    s = _c(seconds).cast("long")
    rest = F.concat(F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), rest)).otherwise(F.concat((F.floor(s / 60)).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))


def season_year(date: Column | str, sport: Column | str) -> Column:
    """The year of a date; November and December on skis belong to the next."""
    d = _c(date).cast("date")
    return F.year(d) + F.when((F.month(d) >= 11) & (F.coalesce(_c(sport), F.lit("")) == X.SKI), 1).otherwise(0)


def document_date(file_name: Column | str, text: Column | str) -> Column:
    """ergDDMMYY of the file name, else the first DD.MM.20YY within 500 characters."""
    by_name = r"(?i)erg(\d{2})(\d{2})(\d{2})(?!\d)"
    by_text = r"\b(\d{1,2})\.(\d{1,2})\.(20\d{2})\b"
    f, t = _t(file_name), F.substring(F.coalesce(_c(text), F.lit("")), 1, 500)
    a = F.when(f.rlike(by_name), F.concat_ws("-", F.concat(F.lit("20"), F.regexp_extract(f, by_name, 3)), F.regexp_extract(f, by_name, 2), F.regexp_extract(f, by_name, 1)))
    b = F.when(t.rlike(by_text), F.concat_ws("-", F.regexp_extract(t, by_text, 3), F.lpad(F.regexp_extract(t, by_text, 2), 2, "0"), F.lpad(F.regexp_extract(t, by_text, 1), 2, "0")))
    return F.coalesce(a, b)


def course_info(x: Column | str) -> Column:
    """struct(length_m, climb_m, controls) of '2,3 km 130 Hm 8 P'; metres are cut, not rounded."""
    t = _t(x)
    km = F.nullif(F.regexp_extract(t, r"^(?:([\d.,]+)\s*km)", 1), F.lit(""))
    climb = F.nullif(F.regexp_extract(t, r"^(?:[\d.,]+\s*km)?\s*(\d+)\s*Hm", 1), F.lit(""))
    controls = F.nullif(F.regexp_extract(t, r"(\d+)\s*P\b", 1), F.lit(""))
    return F.struct((F.replace(km, F.lit(","), F.lit(".")).try_cast("double") * 1000).cast("int").alias("length_m"), climb.cast("int").alias("climb_m"), controls.cast("int").alias("controls"))


def birth_year(two_digits: Column | str, pivot: int = X.BIRTH_YEAR_PIVOT) -> Column:
    y = _c(two_digits).cast("int")
    return F.when(y > 99, y).when(y <= pivot, 2000 + y).otherwise(1900 + y)


def clean_year(x: Column | str) -> Column:
    """A plausible birth year; 1900 and 1901 stand for unknown."""
    y = _c(x).try_cast("int")
    return F.when(y.between(1800, 2100) & ~y.isin(1900, 1901), y)


def name_and_year(x: Column | str) -> Column:
    """struct(name, year) of 'Name (1990)'."""
    pattern = r"^(.*?)\s+\((\d{4})\)$"
    t = _t(x)
    has = t.rlike(pattern)
    return F.struct(F.when(has, stripped(F.regexp_extract(t, pattern, 1))).otherwise(t).alias("name"), F.when(has, F.regexp_extract(t, pattern, 2).cast("int")).alias("year"))


def hash_id(prefix: str, *parts: Column | str) -> Column:
    """prefix and the first 24 hex digits of SHA-256 over the parts, NUL between them (null: empty)."""
    joined = F.concat_ws("\0", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 24))


def synthetic_id(key: Column | str, year: Column | str, salt: int = 0, space: str = "person-v1") -> Column:
    """A negative id of 62 bits from a name key and birth year, the same in every build."""
    text = F.concat_ws("\0", F.lit(space), _c(key), F.coalesce(_c(year).cast("string"), F.lit("")), F.lit(str(salt)))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (-(F.pmod(number, F.lit(1 << X.SYNTHETIC_ID_BITS)) + 1)).cast("long")


def user_id(x: Column | str) -> Column:
    return F.nullif(_t(x), F.lit("")).try_cast("long")


def content_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stage_id(event: Column | str, number: Column | str | None = None, mapped: bool = False) -> Column:
    """The synthetic stage id of an event, or of its numbered day."""
    if number is None:
        return _c(event) + X.EVENT_STAGE_BASE
    return _c(event) * 100 + _c(number) + (X.MAPPED_STAGE_BASE if mapped else X.DATED_STAGE_BASE)
