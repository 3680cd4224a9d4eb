"""Dates, formats and intervals.  An interval is a struct of months and microseconds: months have no fixed length."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format tokens and the pattern letters that read or write the same.
TOKENS = {
    "A.M.": "a", "P.M.": "a", "AM": "a", "PM": "a", "YYYY": "yyyy", "YY": "yy", "RR": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM",
    "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "E", "HH12": "hh", "HH24": "HH", "HH": "hh", "MI": "mm", "SS": "ss", "FF": "SSSSSS",
    "TZH:TZM": "XXX", "TZD": "z",
}


def date_format_to_spark(fmt: str, allow_rr: bool = True) -> str:
    """An Oracle or PostgreSQL date format as a Spark pattern: the longest token first, other letters quoted."""
    if "RR" in fmt.upper() and not allow_rr:
        raise ValueError("RR years are refused here")
    out, i = [], 0
    by_length = sorted(TOKENS, key=len, reverse=True)
    while i < len(fmt):
        hit = next((t for t in by_length if fmt[i : i + len(t)].upper() == t), None)
        if hit:
            out.append(TOKENS[hit])
            i += len(hit) + (1 if hit == "FF" and fmt[i + 2 : i + 3].isdigit() else 0)
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def date_format_column(fmt: Column) -> Column:
    """As date_format_to_spark for a column of formats: tokens, the longest first, become marks, what else is no separator is quoted, and marks
    become pattern letters.  A format with a quote mark gives null."""
    by_length = sorted(TOKENS, key=len, reverse=True)
    out = fmt
    for i, t in enumerate(by_length):
        out = F.regexp_replace(out, "(?i)" + re.escape(t) + ("[0-9]?" if t == "FF" else ""), chr(0xE000 + i))
    out = F.regexp_replace(out, "[^\ue000-\ue0ff0-9 ./,:;-]", "'$0'")
    for i, t in enumerate(by_length):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.lit(TOKENS[t]))
    return F.when(~fmt.contains("'"), out)


def parse_date_multi(col: Column, fmt: str) -> Column:
    """Text to timestamp under an Oracle or PostgreSQL format; month names in any case; RR years from 2050 on are of the century before;
    bad text gives null."""
    pattern = date_format_to_spark(fmt)
    text = F.lower(col) if "MMM" in pattern else col
    if "MMM" in pattern:
        for month in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"):
            text = F.regexp_replace(text, month, month.capitalize())
    at = F.try_to_timestamp(text, F.lit(pattern))
    return F.when(F.year(at) >= 2050, F.make_timestamp(F.year(at) - 100, F.month(at), F.dayofmonth(at), F.hour(at), F.minute(at), F.second(at))).otherwise(at) if "RR" in fmt.upper() else at


#: Microseconds of a unit, months of a unit.
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12, "DECADE": 120, "CENTURY": 1200, "MILLENNIUM": 12000}
COMPOUND = ["YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"]


def _interval(months: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), micros.cast("long").alias("micros"))


def parse_unit_interval(col: Column, unit: str) -> Column:
    """Number or compound text and a unit (``DAY``, ``DAY_SECOND``, ``HOUR TO MINUTE`` ...) to an interval; bad text gives null.

    A compound text gives the last units of its range when it has fewer numbers than units; its sign holds for all.
    """
    ends = re.split(r"_|\s+TO\s+", unit.strip().upper())
    text = F.trim(col.cast("string"))
    if len(ends) == 1:
        n = text.try_cast("decimal(28,6)")
        zero = F.lit(0)
        out = _interval(F.round(n * MONTHS[ends[0]]), zero) if ends[0] in MONTHS else _interval(zero, F.round(n * MICROS[ends[0]]))
        return F.when(n.isNotNull(), out)
    units = COMPOUND[COMPOUND.index(ends[0]) : COMPOUND.index(ends[1]) + 1]
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    missing = F.lit(len(units)) - F.size(numbers)
    part = lambda i: F.coalesce(F.get(numbers, F.lit(i) - missing).cast("long"), F.lit(0))
    months, micros = F.lit(0), F.lit(0).cast("long")
    for i, u in enumerate(units):
        if u in MONTHS:
            months = months + part(i) * MONTHS[u]
        else:
            micros = micros + part(i) * MICROS[u]
    return F.when((F.size(numbers) > 0) & (missing >= 0), _interval(sign * months, sign * micros))


def parse_interval_text(col: Column, mode: str = "VERBOSE") -> Column:
    """Interval text to an interval; text that does not fit the mode gives null.

    VERBOSE ``@ 1 year -3 days ago``; STANDARD ``1-2 3 4:05:06``; ISO ``P1Y2M3DT4H5M6S``.
    """
    text = F.trim(col)
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("decimal(20,6)"), F.lit(0))
    if mode == "VERBOSE":
        names = {"YEAR": "years?", "MONTH": "mons?|months?", "DAY": "days?", "HOUR": "hours?", "MINUTE": "mins?|minutes?", "SECOND": "secs?|seconds?"}
        got = {u: number(rf"(?i)(-?\d+)\s+(?:{p})\b") for u, p in names.items()}
        sign = F.when(text.rlike("(?i)ago\\s*$"), -1).otherwise(1)
        fits = text.rlike(r"(?i)^@?\s*(-?\d+\s+[a-z]+\s*)+(ago)?$")
    elif mode == "ISO":
        day, time = r"^[+-]?P[^T]*?", r"^[+-]?P.*T.*?"
        got = {"YEAR": number(day + r"(-?\d+)Y"), "MONTH": number(day + r"(-?\d+)M"), "DAY": number(day + r"(-?\d+)D"), "HOUR": number(time + r"(-?\d+)H"), "MINUTE": number(time + r"(-?\d+)M"), "SECOND": number(time + r"(-?\d+(?:\.\d+)?)S")}
        sign = F.when(text.startswith("-"), -1).otherwise(1)
        fits = text.rlike(r"^[+-]?P(?=.)(-?\d+Y)?(-?\d+M)?(-?\d+W)?(-?\d+D)?(T(-?\d+H)?(-?\d+M)?(-?\d+(\.\d+)?S)?)?$")
    else:
        ym, rest = r"^([+-]?\d+)-\d+(?:\s|$)", r"^(?:[+-]?\d+-\d+\s*)?"
        clock = rest + r"(?:[+-]?\d+(?:\s+|$))?"
        ym_sign = F.when(text.rlike(r"^-\d+-\d+"), -1).otherwise(1)
        at_sign = F.when(text.rlike(clock + r"-\d{1,2}:"), -1).otherwise(1)
        got = {
            "YEAR": number(ym), "MONTH": ym_sign * number(r"^[+-]?\d+-(\d+)(?:\s|$)"), "DAY": number(rest + r"([+-]?\d+)(?:\s|$)"),
            "HOUR": at_sign * number(clock + r"[+-]?(\d{1,2}):"), "MINUTE": at_sign * number(clock + r"[+-]?\d{1,2}:(\d{2})"), "SECOND": at_sign * number(clock + r"[+-]?\d{1,2}:\d{2}:(\d{2})"),
        }
        sign = F.lit(1)
        fits = text.rlike(r"^([+-]?\d+-\d+)?\s*([+-]?\d+(?![-:\d]))?\s*([+-]?\d{1,2}:\d{2}(:\d{2})?)?$") & (text != "")
    months = sign * (got["YEAR"] * 12 + got["MONTH"])
    micros = sign * (got["DAY"] * MICROS["DAY"] + got["HOUR"] * MICROS["HOUR"] + got["MINUTE"] * MICROS["MINUTE"] + got["SECOND"] * MICROS["SECOND"])
    return F.when(fits, _interval(months, micros))


def shift_by(at: Column, interval: Column) -> Column:
    """A timestamp moved by an interval: months first (the day clipped to the month), then microseconds."""
    months, micros = interval["months"], interval["micros"]
    moved = F.add_months(at, months).cast("timestamp")
    time_of_day = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.date_trunc("day", at.cast("timestamp")))
    return F.timestamp_micros(F.unix_micros(moved) + time_of_day + micros)


def time_text_to_seconds(col: Column) -> Column:
    """``[-]H:MM:SS`` with any number of hours to seconds."""
    text = F.trim(col)
    p = F.split(F.regexp_replace(text, "^-", ""), ":")
    seconds = F.get(p, F.lit(0)).try_cast("long") * 3600 + F.get(p, F.lit(1)).try_cast("long") * 60 + F.get(p, F.lit(2)).try_cast("long")
    return F.when(text.rlike(r"^-?\d+:\d{2}:\d{2}$"), F.when(text.startswith("-"), -seconds).otherwise(seconds))


def combine_units(units: Column, values: Column, sign: Column) -> Column:
    """Arrays of units (millisecond to millennium, any case) and values, summed to an interval."""
    table = F.create_map(*(x for u, m in MICROS.items() for x in (F.lit(u), F.struct(F.lit(0).cast("long").alias("months"), F.lit(m).cast("long").alias("micros")))), *(x for u, m in MONTHS.items() for x in (F.lit(u), F.struct(F.lit(m).cast("long").alias("months"), F.lit(0).cast("long").alias("micros")))))
    add = lambda field: F.aggregate(F.arrays_zip(units.alias("u"), values.alias("v")), F.lit(0).cast("long"), lambda acc, x: acc + x["v"].cast("long") * F.try_element_at(table, F.upper(x["u"]))[field])
    return _interval(sign * add("months"), sign * add("micros"))
