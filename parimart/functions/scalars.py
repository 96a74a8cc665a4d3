"""Scalar functions: parsing, labels, decoders and small derived values, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Upper bounds of distance bands in metres.
DISTANCE_BANDS = ((1400, "sprint"), (1800, "mile"), (2200, "intermediate"))


def parse_time(text: Column) -> Column:
    """ISO, yyyyMMddHHmmss or yyyyMMdd text as a timestamp without zone; null if it is none of these."""
    iso = F.expr("try_cast(null as timestamp_ntz)")
    iso = text.try_cast("timestamp_ntz")
    long = F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))
    short = F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    return F.coalesce(long, short, F.when(~text.rlike("^[0-9]*$"), iso))


def parse_as_of(text: Column, now: Column) -> Column:
    """Decision time in UTC: text without zone is Japanese time, text that can't be read is ``now``."""
    zoned = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    local = F.to_utc_timestamp(parse_time(text).cast("timestamp"), "Asia/Tokyo")
    return F.coalesce(F.when(zoned, text.try_cast("timestamp")).otherwise(local), now)


def jst_to_utc(day: Column, hhmm: Column) -> Column:
    """A date and an hhmm clock of Japan as UTC; null for a clock that isn't one."""
    ok = hhmm.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$")
    at = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.substring(hhmm, 1, 2).try_cast("int") - 9, mins=F.substring(hhmm, 3, 2).try_cast("int"))
    return F.when(ok, at)


def iso_utc(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_week(day: Column) -> Column:
    """``YYYY-Www`` of the ISO week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


@F.pandas_udf(StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """NFKC without white space; null for what is empty then. Spark has no built-in Unicode normalisation."""
    return names.map(lambda s: "".join(unicodedata.normalize("NFKC", s).split()) or None, na_action="ignore")


def banded(value: Column, bands: tuple[tuple[float, str], ...] = DISTANCE_BANDS, last: str = "staying") -> Column:
    """Label of the first band whose bound the value is below; null for null."""
    out = None
    for bound, label in bands:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return F.when(value.isNotNull(), out.otherwise(last))


def style_signal(position: Column, closing_rank: Column, field: Column) -> Column:
    """Running-style proxy from the finish and the closing-speed rank."""
    fast = closing_rank <= F.when(field <= 5, 2).otherwise(3)
    return (
        F.when(position.isNull() | (position <= 0), None)
        .when(closing_rank.isNull(), "unknown")
        .when(fast, F.when(position <= 3, "presser").otherwise("deep_closer"))
        .when(position <= 2, "speed")
        .otherwise("pace_following")
    )


def labelled(code: Column, labels: Mapping[str, str]) -> Column:
    """Label of a code; null for others."""
    out = None
    for k, v in labels.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out


def digits_scaled(text: Column, scale: float, zero_is_null: bool = True) -> Column:
    """A number written without its decimal point, such as odds in tenths; not digits, or all zeros, is null."""
    value = F.when(text.rlike("^[0-9]+$"), text.try_cast("long") / F.lit(float(scale)))
    return F.nullif(value, F.lit(0.0)) if zero_is_null else value


def clock_seconds(text: Column) -> Column:
    """Race time written as one digit of minutes, two of seconds and one of tenths."""
    ok = text.rlike("^[0-9]{4}$") & (text != "0000") & (text != "9999")
    part = lambda a, n: F.substring(text, a, n).try_cast("int")
    return F.when(ok, part(1, 1) * 60 + part(2, 2) + part(4, 1) / 10.0)


def id_part(key: Column, sep: str, k: int) -> Column:
    return F.try_element_at(F.split(key, sep), F.lit(k))


def implied(odds: Column) -> Column:
    return F.when(odds > 0, 1.0 / odds)


def logit(p: Column, bound: float = 10.0) -> Column:
    """ln(p / (1 - p)) within ``bound``; the ends at 0 and 1."""
    inner = F.ln(F.greatest(p, F.lit(1e-300)) / F.greatest(1.0 - p, F.lit(1e-300)))
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), inner))


def latest_source(*times: Column) -> Column:
    """The latest of nullable times, 1900 if all are null."""
    floor = F.lit("1900-01-01").cast("timestamp_ntz")
    return F.greatest(floor, *[F.coalesce(t.cast("timestamp_ntz"), floor) for t in times])


def clean_odds(text: Column) -> Column:
    """Finite odds of 1 at least, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (x >= 1) & (x < float("inf")), x)


def crosswalk_id(key: Column, venues: Mapping[str, str]) -> Column:
    """Feed id ``yyyymmdd-venue-rr`` to the canonical ``yyyymmdd-code-rr``; canonical ids pass, others are null."""
    parts = F.split(key, "-")
    code = labelled(F.try_element_at(parts, F.lit(2)), venues)
    known = F.try_element_at(parts, F.lit(2)).rlike("^[0-9]{2}$")
    day, race = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(3))
    fine = (F.size(parts) == 3) & day.rlike("^[0-9]{8}$") & race.rlike("^[0-9]{1,2}$")
    return F.when(fine & known, F.concat_ws("-", day, F.try_element_at(parts, F.lit(2)), F.lpad(race, 2, "0"))).when(
        fine & code.isNotNull(), F.concat_ws("-", day, code, F.lpad(race, 2, "0"))
    )


def half_even(value: Column, places: int = 0) -> Column:
    """Rounded to even on ties, as settled amounts are."""
    return F.bround(value, places)


def canonical_grade(text: Column) -> Column:
    """``G1`` to ``G3`` of a display label in any width, with digits or Roman numerals; null for all others."""
    folded = F.upper(normalize_name(text))
    return labelled(folded, {"G1": "G1", "GI": "G1", "G2": "G2", "GII": "G2", "G3": "G3", "GIII": "G3"})


#: Converters of raw text by kind of field, to be looked up by a layout.
CONVERTERS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: F.nullif(F.trim(c), F.lit("")),
    "whole": lambda c: F.trim(c).try_cast("long"),
    "tenths": lambda c: digits_scaled(c, 10),
    "clock": clock_seconds,
    "odds": clean_odds,
    "time": parse_time,
}


def converted(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Columns of ``df`` converted by their kind; other columns stay."""
    return df.withColumns({c: CONVERTERS[k](F.col(c)) for c, k in kinds.items()})
