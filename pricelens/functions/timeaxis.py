"""Kick-off, decision and result instants; the local clock is London's."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Europe/London"


def local_to_utc(local: Column) -> Column:
    """UTC instant of a London wall time; of two instants or none in the clock change, the later one."""
    first = F.to_utc_timestamp(local, ZONE)
    later = first + F.expr("interval 1 hour")
    return F.when(F.from_utc_timestamp(later, ZONE) == local, later).otherwise(first)


def nearest_second(at: Column) -> Column:
    """An instant as the nearest second since 1970, half to even, as SQL's cast of a fraction gives it."""
    return F.bround(F.unix_micros(at) / 1e6).cast("long")


def at_hour(day: Column, hour: int) -> Column:
    return day.cast("timestamp") + F.expr(f"interval {hour} hours")


def decision_day(day: Column) -> Column:
    """Friday to Monday: that or the previous Friday; Tuesday to Thursday: that week's Tuesday."""
    w = F.weekday(day)
    return F.when((w >= 1) & (w <= 3), F.date_sub(day, w - 1)).otherwise(F.date_sub(day, F.pmod(w - 4, F.lit(7)).cast("int")))


def decision_at(day: Column, kickoff: Column) -> Column:
    """Noon in London of the decision day; null if that isn't before the kick-off."""
    at = local_to_utc(at_hour(decision_day(day), 12))
    return F.when(kickoff.isNull() | (at < kickoff), at)


def result_known_at(day: Column, kickoff: Column) -> Column:
    return F.coalesce(kickoff + F.expr("interval 3 hours"), local_to_utc(at_hour(F.date_add(day, 1), 3)))


def period(day: Column, dev_end: str, holdout_end: str) -> Column:
    return F.when(day < F.lit(dev_end).cast("date"), "dev").when(day < F.lit(holdout_end).cast("date"), "holdout").otherwise("post")


def window(at: Column, start: str, end: str, limit: str) -> Column:
    """Predicate [start, end); the window must not be empty or reach past ``limit``."""
    if not start < end:
        raise ValueError("the window is empty")
    if end > limit:
        raise ValueError("the window reaches past its limit")
    return (at >= F.lit(start).cast("date")) & (at < F.lit(end).cast("date"))


def season(day: Column) -> Column:
    """Season code yyYY with a rollover in July."""
    y = F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    return F.concat(two(y), two(y + 1))


def fit_day(day: Column, cadence: int) -> Column:
    """Fit days lie on a fixed calendar."""
    return F.date_sub(day, F.pmod(F.datediff(day, F.lit("2000-01-03").cast("date")), F.lit(cadence)).cast("int"))


def closing(commence: Column, now: Column, minutes: int = 20) -> Column:
    left = F.unix_timestamp(commence) - F.unix_timestamp(now)
    return left.between(0, minutes * 60)


def before_kickoff(observed: Column, kickoff: Column, is_closing: Column) -> Column:
    """Quotes from before the kick-off; a closing quote may lie at that very instant."""
    return (observed < kickoff) | (is_closing & (observed == kickoff))


#: Days on which the periods and zones begin and end (excluded): selection, evaluation, holdout; a rehearsal plays its
#: holdout within the evaluation zone.
ZONES = {"S": (date(1996, 1, 1), date(1997, 7, 1)), "E": (date(1997, 7, 1), date(2000, 7, 1)), "holdout": (date(2000, 7, 1), date(2001, 1, 1)), "post": (date(2001, 1, 1), date(2100, 1, 1))}
REHEARSAL = (date(2000, 1, 1), date(2000, 7, 1))


def zone_rows(zoning: str = "final", holdout: tuple[date, date] = REHEARSAL) -> list[tuple[str, date, date]]:
    """(zone, first day, last day) of a zoning: ``development`` has S and E, ``final`` the holdout and what follows too,
    ``rehearsal`` the development zones but for a part of them that plays the holdout."""
    names = {"development": ("S", "E"), "final": tuple(ZONES), "rehearsal": ("S", "E")}
    if zoning not in names:
        raise ValueError(f"unknown zoning {zoning}")
    spans = [(z, *ZONES[z]) for z in names[zoning]]
    if zoning == "rehearsal":
        a, b = holdout
        if not ZONES["S"][0] <= a < b <= ZONES["E"][1]:
            raise ValueError("a rehearsal lies within the development zones")
        spans = [(z, *cut) for z, x, y in spans for cut in ((x, min(y, a)), (max(x, b), y)) if cut[0] < cut[1]] + [("holdout", a, b)]
    return [(z, x, y - timedelta(days=1)) for z, x, y in spans]


def zones(spark: SparkSession, zoning: str = "final", holdout: tuple[date, date] = REHEARSAL) -> DataFrame:
    """``zone_rows`` as a table of a few rows, for an interval join."""
    return spark.createDataFrame(zone_rows(zoning, holdout), "zone string, first_day date, last_day date")
