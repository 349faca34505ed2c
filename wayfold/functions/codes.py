"""Codes of feeds and requests as texts, days and flags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .street import CROSSING, ELEVATOR, SIGNAL

#: What alert codes and route types mean, from 1 and 0 on; and how heavy a mode's burden is.
CAUSES = "UNKNOWN_CAUSE OTHER_CAUSE TECHNICAL_PROBLEM STRIKE DEMONSTRATION ACCIDENT HOLIDAY WEATHER MAINTENANCE CONSTRUCTION POLICE_ACTIVITY MEDICAL_EMERGENCY SPECIAL_EVENT".split()
EFFECTS = "NO_SERVICE REDUCED_SERVICE SIGNIFICANT_DELAYS DETOUR ADDITIONAL_SERVICE MODIFIED_SERVICE OTHER_EFFECT UNKNOWN_EFFECT STOP_MOVED NO_EFFECT ACCESSIBILITY_ISSUE".split()
ROUTE_TYPES = {0: "Tramway", 1: "Subway", 2: "Rail", 3: "Bus", 4: "Ferry", 5: "CableCar", 6: "Gondola", 7: "Funicular", 200: "Coach", 1100: "Air", 1500: "Taxi"}
BURDEN = {"walk": 0, "bike": 1, "car": 2}
ZONE = "Europe/Brussels"


def _listed(values: list[str], code: Column, other: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, values)), code.cast("int") - 1), F.lit(other))


def cause(code: Column) -> Column:
    return _listed(CAUSES, code, "UNKNOWN_CAUSE")


def effect(code: Column) -> Column:
    return _listed(EFFECTS, code, "UNKNOWN_EFFECT")


def route_type(code: Column) -> Column:
    return F.coalesce(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ROUTE_TYPES.items()))[code.cast("int")], F.lit("Other"))


def burden(mode: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in BURDEN.items()))[mode]


def node_flags(highway: Column, crossing: Column) -> Column:
    """Variance flags of a street node from its tags."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    signal = yes(highway == "traffic_signals") | yes(crossing == "traffic_signals")
    return F.when(signal, SIGNAL).otherwise(0) + F.when(yes(crossing.isin("uncontrolled", "unmarked")), CROSSING).otherwise(0) + F.when(yes(highway == "elevator"), ELEVATOR).otherwise(0)


def service_day(unix: Column) -> Column:
    """Days from 2000-01-01 to the local day of a moment."""
    return F.datediff(F.to_date(F.from_utc_timestamp(F.timestamp_seconds(unix), ZONE)), F.lit("2000-01-01"))


def query_day(date: Column) -> Column:
    """Days from 2000-01-01 of an ISO date; null where it isn't one."""
    return F.datediff(F.try_to_date(F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), date), "yyyy-MM-dd"), F.lit("2000-01-01"))


def query_seconds(time: Column) -> Column:
    """Seconds of HH:MM:SS or HH:MM; null where it is neither."""
    part = lambda i: F.coalesce(F.expr("0").cast("int") + F.when(F.regexp_extract(time, _TIME, i) != "", F.regexp_extract(time, _TIME, i).cast("int")), F.lit(0))
    return F.when(time.rlike(_TIME), part(1) * 3600 + part(2) * 60 + part(3))


_TIME = "^([01]?[0-9]|2[0-3]):([0-5]?[0-9])(?::([0-5]?[0-9]))?$"


def shifted(seconds: Column, shift: Column) -> Column:
    """A displayed time moved back by a signed offset, not below 0."""
    return F.greatest(seconds - shift, F.lit(0))


def output_cents(known: Column, rail: Column, cap: Column) -> Column:
    """What a plan costs when its rail part is capped; no cap is null."""
    return known - rail + F.least(rail, F.coalesce(cap, rail))


def airport_cents(known: Column, rail: Column, fixed: Column) -> Column:
    """A fixed price in place of what was spent on rail; 0 is none."""
    return F.when(fixed > 0, F.greatest(known - rail, F.lit(0)) + fixed).otherwise(known)
