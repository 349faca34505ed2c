"""Fares in whole cents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bracketed:
    """A rate a kilometre, a base, a floor, and kilometres in brackets of 3 from 31 and of 5 from 61."""

    rate: float = 15.0
    base: float = 90.0
    floor: int = 260
    least_km: int = 3
    cap_from_km: int = 116
    cap_km: int = 118
    first_up_to: tuple[int, int] = (10, 30)
    first_rate: tuple[float, float, float] = (1.3, 1.4, 1.5)
    grid_up_to: tuple[int, int] = (1000, 2000)
    grids: tuple[int, int, int] = (10, 20, 50)


@dataclass(frozen=True)
class TimeRules:
    """Peak windows are half-open; the third is none."""

    peaks: tuple[tuple[int, int], ...] = ((21600, 32400), (54000, 64800))
    weekend_discount: float = 0.3
    card_discount: float = 0.4
    card_peak_cap: int = 1500


def bracket_km(km: Column, t: Bracketed) -> Column:
    d = F.greatest(F.floor(F.greatest(km, F.lit(0)) + 0.5).cast("int"), F.lit(t.least_km))
    three, five = 3 * F.floor((d - 31) / 3) + 32, 5 * F.floor((d - 61) / 5) + 63
    return F.when(d >= t.cap_from_km, t.cap_km).when(d <= 30, d).when(d <= 60, three).when(d <= 115, five).otherwise(d).cast("int")


def bracketed_cents(km: Column, t: Bracketed, first_class: bool = False) -> Column:
    d = bracket_km(km, t)
    raw = F.greatest(d * t.rate + t.base, F.lit(float(t.floor)))
    if not first_class:
        return (F.floor((raw + 5) / 10) * 10).cast("int")
    cents = raw * F.when(d <= t.first_up_to[0], t.first_rate[0]).when(d <= t.first_up_to[1], t.first_rate[1]).otherwise(t.first_rate[2])
    grid = F.when(cents < t.grid_up_to[0], t.grids[0]).when(cents <= t.grid_up_to[1], t.grids[1]).otherwise(t.grids[2])
    return (F.floor((cents + grid / 2) / grid) * grid).cast("int")


def tariff_km(km: Column, least: int, most: int) -> Column:
    r = F.floor(F.greatest(km, F.lit(0)) + 0.5).cast("int")
    return F.when(r + 2 >= most, most).otherwise(F.greatest(r, F.lit(least)))


def linear_cents(km: Column, base: float, rate: float, least: int, most: int, floor: int) -> Column:
    return F.greatest(F.floor(base + rate * tariff_km(km, least, most) + 0.5).cast("int"), F.lit(floor))


def band_cents(km: Column, rate: float, up_to: tuple[int, int], factors: tuple[float, float, float], least: int, most: int, floor: int) -> Column:
    k = tariff_km(km, least, most)
    factor = F.when(k <= up_to[0], factors[0]).when(k <= up_to[1], factors[1]).otherwise(factors[2])
    return F.greatest(F.floor(rate * factor * k + 0.5).cast("int"), F.lit(floor))


def time_bucket(weekday: Column, seconds: Column, rules: TimeRules) -> Column:
    peak = F.lit(False)
    for a, b in rules.peaks:
        peak = peak | ((seconds >= a) & (seconds < b))
    return F.when(weekday >= 5, "weekend").when(peak, "peak").otherwise("offpeak")


def scale(bucket: Column, rules: TimeRules, card: bool) -> Column:
    return F.when(bucket == "peak", 1.0).otherwise(1 - rules.card_discount) if card else F.when(bucket == "weekend", 1 - rules.weekend_discount).otherwise(1.0)


def cap(bucket: Column, rules: TimeRules, card: bool) -> Column:
    return F.when(bucket == "peak", rules.card_peak_cap) if card else F.lit(None).cast("int")


def tier(cents: Column, width: Column) -> Column:
    return F.when(width <= 0, cents).otherwise(F.floor(cents / width) * width)
