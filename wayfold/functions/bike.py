"""Riding: speeds from power, corners, buffers of climbing, and choices among options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gravity, density of air.
GRAVITY, AIR = 9.81, 1.225


@dataclass(frozen=True)
class Rider:
    """Kilograms, watts, kilometres an hour, metres a second and a second squared."""

    mass: float = 90.0
    power: float = 100.0
    top_kmh: float = 36.0
    drag: float = 0.55
    rolling: float = 0.006
    brake: float = 2.5
    accelerate: float = 1.0
    lateral: float = 3.5
    lateral_on_paths: float = 8.0
    corner_m: float = 10.0
    push: float = 0.9
    push_on_steps: float = 0.25
    up_cutoff: float = 1.5
    down_cutoff: float = 0.5
    buffer: float = 5.0
    most_buffer: float = 10.0
    down_cost: float = 100.0
    up_cost: float = 0.0


def cruise_speed(length: Column, climb: Column, rider: Rider = Rider()) -> Column:
    """The speed that the rider's power holds on a slope: forty halvings of the interval up to the top speed, half a metre a second at least."""
    slope = F.when(length > 0, F.atan(climb / length)).otherwise(F.lit(0.0))
    linear = rider.mass * GRAVITY * (rider.rolling * F.cos(slope) + F.sin(slope))
    need = lambda v: linear * v + 0.5 * AIR * rider.drag * v * v * v
    top = F.lit(rider.top_kmh / 3.6)
    zero = F.struct(F.lit(0.01).alias("lo"), top.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        low = need(middle) < rider.power
        return F.struct(F.when(low, middle).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(40)), zero, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.greatest(F.when(need(top) <= rider.power, top).otherwise(found), F.lit(0.5))


def corner_speed(cruise: Column, turn: Column, shorter: Column, on_path: Column, rider: Rider = Rider()) -> Column:
    """The speed at which an edge is entered: what the lateral pull allows in a bend of this turn (radians) between edges of which the shorter is so long."""
    pull = F.when(on_path, rider.lateral_on_paths).otherwise(rider.lateral)
    radius = F.greatest(shorter, F.lit(rider.corner_m)) / turn
    return F.when((turn <= 1e-6) | (shorter <= 0), cruise).otherwise(F.least(F.sqrt(pull * radius), cruise))


def speed_change_seconds(carried: Column, required: Column, rider: Rider = Rider()) -> Column:
    return F.when(required < carried, (carried - required) / rider.brake).otherwise((required - carried) / rider.accelerate)


def edge_seconds(length: Column, climb: Column, pushed: Column, on_steps: Column, rider: Rider = Rider()) -> Column:
    speed = F.when(pushed, F.when(on_steps, rider.push_on_steps).otherwise(rider.push)).otherwise(cruise_speed(length, climb, rider))
    return F.when(length <= 0, 0).otherwise(F.floor(length / speed + 0.5)).cast("int")


def elevation_cost(steps: Column, rider: Rider = Rider()) -> Column:
    """What a path's climbs and drops cost, steps (delta, metres) in order.

    Two buffers go with the path: drops less a share of the way, and climbs less another. What
    a buffer holds over its limit is charged, and it keeps no more than its most.
    """
    zero = F.struct(F.lit(0.0).alias("down"), F.lit(0.0).alias("up"), F.lit(0.0).alias("cost"))

    def settle(held: Column) -> tuple[Column, Column]:
        charged = F.when(held > rider.buffer, F.greatest(held - rider.most_buffer, F.lit(0.0))).otherwise(F.lit(0.0))
        return F.greatest(held - charged, F.lit(0.0)), charged

    def step(s: Column, x: Column) -> Column:
        down, drops = settle(s["down"] - x["delta"] - x["metres"] * rider.down_cutoff / 100)
        up, climbs = settle(s["up"] + x["delta"] - x["metres"] * rider.up_cutoff / 100)
        moved = F.struct(down.alias("down"), up.alias("up"), (s["cost"] + drops * rider.down_cost + climbs * rider.up_cost).alias("cost"))
        return F.when(x["metres"] > 0, moved).otherwise(s)

    return F.aggregate(steps, zero, step, lambda s: s["cost"])


def balanced(options: Column, weights: dict[str, float]) -> Column:
    """The index of the option with the least weighted sum of axes scaled to their range; ties take the first."""
    span = {axis: (F.array_min(_axis(options, axis)), F.array_max(_axis(options, axis))) for axis in weights}

    def score(o: Column) -> Column:
        total = F.lit(0.0)
        for axis, w in weights.items():
            low, high = span[axis]
            total = total + F.when(high > low, w * (o[axis] - low) / (high - low)).otherwise(0.0)
        return total

    scored = F.transform(options, lambda o, i: F.struct(score(o).alias("score"), i.alias("index")))
    return F.array_min(scored)["index"]


def _axis(options: Column, axis: str) -> Column:
    return F.transform(options, lambda o: o[axis])


def within(options: Column, window: Column, weights: dict[str, float]) -> Column:
    """As balanced, among options whose time fits the window; the fastest where none does, all without a window."""
    fits = F.filter(options, lambda o: o["time"] <= window)
    fastest = F.array_min(F.transform(options, lambda o, i: F.struct(o["time"].alias("time"), i.alias("index"))))["index"]
    fitting = F.array_position(options, F.get(fits, balanced(fits, weights))) - 1
    return F.when(window.isNull(), balanced(options, weights)).when(F.size(fits) > 0, fitting).otherwise(fastest).cast("int")
