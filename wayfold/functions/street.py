"""Streets: classes and access from tags, and what an edge costs by mode."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Admitted highway kinds, and those that have a class of their own.
ADMITTED = "motorway trunk primary secondary tertiary unclassified residential service living_street motorway_link trunk_link primary_link secondary_link tertiary_link footway cycleway bridleway path track pedestrian steps".split()
CLASSES = [*ADMITTED, "road"]
CLOSED = ("no", "private", "agricultural", "forestry")
PAVED = ("paved", "asphalt", "concrete", "paving_stones", "sett")
#: How much of its speed a car keeps on a surface.
SURFACE_SPEED = {
    "asphalt": 1.00, "concrete": 0.95, "paved": 0.90, "concrete:plates": 0.85, "metal": 0.85, "wood": 0.85, "paving_stones": 0.80, "compacted": 0.80, "fine_gravel": 0.80, "grass_paver": 0.70, "unpaved": 0.70,
    "sett": 0.65, "gravel": 0.60, "pebblestone": 0.60, "ground": 0.60, "dirt": 0.60, "earth": 0.60, "cobblestone": 0.50, "unhewn_cobblestone": 0.50, "grass": 0.45, "sand": 0.25, "mud": 0.20,
}
UNKNOWN_SPEED = 0.90
#: Weights of surfaces, deviations and delays in seconds by road class, variance flags, speeds in metres a second.
SURFACE_WEIGHT = {"paved": 1.0, "unknown": 1.3, "unpaved": 2.5}
MAJOR, SECONDARY = ("primary", "primary_link", "trunk", "trunk_link"), ("secondary", "secondary_link")
SIGNAL_SIGMA, SIGNAL_DELAY, ELEVATOR_SIGMA, CROSSING_SIGMA, TURN_SIGMA = (25.0, 18.0, 12.0), (15.0, 10.0, 7.0), 20.0, 3.0, 10.0
SIGNAL, CROSSING, ELEVATOR = 1, 2, 4
SPEEDS = {"foot": 1.2, "bike": 4.2, "car": 11.0}
CONNECTOR_SPEED, ELEVATOR_SECONDS = {"steps": 0.5, "ramp": 0.9}, 45.0
#: What a metre costs a cyclist by class, plain and with a bicycle sign or unpaved; penalties against one-way; tracks by grade, on good ground and on other.
HIGHWAY_FACTOR = {"trunk": (10.0, 1.5), "primary": (3.0, 1.2), "secondary": (1.6, 1.1), "tertiary": (1.4, 1.0), "unclassified": (1.3, 1.0)}
BY_GROUND = {"residential": (1.1, 1.5), "living_street": (1.1, 1.5), "service": (1.3, 1.6)}
OTHER_FACTOR = {"cycleway": 1.0, "pedestrian": 3.0, "bridleway": 5.0}
ONEWAY = {"primary": 50.0, "secondary": 30.0, "tertiary": 20.0}
TRACK_GOOD, TRACK_OTHER = (1.0, 1.0, 1.1, 1.5, 2.0, 3.0), (5.0, 1.3, 2.0, 3.0, 5.0, 5.0)


def lookup(table: dict, key: Column, default=None) -> Column:
    found = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def effective_highway(highway: Column, virtual: Column) -> Column:
    return F.coalesce(highway, F.when(virtual.isin("footway", "path", "pedestrian", "steps"), virtual))


def admitted(highway: Column, access: Column) -> Column:
    return F.coalesce(highway.isin(*ADMITTED), F.lit(False)) & ~F.coalesce(access.isin(*CLOSED), F.lit(False))


def highway_class(highway: Column) -> Column:
    return F.when(highway.isin(*CLASSES), highway).otherwise("other")


def surface_class(surface: Column) -> Column:
    return F.when(surface.isNull(), "unknown").when(surface.isin(*PAVED), "paved").otherwise("unpaved")


def surface_percent(surface: Column) -> Column:
    return F.floor(100 * lookup(SURFACE_SPEED, surface, UNKNOWN_SPEED) + 0.5).cast("int")


def _open(access: Column, motorroad: Column) -> Column:
    return F.when(access.isNull(), F.coalesce(motorroad != "yes", F.lit(True))).otherwise(~access.isin("private", "no"))


def bike_access(highway, access, vehicle, bicycle, bicycle_road, motorroad) -> Column:
    """A bicycle tag decides; else a vehicle tag; else footways are closed and access decides."""
    own = F.when(F.coalesce(bicycle_road == "yes", F.lit(False)), bicycle != "no").otherwise(~bicycle.isin("private", "no", "dismount", "use_sidepath"))
    return F.when(bicycle.isNotNull(), own).when(vehicle.isNotNull(), ~vehicle.isin("private", "no")).when(F.coalesce(highway == "footway", F.lit(False)), False).otherwise(_open(access, motorroad))


def foot_access(by_bike: Column, bicycle, foot, access, motorroad) -> Column:
    return F.when(by_bike | F.coalesce(bicycle == "dismount", F.lit(False)), True).when(foot.isNotNull(), ~foot.isin("private", "no")).otherwise(_open(access, motorroad))


def wrong_way(forward: Column, oneway, oneway_bicycle, junction, cycleway) -> Column:
    against = F.when(F.coalesce(oneway_bicycle == "yes", F.lit(False)), True).when(oneway.isNull(), F.coalesce(junction == "roundabout", F.lit(False))).otherwise(oneway.isin("yes", "true", "1"))
    free = F.coalesce(cycleway.isin("opposite", "opposite_lane", "opposite_track"), F.lit(False)) | F.coalesce(oneway_bicycle == "no", F.lit(False))
    return F.when(free, False).when(forward, F.coalesce(oneway == "-1", F.lit(False))).otherwise(against)


def by_class(highway: Column, values: tuple[float, float, float]) -> Column:
    return F.when(highway.isin(*MAJOR), values[0]).when(highway.isin(*SECONDARY), values[1]).otherwise(values[2])


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) == bit


def seconds(length: Column, mode: str) -> Column:
    """Whole seconds from whole metres at a speed in whole millimetres a second."""
    return F.floor(length * 1000 / int(SPEEDS[mode] * 1000)).cast("long")


def signal_delay(flags: Column, highway: Column) -> Column:
    return F.when(has(flags, SIGNAL), by_class(highway, SIGNAL_DELAY)).otherwise(0.0)


def variance(flags: Column, highway: Column, turn: Column | None = None) -> Column:
    """Squared deviations of signals, elevators and crossings; with turn, the cosine between directions, that of turning too."""
    parts = F.when(has(flags, SIGNAL), F.pow(by_class(highway, SIGNAL_SIGMA), 2)).otherwise(0.0) + F.when(has(flags, ELEVATOR), ELEVATOR_SIGMA**2).otherwise(0.0) + F.when(has(flags, CROSSING), CROSSING_SIGMA**2).otherwise(0.0)
    return parts if turn is None else parts + F.pow(TURN_SIGMA * (1 - F.least(F.greatest(turn, F.lit(-1.0)), F.lit(1.0))) / 2, 2)


def walk_cost(length, elevation, surface, flags, highway, foot) -> Column:
    """(time, ascent, surface, variance) on foot; null where that isn't allowed."""
    return F.when(
        foot,
        F.struct((seconds(length, "foot") + signal_delay(flags, highway)).alias("time"), F.greatest(elevation, F.lit(0)).cast("double").alias("ascent"), (length * lookup(SURFACE_WEIGHT, surface)).alias("surface"), variance(flags, highway).alias("variance")),
    )


def drive_cost(length, flags, highway, car) -> Column:
    return F.when(car, F.struct(seconds(length, "car").cast("double").alias("time"), variance(flags, highway).alias("variance")))


def bike_factor(highway, surface, tracktype, signed, on_route, by_bike, on_foot, against, base: float = 0.5, unsafe: float = 2.0, respect_oneway: bool = True) -> Column:
    """What a metre counts for a cyclist; null where it is impassable.

    Steps cost 40, a road without a sign so much more as it is unsafe, a way on foot 4; against
    a one-way street there is no way, or, where that isn't respected, a penalty by class.
    """
    oneway = F.when(against, by_link(highway, ONEWAY, 4.0)).otherwise(0.0)
    unpaved = surface == "unpaved"
    good = ((surface == "paved") | signed | (highway == "footway")) & ~unpaved
    grade = F.coalesce(tracktype, F.lit(0)) + 1
    track = F.when(good, F.element_at(F.array(*map(F.lit, TRACK_GOOD)), grade)).otherwise(F.element_at(F.array(*map(F.lit, TRACK_OTHER)), grade))
    plain = F.regexp_replace(highway, "_link$", "")
    part = F.when(highway.isin("track", "road", "path", "footway"), track)
    for k, (a, b) in HIGHWAY_FACTOR.items():
        part = part.when(plain == k, F.when(signed, b).otherwise(a))
    for k, (a, b) in BY_GROUND.items():
        part = part.when(highway == k, F.when(unpaved, b).otherwise(a))
    part = part.otherwise(lookup(OTHER_FACTOR, highway, 2.0))
    more = F.when(plain.isin(*HIGHWAY_FACTOR) & ~signed, unsafe).otherwise(0.0)
    closed = highway.isin("motorway", "motorway_link", "other") | (~by_bike & ~on_foot)
    barred = against if respect_oneway else F.lit(False)
    return F.when(closed, None).when(highway == "steps", 40.0).when(barred, None).when(on_route, 1.0 + oneway).otherwise(base + part + more + F.greatest(oneway, F.when(by_bike, 0.0).otherwise(4.0)))


def by_link(highway: Column, table: dict[str, float], default: float) -> Column:
    return lookup(table, F.regexp_replace(highway, "_link$", ""), default)


def connector(highway, elevator, conveying, ramp) -> Column:
    return F.when(highway.isin("steps", "elevator"), highway).when(F.coalesce(elevator == "yes", F.lit(False)) | conveying.isNotNull(), "elevator").when(ramp == "yes", "ramp")


def connector_seconds(kind: Column, metres: Column) -> Column:
    return F.when(kind == "elevator", ELEVATOR_SECONDS).otherwise(metres / lookup(CONNECTOR_SPEED, kind))
