"""Column expressions over map tags of ways: speed limits, sidewalks, car and foot profiles.

tags is a map<string,string> column; speeds are km/h, distances metres, durations seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A limit that isn't one.
UNLIMITED = float("inf")
WALKING_KMH = 5.0
#: Implicit speed limits of road classes by country, in km/h.
ZONES = {
    "walk": 5, "at:bicycle_road": 30, "at:motorway": 130, "at:rural": 100, "at:trunk": 100, "at:urban": 50,
    "be-bru:rural": 70, "be-bru:urban": 30, "be:cyclestreet": 30, "be:living_street": 20, "be:motorway": 120, "be:trunk": 120,
    "be-vlg:rural": 70, "be-vlg:urban": 50, "be-wal:rural": 90, "be-wal:urban": 50, "be:zone30": 30,
    "ch:motorway": 120, "ch:rural": 80, "ch:trunk": 100, "ch:urban": 50,
    "cz:living_street": 20, "cz:motorway": 130, "cz:pedestrian_zone": 20, "cz:rural": 90, "cz:trunk": 110, "cz:urban_motorway": 80, "cz:urban": 50, "cz:urban_trunk": 80,
    "de:bicycle_road": 30, "de:living_street": 7, "de:motorway": 130, "de:rural": 100, "de:urban": 50,
    "dk:motorway": 130, "dk:rural": 80, "dk:urban": 50, "fr:motorway": 130, "fr:rural": 80, "fr:urban": 50, "fr:zone30": 30,
    "it:motorway": 130, "it:rural": 90, "it:trunk": 110, "it:urban": 50,
}
#: km/h of a unit.
UNITS = {"mph": 1.609344, "m/h": 1.609344, "knots": 1.852, "knot": 1.852, "kn": 1.852, "ms": 3.6, "m/s": 3.6}
#: km/h by class of road where tags have no limit.
CLASS_LIMITS = {
    "motorway": 120, "motorway_link": 120, "primary": 120, "primary_link": 120,
    "rural": 80, "tertiary": 80, "tertiary_link": 80,
    "trunk": 100, "trunk_link": 100, "secondary": 100, "secondary_link": 100,
    "urban": 50, "road": 50, "unclassified": 50,
    "pedestrian": 5, "footway": 5, "path": 5, "living_street": 7,
    "bicycle_road": 30, "service": 30, "residential": 30, "track": 30,
}
#: Preference and speed factor of a car by class of road.
CAR = {
    "motorway": (3.0, 1.0), "motorway_link": (3.0, 1.0), "trunk": (3.0, 1.0), "trunk_link": (3.0, 1.0), "primary": (3.0, 1.0), "primary_link": (3.0, 1.0),
    "secondary": (4.0, 0.9), "secondary_link": (4.0, 0.9), "tertiary": (5.0, 0.8), "tertiary_link": (5.0, 0.8),
    "unclassified": (8.0, 0.95), "residential": (8.0, 0.95), "living_street": (8.0, 0.95), "service": (8.0, 0.95), "rural": (8.0, 0.95),
    "road": (9.0, 0.9), "pedestrian": (50.0, 1.0), "footway": (50.0, 1.0),
}
#: Preference on foot by class of road, without and with a sidewalk; None: not passable.
FOOT = {
    "motorway": (None, 10.0), "motorway_link": (None, 10.0), "trunk": (None, 10.0), "trunk_link": (None, 10.0), "primary": (None, 10.0), "primary_link": (None, 10.0),
    "secondary": (None, 6.0), "secondary_link": (None, 6.0), "tertiary": (None, 6.0), "tertiary_link": (None, 6.0), "road": (None, 4.0),
    "unclassified": (2.0, 1.0), "residential": (2.0, 1.0), "living_street": (2.0, 1.0), "service": (2.0, 1.0), "rural": (2.0, 1.0),
    "pedestrian": (1.0, 1.0), "footway": (1.0, 1.0), "track": (1.0, 1.0), "path": (1.0, 1.0), "steps": (1.0, 1.0),
}
# a speed tag: perhaps a country's or zone's name and a colon, a whole number, perhaps a unit
_ZONE, _NUMBER, _UNIT = "[A-Za-z-]+:(?:zone:?)?", "[1-9][0-9]*", "[A-Za-z/]+"
_LIMIT = rf"^(?:{_ZONE})?({_NUMBER})\s*({_UNIT})?"


def _choice(c: Column, table: dict) -> Column:
    """The table's value of c; null elsewhere."""
    out = F.lit(None).cast("double")
    for value in dict.fromkeys(table.values()):
        out = F.when(c.isin(*(name for name, v in table.items() if v == value)), F.lit(value).cast("double")).otherwise(out)
    return out


def max_speed(value: Column) -> Column:
    """A speed tag in km/h: UNLIMITED for "none", null where it says nothing."""
    name = F.trim(F.lower(value))
    zones = F.create_map(*(F.lit(x) for k, v in ZONES.items() for x in (k, float(v))))
    units = F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v)))
    number = F.regexp_extract(value, _LIMIT, 1)
    parsed = F.when(number != "", number.cast("double") * F.coalesce(units[F.regexp_extract(value, _LIMIT, 2)], F.lit(1.0)))
    return F.when(name == "none", F.lit(UNLIMITED)).when(name == "", None).otherwise(F.coalesce(zones[name], parsed))


def infer_max_speed(tags: Column, highway: Column) -> Column:
    """The limit of a way: its own, its zone's, or that of its class of road; null if none is known."""
    by_class = _choice(highway, CLASS_LIMITS)
    return F.coalesce(max_speed(tags["maxspeed"]), max_speed(tags["zone:maxspeed"]), by_class)


def to_bool(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("y", "yes", "true"), True).when(v.isin("n", "no", "false"), False)


def _tag(tags: Column, key: str) -> Column:
    """A tag whose key may be in any case, or null."""
    return F.try_element_at(F.map_values(F.map_filter(tags, lambda k, _: F.trim(F.lower(k)) == key)), F.lit(1))


def sidewalk(tags: Column) -> Column:
    """left, right, left_bicycle, right_bicycle, or null for a way without a sidewalk."""
    side = F.trim(F.lower(_tag(tags, "sidewalk")))

    def bicycle(own: str) -> Column:
        return F.coalesce(to_bool(_tag(tags, f"sidewalk:{own}:bicycle")), to_bool(_tag(tags, "sidewalk:both:bicycle")), F.lit(False))

    both = side.isin("both", "yes")
    left, right = F.coalesce(both | (side == "left"), F.lit(False)), F.coalesce(both | (side == "right"), F.lit(False))
    every = F.struct(left.alias("left"), right.alias("right"), bicycle("left").alias("left_bicycle"), bicycle("right").alias("right_bicycle"))
    return F.when(left | right, every)


def car_profile(tags: Column) -> Column:
    """pref, speed_kmh, bidirectional; null where cars don't go."""
    highway = F.lower(tags["highway"])
    pref, factor = _choice(highway, {k: v[0] for k, v in CAR.items()}), _choice(highway, {k: v[1] for k, v in CAR.items()})
    limit = infer_max_speed(tags, highway)
    speed = F.when(limit == UNLIMITED, 130.0).otherwise(F.coalesce(limit, F.lit(40.0))) * factor
    two_way = F.coalesce(F.lower(tags["oneway"]) != "yes", F.lit(True))
    return F.when(pref.isNotNull(), F.struct(pref.alias("pref"), speed.alias("speed_kmh"), two_way.alias("bidirectional")))


def foot_profile(tags: Column) -> Column:
    """pref, speed_kmh, bidirectional; null where nobody walks."""
    highway = F.lower(tags["highway"])
    beside = F.when(sidewalk(tags).isNotNull(), _choice(highway, {k: v[1] for k, v in FOOT.items()})).otherwise(_choice(highway, {k: v[0] for k, v in FOOT.items() if v[0] is not None}))
    pref = F.when(F.lower(tags["footway"]).isin("sidewalk", "crossing"), F.lit(1.0)).otherwise(beside)
    return F.when(pref.isNotNull(), F.struct(pref.alias("pref"), F.lit(WALKING_KMH).alias("speed_kmh"), F.lit(True).alias("bidirectional")))


def duration(length_m: Column, speed_kmh: Column) -> Column:
    return length_m / (speed_kmh / 3.6)
