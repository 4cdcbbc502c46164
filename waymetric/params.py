"""Defaults of every job.  Fixed values that results depend on are stated as they are."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BoundingBox:
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float


BBOX = BoundingBox(-81.4, -68.6, -18.4, -0.04)

# Categories of facilities and their state.
UNCLASSIFIED = "SIN_CATEGORIA"
EMPTY_CATEGORIES = ("", "0", "NAN", "N/A", "S/C", "SIN CATEGORIA")
RESOLUTIVE_CATEGORIES = ("II-1", "II-2", "II-E", "III-1", "III-2", "III-E")
# The pattern of a category, and of a key and value among a way's tags.
CATEGORY_PATTERN = r"^(I{1,3})\s*-?\s*([1-4E])$"
TAG_PATTERN = r'"((?:[^"\\]|\\.)*)"=>"((?:[^"\\]|\\.)*)"'
ACTIVE_STATUS = ("ACTIVO",)
UPGRADEABLE_CATEGORIES = ("I-3", "I-4")
ENCODINGS = ("utf-8", "latin-1", "cp1252")
# Bytes that stand for no character, as a class of Latin-1 characters.
UNUSED_BYTES = {"ascii": r"\x80-\xff", "iso8859-1": "", "cp1252": r"\x81\x8d\x8f\x90\x9d"}

TOLERANCE_M = 500.0
UTM_ZONE = 18
CAPITAL_WEIGHTS = {"0": 1, "3": 10, "2": 30, "1": 100}
URBAN_POPULATION = 2000
MAX_POINTS = 5000
SEED = 42
BANDS = (30, 60, 120)
THRESHOLD_MIN = 60.0
TOP_N = 20
MAX_SITES = 5
EARTH_RADIUS_M = 6371000.0

# Road classes that each travel profile leaves out.
EXCLUDED_HIGHWAYS = {
    "car": (
        "abandoned", "bridleway", "bus_guideway", "construction", "corridor", "cycleway", "elevator", "escalator", "footway", "no", "path",
        "pedestrian", "planned", "platform", "proposed", "raceway", "razed", "rest_area", "service", "services", "steps", "track",
    ),
    "foot": (
        "abandoned", "bus_guideway", "construction", "corridor", "cycleway", "elevator", "escalator", "motorway", "motorway_link", "no", "planned",
        "platform", "proposed", "raceway", "razed",
    ),
    "bike": (
        "abandoned", "bus_guideway", "construction", "corridor", "elevator", "escalator", "footway", "motorway", "motorway_link", "no", "planned",
        "platform", "proposed", "raceway", "razed", "steps",
    ),
}
# Speeds in km/h, by road class for cars, flat for the other profiles.
CAR_SPEEDS = {
    "motorway": 100, "motorway_link": 70, "trunk": 80, "trunk_link": 50, "primary": 60, "primary_link": 40, "secondary": 50, "secondary_link": 35,
    "tertiary": 40, "tertiary_link": 30, "unclassified": 30, "residential": 25, "living_street": 15, "service": 15, "track": 15,
}
FLAT_SPEEDS = {"car": 40.0, "bike": 12.0, "foot": 4.5}
#: The tag that closes a way for a profile when it is "no".
ACCESS_TAGS = {"car": "motor_vehicle", "foot": "foot", "bike": "bicycle"}
