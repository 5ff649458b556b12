"""Names, labels and times in words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of classes.
CATEGORIES = {
    "IfcWall": "wall",
    "IfcWallStandardCase": "wall",
    "IfcCurtainWall": "curtain wall",
    "IfcDoor": "door",
    "IfcWindow": "window",
    "IfcSlab": "floor slab",
    "IfcRoof": "roof",
    "IfcStair": "stair",
    "IfcStairFlight": "stair flight",
    "IfcRamp": "ramp",
    "IfcRampFlight": "ramp flight",
    "IfcRailing": "railing",
    "IfcColumn": "column",
    "IfcBeam": "beam",
    "IfcMember": "structural member",
    "IfcPlate": "plate",
    "IfcFooting": "footing",
    "IfcPile": "pile",
    "IfcFurnishingElement": "furniture",
    "IfcFurniture": "furniture",
    "IfcFlowTerminal": "fixture",
    "IfcSanitaryTerminal": "sanitary fixture",
    "IfcFlowSegment": "pipe/duct",
    "IfcDistributionPort": "port",
    "IfcOpeningElement": "opening",
    "IfcBuildingElementProxy": "element",
    "IfcGeographicElement": "landscape element",
    "IfcSite": "site element",
}
#: Patterns and word lists.
NAME_TYPE_ID = "^(.+):(.+):([0-9]+)$"
NAME_ID = "^(.+):([0-9]{4,})$"
AUTOMATIC_NAME = "^.+#[0-9]+$"
MAKER_PREFIX = "^[A-Z]_"
DIMENSION = r"[0-9]+\s*x\s*[0-9]+(\s*x\s*[0-9]+)*\s*mm\b"
EXTERIOR_HINTS = ("exterior", "ytter", "outer", "façade", "facade", "external")
INTERIOR_HINTS = ("interior", "inner", "inre")
PLACEHOLDERS = ("Door: Fire Rating", "Wall: Fire Rating", "Window: Fire Rating", "Fire Rating", "")


def human_class(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.coalesce(known[name], F.lower(F.replace(name, F.lit("Ifc"), F.lit(""))))


def _product_name(name: Column) -> Column:
    for pattern, to in ((MAKER_PREFIX, ""), (DIMENSION, ""), (r":\s*-\s*", " "), (r":\s*", " "), ("^[ -]+|[ -]+$", "")):
        name = F.regexp_replace(name, pattern, to)
    name = F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), r"\s+", " "))
    return F.when(name != "", name)


def clean_name(name: Column) -> Column:
    """A name for people: element ids, maker prefixes and dimensions go; automatic names are null."""
    family, kind = F.regexp_extract(name, NAME_TYPE_ID, 1), F.regexp_extract(name, NAME_TYPE_ID, 2)
    both = F.when(family == kind, family).otherwise(F.concat(family, F.lit(": "), kind))
    cleaned = F.when(name.rlike(NAME_TYPE_ID), _product_name(both)).when(name.rlike(NAME_ID), _product_name(F.regexp_extract(name, NAME_ID, 1))).otherwise(name)
    return F.when(name.isNotNull() & (name != "") & ~name.rlike(AUTOMATIC_NAME), cleaned)


def is_external(flag: Column, name: Column, type_name: Column) -> Column:
    """The property if it is set, else by hints in the names; exterior hints go first."""
    words = F.concat(F.lower(F.coalesce(name, F.lit(""))), F.lit(" "), F.lower(F.coalesce(type_name, F.lit(""))))

    def has(hints: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for h in hints:
            found = found | words.contains(h)
        return found

    return F.coalesce(flag, F.when(has(EXTERIOR_HINTS), True).when(has(INTERIOR_HINTS), False))


def element_label(category: Column, name: Column, external: Column, orientation: Column, host_external: Column, host_orientation: Column, has_host: Column, storey: Column) -> Column:
    """A description such as ``exterior north-facing wall on Floor 0``."""
    side = lambda flag: F.when(flag, "exterior").when(~flag, "interior")
    facing = F.when(has_host & host_orientation.isNotNull(), F.concat(F.lit("in "), host_orientation, F.lit(" wall")))
    label = (
        F.when(category == "wall", F.concat_ws(" ", side(external), orientation, F.lit("wall")))
        .when(category.isin("door", "window"), F.concat_ws(" ", F.when(has_host, side(host_external)), category, facing))
        .when(category == "opening", F.when(has_host, "opening in wall").otherwise("opening"))
        .when(category.isin("furniture", "fixture", "element"), F.coalesce(name, category))
        .otherwise(category)
    )
    return F.when(F.coalesce(storey, F.lit("")) != "", F.concat(label, F.lit(" on "), storey)).otherwise(label)


def parse_timestamp(text: Column) -> Column:
    """By the first of three formats that fits: with time, with time and zone, date."""
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    plain = F.when(text.rlike(iso + r"T[0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    zoned = F.when(text.rlike(iso + r"T[0-9]{2}:[0-9]{2}:[0-9]{2}([+-][0-9]{2}:?[0-9]{2}|Z)$"), F.try_to_timestamp(F.regexp_replace(text, "([+-][0-9]{2})([0-9]{2})$", "$1:$2"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    day = F.when(text.rlike(iso + "$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(plain, zoned, day)


def plural(n: Column, word: Column) -> Column:
    """``1 wall``, ``2 walls``, ``2 entities``, ``2 boxes``."""
    many = F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(s|sh|ch|x)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, word).otherwise(many))


def relative_time(seconds: Column, days_only: bool = False) -> Column:
    """``3 hours later`` and the like; halves of whole units round to even.

    With ``days_only`` days are the largest unit; otherwise months follow from 30 days on, and years.
    """
    s = F.abs(seconds)

    def unit(x: Column, name: str) -> Column:
        n = F.bround(x).cast("long")
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n != 1, "s").otherwise(""), F.lit(" later"))

    minutes, hours, days = s / 60, s / 3600, s / 86400
    years = F.bround(days / 365.25, 1)
    whole = years == F.floor(years)
    year_text = F.concat(F.when(whole, years.cast("long").cast("string")).otherwise(years.cast("string")), F.when(years == 1, " year later").otherwise(" years later"))
    short = (
        F.when(s < 60, F.concat(s.cast("long").cast("string"), F.lit(" seconds later")))
        .when(minutes < 60, unit(minutes, "minute"))
        .when(hours < 24, unit(hours, "hour"))
    )
    if days_only:
        return short.otherwise(unit(days, "day"))
    return short.when(days < 30, unit(days, "day")).when(days / 30.44 < 12, unit(days / 30.44, "month")).otherwise(year_text)


def clean_field_name(field: Column, qualified: bool = False) -> Column:
    """Property name of ``pset.<set>.<name>``, with ``qualified`` followed by the set."""
    common, other = r"^pset\.Pset_([A-Za-z0-9_]+?)Common\.(.+)$", r"^pset\.([A-Za-z0-9_]+)\.(.+)$"
    if not qualified:
        return F.when(field.rlike(common), F.regexp_extract(field, common, 2)).when(field.rlike(other), F.regexp_extract(field, other, 2)).otherwise(field)
    by = lambda p, set_name: F.concat(F.regexp_extract(field, p, 2), F.lit(" ("), set_name, F.lit(")"))
    return F.when(field.rlike(common), by(common, F.lower(F.regexp_extract(field, common, 1)))).when(field.rlike(other), by(other, F.regexp_replace(F.regexp_extract(field, other, 1), "^Pset_", ""))).otherwise(field)


def clean_value(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.isin(*PLACEHOLDERS), "none").otherwise(text)


def detail_from_label(label: Column, category: Column) -> Column:
    """A label without its leading category."""
    out = label
    for prefix in (F.concat(F.lit("interior "), category, F.lit(" ")), F.concat(F.lit("exterior "), category, F.lit(" ")), F.concat(category, F.lit(" "))):
        out = F.when(F.startswith(F.lower(label), prefix), F.substring(label, F.length(prefix) + 1, F.length(label))).otherwise(out)
    return out
