"""Column expressions.  All stay in the JVM and inside code generation."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without combining marks leaves of characters, from Python's own Unicode tables.

    Characters that leave one or nothing, as the two texts of a translation; and those
    that leave several of which any is ASCII.  Hangul syllables and others leave nothing
    but separators, as they are themselves.
    """
    one: dict[str, str] = {}
    gone: list[str] = []
    several: dict[str, str] = {}
    for c in map(chr, (*range(128, 0xAC00), *range(0xE000, sys.maxunicode + 1))):
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if left == c:
            continue
        if len(left) == 1:
            one[c] = left
        elif not left:
            gone.append(c)
        elif not left.isascii() and not any(x.isascii() for x in left):
            continue
        else:
            several[c] = left
    return "".join(one) + "".join(gone), "".join(one.values()), several


def stripped(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def normalize_category(col: Column) -> Column:
    """A facility's category as I-1 .. III-E, or UNCLASSIFIED; null is unclassified."""
    s = F.upper(stripped(F.coalesce(col, F.lit(""))))
    fits = s.rlike(P.CATEGORY_PATTERN) & ~s.isin(*P.EMPTY_CATEGORIES)
    return F.when(fits, F.concat_ws("-", F.regexp_extract(s, P.CATEGORY_PATTERN, 1), F.regexp_extract(s, P.CATEGORY_PATTERN, 2))).otherwise(F.lit(P.UNCLASSIFIED))


def is_resolutive(category: Column, status: Column) -> Column:
    known = category.isin(*P.RESOLUTIVE_CATEGORIES) & F.upper(stripped(status)).isin(*P.ACTIVE_STATUS)
    return F.coalesce(known, F.lit(False))


def pad_code(col: Column, width: int = 6) -> Column:
    """Zeros on the left up to width; longer codes and null stay."""
    return F.when(F.length(col) < width, F.lpad(col, width, "0")).otherwise(col)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * P.EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def parse_tags(col: Column) -> Column:
    """Map of the "key"=>"value" pairs of a text; the last value of a key wins, null gives an empty map."""
    text = F.coalesce(col, F.lit(""))
    entries = F.arrays_zip(F.regexp_extract_all(text, F.lit(P.TAG_PATTERN), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(P.TAG_PATTERN), F.lit(2)).alias("v"))
    k = lambda e: e["k"]
    last = lambda all_: F.filter(all_, lambda e, i: ~F.array_contains(F.transform(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), k), k(e)))
    # an array of one, so that the text is searched once, not for each entry
    return F.map_from_entries(F.element_at(F.transform(F.array(entries), last), 1))


def access_excluded(tags: Column, profile: str) -> Column:
    """Private ways, and those closed for the profile."""
    has = lambda k, v: F.coalesce(F.element_at(tags, k) == v, F.lit(False))
    return has("access", "private") | has(P.ACCESS_TAGS[profile], "no")


def highway_allowed(highway: Column, profile: str) -> Column:
    return ~highway.isin(*P.EXCLUDED_HIGHWAYS[profile])


def edge_speed_kmh(highway: Column, profile: str) -> Column:
    if profile != "car":
        return F.lit(P.FLAT_SPEEDS[profile])
    table = F.create_map(*[F.lit(x) for k, v in P.CAR_SPEEDS.items() for x in (k, float(v))])
    return F.coalesce(F.element_at(table, highway), F.lit(P.FLAT_SPEEDS["car"]))


def without_accents(col: Column) -> Column:
    """Compatibility decomposition without combining marks, as far as any ASCII comes of it."""
    matching, replace, several = _decompositions()
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{x}" for c, x in several.items())), F.lit("\x01"), F.lit("\x02"))
    rare = F.translate(col, "".join(several), "") != col
    letters = F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0))
    spelt = F.array_join(F.transform(letters, lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.translate(F.when(rare, spelt).otherwise(col), matching, replace)


def normalize_name(col: Column) -> Column:
    """Upper case without accents; anything else than letters and digits separates words."""
    s = F.regexp_replace(F.upper(without_accents(col)), "[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def title_es(col: Column, first_word: bool = False) -> Column:
    """Title case with small connectors and single spaces: O'Higgins y San-Martin.

    A letter after anything but a letter is a capital.  With first_word (names of the
    census) only the first letter of a word is, `el` is a word like others, and a
    connector in front is one too.
    """
    small = ("y", "de", "del", "la", "las", "los") if first_word else ("y", "de", "del", "la", "las", "el", "los")
    first = lambda r: F.when(F.substring(r, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(r, 1, 1)))
    capital = lambda r: F.concat(first(r), r.substr(F.lit(2), F.length(r)))
    runs = lambda w: F.regexp_extract_all(w, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    titled = capital if first_word else lambda w: F.array_join(F.transform(runs(w), capital), "")
    word = lambda w, i: F.when(w.isin(*small) & (~F.lit(first_word) | (i > 0)), w).otherwise(titled(w))
    return F.array_join(F.transform(F.split(stripped(F.lower(col)), r"\s+"), word), " ")


def name_key(col: Column) -> Column:
    """Letters only, each word capitalised, without accents; what isn't ASCII then parts no words."""
    ascii_only = F.regexp_replace(without_accents(col), "[^\\x00-\\x7F]+", "")
    return F.regexp_replace(F.initcap(F.regexp_replace(ascii_only, "[^A-Za-z]+", " ")), "[^A-Za-z]", "")


def in_scope(department: Column, departments: list[str]) -> Column:
    return F.upper(department).isin(*[d.upper() for d in departments])
