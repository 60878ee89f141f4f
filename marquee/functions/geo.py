"""Geometry columns. A polygon is an array of rings, a ring an array of (x, y), the outer ring first."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.labels import literal_map
from marquee.functions.text import blank_as_null, col, collapse


def edges(ring: Column) -> Column:
    """A ring as its edges, the last point joined to the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def crossings(x: Column, y: Column, ring_edges: Column) -> Column:
    """How many of the edges a ray from the point to the right crosses; an odd number of a whole ring's means that it is inside."""
    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return F.when(spans, x < at).otherwise(F.lit(False))

    return F.size(F.filter(ring_edges, crossed))


def mean_point(polygons) -> Column:
    """Mean of every point of a geometry (an array of polygons)."""
    points = F.flatten(F.flatten(col(polygons)))
    zero = F.lit(0.0)
    count = F.nullif(F.size(points), F.lit(0))
    return F.struct((F.aggregate(points, zero, lambda s, p: s + p["x"]) / count).alias("x"),
                    (F.aggregate(points, zero, lambda s, p: s + p["y"]) / count).alias("y"))


def _place_key(c) -> Column:
    text = F.lower(collapse(c))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    plausible = ((text != "") & (F.length(text) <= vocab.MAX_ADDRESS_CHARS)
                 & (F.size(F.split(text, " ")) <= vocab.MAX_ADDRESS_WORDS) & ~text.rlike("[?!;]") & (dots <= 2))
    full = F.when(text.contains("chicago"), text).otherwise(F.concat(text, F.lit(", chicago, il")))
    return F.when(plausible, full)


def geocode_key(address, venue_name) -> Column:
    """The key a location is looked up under: the address if it reads like one, else the venue, else null."""
    return F.coalesce(_place_key(address), _place_key(venue_name))


def replaced(c, steps: list[tuple[str, str]]) -> Column:
    """The lower-cased text after (pattern, replacement) steps."""
    return reduce(lambda text, step: F.regexp_replace(text, *step), steps, F.lower(F.coalesce(col(c), F.lit(""))))


def street_key(c) -> Column:
    """A street address without city, ZIP and punctuation, suffixes in their shortest form."""
    text = replaced(c, vocab.STREET_KEY)
    lookup = literal_map(vocab.STREET_SUFFIXES)
    words = F.split(collapse(text), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(lookup, w), w)), " ")


def park_key(c) -> Column:
    """A park name without what the other side leaves out."""
    return collapse(replaced(c, vocab.PARK_KEY))


def canonical_place(name, aliases=vocab.PLACE_ALIASES) -> Column:
    """The one spelling a place is stored under; blank is null."""
    clean = blank_as_null(name)
    if not aliases:
        return clean
    lookup = literal_map(aliases)
    return F.coalesce(F.try_element_at(lookup, F.lower(clean)), clean)
