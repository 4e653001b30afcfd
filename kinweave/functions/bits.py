"""Sets of sources and types as bit masks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the known sources.
GEO_SOURCES = {"http://data.nytimes.com/": 1, "http://dbpedia.org/": 2, "http://linkedgeodata.org/": 4, "http://rdf.freebase.com/": 8, "http://sws.geonames.org/": 16}
MUSIC_SOURCES = {"1": 1, "2": 2, "3": 4, "4": 8, "5": 16}
NC_SOURCES = {f"geco{i + 1}": 1 << i for i in range(10)}
#: Whose coordinates go first.
PLACE_ORDER = ("http://sws.geonames.org/", "http://dbpedia.org/")


def dictionary(names) -> dict[str, int]:
    """Bits for names in alphabetical order, 63 at most."""
    names = sorted(set(names))
    if len(names) > 63:
        raise ValueError("a mask holds 63 sources")
    return {n: 1 << i for i, n in enumerate(names)}


def source_dictionary(df: DataFrame, column: str = "data_source") -> dict[str, int]:
    """Bits for the sources that occur; there are few."""
    return dictionary(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(64).collect())


def encode_one(name: Column, bits: Mapping[str, int]) -> Column:
    """The bit of a name; 0 if it isn't known."""
    table = F.create_map(*(F.lit(x) for pair in bits.items() for x in pair))
    return F.coalesce(F.element_at(table, name), F.lit(0)).cast("long")


def encode(names: Column, bits: Mapping[str, int]) -> Column:
    """The mask of an array of names."""
    return F.aggregate(names, F.lit(0).cast("long"), lambda m, n: m.bitwiseOR(encode_one(n, bits)))


def decode(mask: Column, bits: Mapping[str, int]) -> Column:
    """Names in a mask, sorted."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(b).cast("long").alias("bit")) for n, b in sorted(bits.items())))
    return F.transform(F.filter(pairs, lambda p: mask.bitwiseAND(p["bit"]) != 0), lambda p: p["name"])


def merge(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def count(mask: Column) -> Column:
    return F.bit_count(mask)


def overlap(a: Column, b: Column) -> Column:
    """Whether two masks share a bit; an empty mask is unknown and overlaps all."""
    return (a == 0) | (b == 0) | (a.bitwiseAND(b) != 0)


def contains(a: Column, b: Column) -> Column:
    """Whether all bits of b are in a."""
    return a.bitwiseAND(b) == b
