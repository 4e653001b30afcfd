"""Similarities of strings, numbers, types and places as column expressions; Jaro-Winkler alone runs in Arrow batches."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import geo
from .text import LANGUAGES, geo_simplify, padded_trigrams, repair_digits, sane, sane_int, simplify
from .type_names import ALIKE, NO_TYPE


def gram_counts(x: Column) -> Column:
    """Map from padded trigram to how often it occurs."""
    grams = padded_trigrams(x)
    return F.map_from_entries(F.transform(F.array_distinct(grams), lambda g: F.struct(g, F.size(F.filter(grams, lambda y: y == g)))))


def cosine_trigram(a: Column, b: Column) -> Column:
    """Cosine of the trigram counts of two strings between ## and ##; 0 if one is empty and the other isn't, 1 if both are."""
    # pairs of equal grams, one of either side; where no gram repeats, that is the size of the intersection
    once = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    counted = lambda x, y: F.aggregate(x, F.lit(0), lambda n, g: n + F.size(F.filter(y, lambda z: z == g)))
    dot = lambda x, y: F.when(once(x) & once(y), F.size(F.array_intersect(x, y))).otherwise(counted(x, y)).cast("double")
    norm = lambda x: F.when(once(x), F.size(x)).otherwise(counted(x, x)).cast("double")
    # bound by a lambda, the grams are made once a row
    both = F.transform(F.array(F.struct(padded_trigrams(a).alias("x"), padded_trigrams(b).alias("y"))), lambda p: F.when((F.size(p["x"]) == 0) & (F.size(p["y"]) == 0), F.lit(1.0)).when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), F.lit(0.0)).otherwise(dot(p["x"], p["y"]) / F.sqrt(norm(p["x"]) * norm(p["y"]))))
    return F.when(a == b, 1.0).when(a.isNotNull() & b.isNotNull(), F.get(both, 0))


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro < 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler: boost from 0.7 on, prefixes of up to 4 characters at 0.1."""
    return pd.Series([_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


METRICS = {"ct": cosine_trigram, "jw": jaro_winkler}


def string_sim(a: Column, b: Column, metric: str = "ct") -> Column:
    """Of two sane strings, simplified; null if one isn't sane."""
    return F.round(METRICS[metric](simplify(sane(a)), simplify(sane(b))), 6)


def geo_string_sim(a: Column, b: Column, metric: str = "ct") -> Column:
    """As string_sim, of the first part of each name."""
    return F.round(METRICS[metric](geo_simplify(sane(a)), geo_simplify(sane(b))), 6)


def type_sim(a: Column, b: Column) -> Column:
    """1 if a type is shared or alike, else 0."""
    alike = reduce(lambda x, y: x | y, ((F.array_contains(a, p) & F.array_contains(b, q)) | (F.array_contains(a, q) & F.array_contains(b, p)) for p, q in ALIKE))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.arrays_overlap(a, b) | alike, 1.0).otherwise(0.0))


def number_sim(a: Column, b: Column, domain: str = "music") -> Column:
    """1 if equal (voter data: after digits are repaired), else null."""
    if domain == "nc":
        a, b = repair_digits(a), repair_digits(b)
    return F.when(sane(a) == sane(b), F.lit(1.0))


def near_sim(a: Column, b: Column) -> Column:
    """Of years or lengths: equal 1, one apart 0.5, else 0; null if one is missing."""
    a, b = sane_int(a), sane_int(b)
    return F.when(a == b, 1.0).when(F.abs(a - b) == 1, 0.5).when(a.isNotNull() & b.isNotNull(), 0.0)


def language_sim(a: Column, b: Column) -> Column:
    """1 if equal, 0 if two known languages differ, else null."""
    known = sorted({n for _, n in LANGUAGES} - {"unknown", "multiple"})
    return F.when(a == b, 1.0).when(a.isin(*known) & b.isin(*known), 0.0)


def mean(*sims: Column, places: int = 10) -> Column:
    """Mean of the similarities that are there; 0 if none is."""
    n = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in sims), F.lit(0))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in sims), F.lit(0.0))
    return F.when(n == 0, 0.0).otherwise(F.round(total / n, places))


# Weights of label, type and place.
WEIGHTS = (0.45, 0.25, 0.3)


def weighted(label: Column, kind: Column, place: Column) -> Column:
    """Weighted sum, what is missing as 0."""
    return sum((F.coalesce(s, F.lit(0.0)) * w for s, w in zip((label, kind, place), WEIGHTS, strict=True)), F.lit(0.0))


def typed(types: Column) -> Column:
    """Whether there is a type."""
    return types.isNotNull() & (F.size(types) > 0) & ~F.array_contains(types, NO_TYPE)


def edge_sims(domain: str, s, t, metric: str = "ct") -> dict[str, Column]:
    """Similarities of the ends of a link, by name; s and t give a column of either end."""
    if domain == "music":
        return {"sim_ata": string_sim(s("ata"), t("ata"), metric)}
    if domain == "nc":
        return {f"sim_{c}": string_sim(s(c), t(c), metric) for c in ("label", "artist", "album")} | {"sim_number": number_sim(s("number"), t("number"), "nc")}
    return {
        "sim_label": string_sim(s("label"), t("label"), metric),
        "sim_distance": geo.similarity(s("lat"), s("lon"), t("lat"), t("lon")),
        "sim_type": F.when(typed(s("types")) & typed(t("types")), type_sim(s("types"), t("types"))),
    }


def merge_sims(domain: str, s, t, metric: str = "ct") -> dict[str, Column]:
    """Similarities of two clusters that may be merged."""
    if domain == "geo":
        return {"sim_label": geo_string_sim(s("label"), t("label"), "ct"), "sim_distance": geo.similarity(s("lat"), s("lon"), t("lat"), t("lon"))}
    if domain == "music":
        return {"sim_label": string_sim(s("label"), t("label"), metric), "sim_year": near_sim(s("year"), t("year")), "sim_length": near_sim(s("length"), t("length")), "sim_number": number_sim(s("number"), t("number"))}
    return {f"sim_{c}": string_sim(s(c), t(c), metric) for c in ("label", "artist", "album")} | {"sim_number": number_sim(s("number"), t("number"))}


def addition_sim(domain: str, s, t, metric: str = "ct") -> Column:
    """Similarity of a cluster and an element of a new source."""
    if domain == "geo":
        label, place = geo_string_sim(s("label"), t("label"), metric), geo.similarity(s("lat"), s("lon"), t("lat"), t("lon"))
        return F.round(F.coalesce((place + label) / 2, label), 10)
    return string_sim(s("ata"), t("ata"), metric)
