"""The string similarity of functions.similarity for single values, where a grouped map has to score anew."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from functools import lru_cache

from .text import MISSING

_punctuation = re.compile(f"[{re.escape(string.punctuation)}]")


def sane(x: str | None) -> str | None:
    return None if x is None or x in MISSING else x


@lru_cache(maxsize=100_000)
def simplify(x: str) -> str:
    return " ".join(_punctuation.sub(" ", x.lower()).split())


@lru_cache(maxsize=100_000)
def geo_simplify(x: str) -> str | None:
    return next((" ".join(p.lower().split()) for p in _punctuation.split(x) if p.strip()), None)


@lru_cache(maxsize=100_000)
def _grams(x: str) -> Counter:
    padded = f"##{x}##"
    return Counter(padded[i : i + 3] for i in range(len(x) + 2)) if x else Counter()


def cosine_trigram(a: str, b: str) -> float:
    x, y = _grams(a), _grams(b)
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    return sum(n * y[g] for g, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def string_sim(a: str | None, b: str | None) -> float | None:
    a, b = sane(a), sane(b)
    return None if a is None or b is None else round(cosine_trigram(simplify(a), simplify(b)), 6)


def geo_string_sim(a: str | None, b: str | None) -> float | None:
    a, b = (None if sane(x) is None else geo_simplify(x) for x in (a, b))
    return None if a is None or b is None else round(cosine_trigram(a, b), 6)


def near_sim(a: int | None, b: int | None) -> float | None:
    if not a or not b:
        return None
    return 1.0 if a == b else 0.5 if abs(a - b) == 1 else 0.0


def number_sim(a: str | None, b: str | None) -> float | None:
    return 1.0 if sane(a) is not None and a == b else None


def place_sim(a: dict, b: dict) -> float | None:
    if not (_valid(a) and _valid(b)):
        return None
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    d = 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
    return 0.0 if d >= 150_000 else round(1 - d / 150_000, 6)


def _valid(x: dict) -> bool:
    return x.get("lat") is not None and x.get("lon") is not None and abs(x["lat"]) <= 90 and abs(x["lon"]) <= 180


def merge_sim(domain: str, a: dict, b: dict) -> float:
    """Mean of the similarities that are there, as similarity.merge_sims has them."""
    if domain == "geo":
        sims = [geo_string_sim(a["label"], b["label"]), place_sim(a, b)]
    elif domain == "music":
        sims = [string_sim(a["label"], b["label"]), near_sim(a["year"], b["year"]), near_sim(a["length"], b["length"]), number_sim(a["number"], b["number"])]
    else:
        sims = [*(string_sim(a[c], b[c]) for c in ("label", "artist", "album")), number_sim(a["number"], b["number"])]
    sims = [s for s in sims if s is not None]
    return round(sum(sims) / len(sims), 10) if sims else 0.0
