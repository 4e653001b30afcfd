"""String cleaning and blocking keys as column expressions.

Null stands for every missing value inside the engine; `sane` maps the markers of missing values to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of missing values in the sources.
MISSING = ("no_label_found", "no_value", "--")
# Languages by the prefix that a spelling begins with; longer prefixes of the same start come first.
LANGUAGES = [
    ("en", "english"), ("ge", "german"), ("sp", "spanish"), ("fr", "french"), ("it", "italian"), ("la", "latin"), ("hu", "hungarian"),
    ("por", "portuguese"), ("po", "polish"), ("un", "unknown"), ("[m", "multiple"), ("ch", "chinese"), ("ca", "catalan"), ("gr", "greek"),
    ("es", "esperanto"), ("no", "norwegian"), ("sw", "swedish"), ("fi", "finnish"), ("ja", "japanese"), ("du", "dutch"), ("da", "danish"),
    ("ru", "russian"), ("tu", "turkish"),
]
MINOR_LANGUAGE, SEVERAL_LANGUAGES = "no_or_minor_lang", "multiple"
# Years below the first pivot are 2000+, up to 99 1900+; later ones than the last are wrong.
YEAR_PIVOT, LAST_YEAR = 20, 2017


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sane(x: Column | str) -> Column:
    """The string, or null for a marker of a missing value."""
    x = _c(x)
    return F.when(~x.isin(*MISSING), x)


def sane_int(x: Column | str) -> Column:
    """The number, or null for 0."""
    x = _c(x)
    return F.when(x != 0, x)


def collapse(x: Column | str) -> Column:
    """White space trimmed, runs of it made one space."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def simplify(x: Column | str) -> Column:
    """Lower case, punctuation as space, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(_c(x)), r"\p{Punct}", " "))


def geo_simplify(x: Column | str) -> Column:
    """The first part between punctuation that isn't blank, in lower case; null if there is none."""
    parts = F.filter(F.split(_c(x), r"\p{Punct}"), lambda p: F.trim(p) != "")
    return collapse(F.lower(F.get(parts, 0)))


def artist_title_album(artist: Column | str, label: Column | str, album: Column | str) -> Column:
    """The sane parts in one simplified string."""
    return simplify(F.concat_ws(" - ", sane(artist), sane(label), sane(album)))


def split_words(x: Column | str) -> Column:
    """What is no ASCII word character becomes a space, and camel case is parted."""
    spaced = F.regexp_replace(_c(x), r"[\W\p{Punct}]", " ")
    return F.regexp_replace(spaced, "(?<=[a-z])(?=[A-Z])", " ")


def geo_block_key(label: Column | str, length: int = 3) -> Column:
    """The first characters, what isn't ASCII alphanumeric as one #, padded with #."""
    if length == 0:
        return F.when(_c(label).isNotNull(), F.lit(""))
    head = F.lower(F.rpad(_c(label), length, "#"))
    return F.rpad(F.regexp_replace(head, "[^a-zA-Z0-9#]+", "#"), length, "#")


def music_block_key(label: Column | str, length: int = 4) -> Column:
    """The first characters in lower case, without a leading article and the character after it."""
    low = F.lower(_c(label))
    rest = F.when(low.startswith("the") & (F.char_length(low) > 3), F.trim(F.substring(low, 5, 1_000_000_000))).otherwise(low)
    key = F.substring(rest, 1, length)
    return F.when(key == "", F.substring(low, 1, length)).otherwise(key)


# Characters of each name for a key length.
NC_PARTS = {2: 1, 4: 2, 6: 3, 8: 4}


def nc_block_key(name: Column | str, surname: Column | str, length: int = 4) -> Column:
    """The first characters of both names, padded with spaces."""
    n = NC_PARTS.get(length, 2)
    return F.concat(F.rpad(_c(name), n, " "), F.rpad(_c(surname), n, " "))


def block_key(domain: str, length: int = 4, label: str = "label", surname: str = "artist") -> Column:
    """The key of a domain: music, nc or geo."""
    if domain == "music":
        return music_block_key(label, length)
    if domain == "nc":
        return nc_block_key(label, surname, length)
    if domain == "geo":
        return geo_block_key(label, length)
    raise ValueError(f"no blocking key for {domain}")


def trigrams(x: Column | str) -> Column:
    """Trigrams in lower case, without padding."""
    # bound by a lambda, the characters are made once; substr() would count them anew for each trigram
    grams = lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    made = F.get(F.transform(F.array(F.split(F.lower(_c(x)), "")), grams), 0)
    return F.coalesce(made, F.array().cast("array<string>"))


def padded_trigrams(x: Column | str) -> Column:
    """Trigrams of the string between two # on both sides; none of an empty string."""
    padded = F.concat(F.lit("##"), _c(x), F.lit("##"))
    return F.when(F.char_length(_c(x)) > 0, F.transform(F.sequence(F.lit(1), F.char_length(_c(x)) + 2), lambda i: F.substr(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _signed(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, -10).cast("long")


def md5_little(x: Column | str) -> Column:
    """The first eight bytes of MD5, little-endian, as a signed long."""
    digest = F.md5(_c(x).cast("binary"))
    return _signed(F.concat(*(F.substring(digest, i, 2) for i in range(15, 0, -2))))


def digest_long(x: Column | str, kind: str = "md5") -> Column:
    """The last eight bytes of MD5 or SHA-1, big-endian, as a signed long."""
    data = _c(x).cast("binary")
    return _signed(F.substring(F.md5(data), 17, 16) if kind == "md5" else F.substring(F.sha1(data), 25, 16))


def digest_int(x: Column | str, kind: str = "md5") -> Column:
    """The last four bytes of MD5 or SHA-1, big-endian, as a signed int."""
    data = _c(x).cast("binary")
    tail = F.substring(F.md5(data), 25, 8) if kind == "md5" else F.substring(F.sha1(data), 33, 8)
    whole = F.conv(tail, 16, 10).cast("long")
    return F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole).cast("int")


def song_length(x: Column | str) -> Column:
    """Seconds from many spellings: minutes and seconds, decimal minutes, seconds or milliseconds; null if unclear."""
    s = F.regexp_replace(F.lower(_c(x)), r"\s+", "")
    bad = (s == "") | (s.contains(".") & s.contains(":")) | s.rlike(r"[gq&|p\-]") | (F.char_length(s) > 11) | s.rlike(r"^[a-z]+\d{5,}$") | ~s.rlike(r"\d")
    s = F.translate(s, "olz", "012")
    # minutes and seconds by letters
    lettered = s.rlike("[ms]") & s.rlike("^[0-9]")
    t = F.when(s.contains("m") & s.contains("sec"), F.regexp_replace(s, "[^0-9msec]", "")).otherwise(s)
    t = F.when(t.contains("sec") & t.contains("n"), F.regexp_replace(t, "n", "m")).otherwise(t)
    by_letters = F.when(t.rlike(r"^\d+m\d+sec$"), F.regexp_extract(t, r"^(\d+)m", 1).try_cast("int") * 60 + F.regexp_extract(t, r"m(\d+)s", 1).try_cast("int"))
    u = F.regexp_replace(s, "[,nyur_b]", "")
    decimal = F.floor(u.try_cast("double") * 60 + 0.5).cast("int")
    minutes, seconds = F.regexp_extract(u, r"^(\d+):", 1), F.regexp_extract(u, r":(\d+)$", 1)
    # of more than two digits before the colon the last but one counts, of more than two behind it the first
    minutes = F.when(F.char_length(minutes) > 2, F.substr(minutes, F.char_length(minutes) - 1, F.lit(1))).otherwise(minutes)
    seconds = F.when(F.char_length(seconds) > 2, F.substring(seconds, 1, 1)).otherwise(seconds)
    clock = minutes.try_cast("int") * 60 + seconds.try_cast("int")
    whole = u.try_cast("int")
    plain = F.when(u.endswith("000") | (whole > 10000), F.floor(whole / 1000 + 0.5).cast("int")).otherwise(whole)
    by_number = F.when(u.rlike(r"^[0-9]+\.[0-9]+$"), decimal).when(u.rlike("^[0-9]+:[0-9]+$"), clock).when(u.rlike("^[0-9]+$"), plain)
    return F.when(~bad, F.when(lettered, by_letters).otherwise(by_number))


def year(x: Column | str) -> Column:
    """A year from '11, 04, 2009 or a longer string that holds four digits; null if unclear."""
    s = F.regexp_replace(F.regexp_replace(_c(x), r"\s+", ""), "[oO]", "0")
    short = F.regexp_extract(s, r"^'(\d+)$", 1).try_cast("int")
    plain = s.try_cast("int")
    near = lambda n: F.when(n < YEAR_PIVOT, n + 2000).when(n <= 99, n + 1900)
    # of several groups of four digits the last counts
    found = F.regexp_extract(s, r"^.*(\d{4})", 1).try_cast("int")
    return F.when(~s.rlike(r"\d{5}") & (s != ""), F.when(s.rlike(r"^'\d+$"), near(short)).when(s.rlike("^[0-9]+$"), F.coalesce(near(plain), F.when(plain <= LAST_YEAR, plain))).when((F.char_length(s) > 9) & s.rlike(r"\d{4}"), found)).cast("int")


def language(x: Column | str) -> Column:
    """The language that a spelling stands for."""
    low = F.lower(_c(x))
    out = F.when(low.contains(","), F.lit(SEVERAL_LANGUAGES))
    for prefix, name in LANGUAGES:
        out = out.when(low.startswith(prefix), F.lit(name))
    return F.when(low.isNotNull(), out.otherwise(F.lit(MINOR_LANGUAGE)))


def nc_id(x: Column | str) -> Column:
    """A number from an id of digits, s and a copy number: the copy number goes first."""
    parts = F.split(_c(x), "s")
    return F.array_join(F.reverse(parts), "").cast("long")


def exact(x: Column | str, places: int = 6) -> Column:
    """Rounded half up."""
    return F.round(_c(x), places)


def repair_digits(x: Column | str) -> Column:
    """Letters that stand for digits in scanned numbers."""
    return F.translate(_c(x), "sl|zoqg", "5112049")


def url_source(x: Column | str) -> Column:
    """Scheme and host of a URL, with the slash; null if there is none."""
    found = F.regexp_extract(_c(x), "(http://.*?/).*", 1)
    return F.when(found != "", found)


# Short names of blocking strategies.
SHORT_NAMES = {"standard": "SB", "block_split": "BS", "lsh": "LSHB"}


def output_suffix(threshold: float) -> int:
    """A threshold in names of outputs: hundredths."""
    return int(threshold * 100)


def job_name(domain: str, strategy: str, *parts: object) -> str:
    """Domain, strategy in short, and further parts, joined by dashes."""
    return "-".join(map(str, (domain, SHORT_NAMES.get(strategy, strategy), *parts)))


def described(*columns: str) -> Column:
    """A row as one line: name=value pairs, without what is missing."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws(", ", *parts)
