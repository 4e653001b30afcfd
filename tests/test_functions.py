"""Cleaning, keys and similarities: known values."""

import math
import struct
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import bits, geo, scalar, similarity, text, types


@pytest.fixture
def value(spark):
    def get(column):
        return spark.range(1).select(column.alias("x")).head()[0]

    return get


def many(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_geo_block_keys(spark):
    given_ = ["foobar", "f", "+5", "Long Island, NY", "安市", "Pułaczów", None]
    assert many(spark, text.geo_block_key, given_) == ["foo", "f##", "#5#", "lon", "###", "pu#", None]


def test_music_block_keys(spark):
    assert many(spark, text.music_block_key, ["The Beatles", "the", "theo x", "ab", "", "Foo bar", None]) == ["beat", "the", "x", "ab", "", "foo ", None]


def test_nc_block_key(value):
    assert value(text.nc_block_key(F.lit("smith"), F.lit("j"), 6)) == "smij  "
    assert value(text.nc_block_key(F.lit("smith"), F.lit("john"), 8)) == "smitjohn"


def test_song_lengths(spark):
    given_ = ["219", "3.663", "2m 27sec", "unk.", "402840", "03:42", "", "3:4:2", "1-2", "28q666", "2:03", "o3:42", "456000", None]
    assert many(spark, text.song_length, given_) == [219, 220, 147, None, 403, 222, None, None, None, None, 123, 222, 456, None]


def test_years(spark):
    given_ = ["'11", "'05", "04", "99", "2009", "2018", "Rain on the Harbour - Live in Japan 2011", "12345", "x", "", "2oo9", None]
    assert many(spark, text.year, given_) == [2011, 2005, 2004, 1999, 2009, None, 2011, None, None, None, 2009, None]


def test_languages(spark):
    assert many(spark, text.language, ["English", "ger", "por", "pol", "[Multiple]", "en, de", "Klingon", "", None]) == ["english", "german", "portuguese", "polish", "multiple", "multiple", "no_or_minor_lang", "no_or_minor_lang", None]


def test_ids_and_hashes(value):
    assert value(text.nc_id(F.lit("05802084s1"))) == 105802084
    for s in ("", "foo", "żółw"):
        assert value(text.md5_little(F.lit(s))) == struct.unpack("<q", hashlib.md5(s.encode()).digest()[:8])[0]
        assert value(text.digest_long(F.lit(s))) == struct.unpack(">q", hashlib.md5(s.encode()).digest()[8:])[0]
        assert value(text.digest_int(F.lit(s), "sha1")) == struct.unpack(">i", hashlib.sha1(s.encode()).digest()[-4:])[0]


def test_simplify(value):
    assert value(text.simplify(F.lit("  Foo-Bar,  (baz)  "))) == "foo bar baz"
    assert value(text.geo_simplify(F.lit(",Dresden (Sachsen)"))) == "dresden"
    assert value(text.geo_simplify(F.lit("()"))) is None
    assert value(text.artist_title_album(F.lit("A"), F.lit("no_value"), F.lit("B!"))) == "a b"
    assert value(text.split_words(F.lit("fooBar-Baz"))) == "foo Bar Baz"
    assert value(text.repair_digits(F.lit("sl|zoqg"))) == "5112049"
    assert value(text.url_source(F.lit("http://dbpedia.org/resource/x"))) == "http://dbpedia.org/"
    assert value(text.trigrams(F.lit("ABCD"))) == ["abc", "bcd"]


@pytest.mark.parametrize(("a", "b", "sim"), [("foo11111", "foo11116", 0.793857), ("foo", "foo", 1.0), ("foo", "bar", 0.0), ("", "x", 0.0)])
def test_cosine_trigrams(value, a, b, sim):
    assert value(F.round(similarity.cosine_trigram(F.lit(a), F.lit(b)), 6)) == sim
    assert round(scalar.cosine_trigram(a, b), 6) == sim


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc -.", max_size=8), st.text("abc -.", max_size=8)), min_size=1, max_size=30))
def test_column_and_scalar_similarity_agree(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", similarity.string_sim(F.col("a"), F.col("b")).alias("s"), similarity.geo_string_sim(F.col("a"), F.col("b")).alias("g")).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs, strict=True):
        assert r["s"] == pytest.approx(scalar.string_sim(a, b), abs=2e-6)
        assert (r["g"] is None) == (scalar.geo_string_sim(a, b) is None)


def test_jaro_winkler(value):
    assert value(F.round(similarity.jaro_winkler(F.lit("martha"), F.lit("marhta")), 4)) == 0.9611
    assert value(F.round(similarity.jaro_winkler(F.lit("dixon"), F.lit("dicksonx")), 4)) == 0.8133
    assert value(similarity.jaro_winkler(F.lit("a"), F.lit(None).cast("string"))) is None


def test_missing_is_not_zero(value):
    none, x = F.lit(None).cast("double"), F.lit(0.55483)
    assert value(similarity.mean(x, none, F.lit(0.843274))) == pytest.approx(0.699052)
    assert value(similarity.mean(none, none)) == 0.0
    assert value(similarity.weighted(F.lit(0.843274), none, x)) == pytest.approx(0.5459223)


def test_numbers(value):
    assert [value(similarity.near_sim(F.lit(a), F.lit(b))) for a, b in ((5, 5), (5, 6), (5, 7), (0, 5))] == [1.0, 0.5, 0.0, None]
    assert value(similarity.number_sim(F.lit("s1"), F.lit("51"), "nc")) == 1.0
    assert value(similarity.language_sim(F.lit("german"), F.lit("russian"))) == 0.0
    assert value(similarity.language_sim(F.lit("german"), F.lit("unknown"))) is None


def test_places(value):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert value(geo.distance(*lit(51.34, 12.37, 52.52, 13.40))) == pytest.approx(148_500, rel=0.01)
    assert value(geo.similarity(*lit(0, 0, 0, 0))) == 1.0
    assert value(geo.similarity(*lit(0, 0, 0, 90))) == 0.0
    assert value(geo.similarity(*lit(0, 0, 95, 0))) is None
    assert math.isclose(scalar.place_sim({"lat": 1.0, "lon": 2.0}, {"lat": 1.1, "lon": 2.0}), value(geo.similarity(*lit(1, 2, 1.1, 2))))


def test_masks(value):
    assert bits.dictionary(["b", "a", "c"]) == {"a": 1, "b": 2, "c": 4}
    assert value(bits.encode(F.array(F.lit("1"), F.lit("3"), F.lit("9")), bits.MUSIC_SOURCES)) == 5
    assert value(bits.decode(F.lit(5), bits.MUSIC_SOURCES)) == ["1", "3"]
    assert value(bits.overlap(F.lit(0), F.lit(4))) and not value(bits.overlap(F.lit(3), F.lit(4)))
    assert value(bits.contains(F.lit(7), F.lit(5)))


def test_types(value):
    assert value(types.internal(F.array(F.lit("http://dbpedia.org/ontology/Town"), F.lit("foo")))) == ["Settlement"]
    assert value(types.internal(F.array(F.lit("foo")))) == ["no_type"]
    assert value(types.internal(F.array(F.lit("islet")), F.lit("school"))) == ["School"]
    assert value(types.shade(F.array(F.lit("School"), F.lit("Park")))) == ["ArchitecturalStructure", "Park"]
    assert value(types.mask(F.array(F.lit("School"), F.lit("Park")))) == 17
    assert value(similarity.type_sim(F.array(F.lit("Country")), F.array(F.lit("Settlement")))) == 1.0
    assert value(similarity.type_sim(F.array(F.lit("Island")), F.array(F.lit("Park")))) == 0.0
