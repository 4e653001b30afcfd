"""All registered queries of the library itself, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, geo, similarity, text, types
from ..operators import blocking, corruption, evaluation, filters, groups, links, merging, representatives
from ..operators.components import with_components
from ..session import Tables, durable, scratch
from ..sources import adapters, graphs
from ..sources.adapters import GEO_EDGES_SQL, GEO_SQL, PART_EDGES_SQL, PART_SQL
from . import sql, workflows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def S(c):  # noqa: N802
    return F.col(f"s.{c}")


def T(c):  # noqa: N802
    return F.col(f"t.{c}")


# --- the flagship: clusters of parts with similar names, by links between sources


def _label_links(rows: DataFrame, least: float) -> DataFrame:
    """a, b, sim of distinct labels of a block that are similar enough, a <= b: labels are compared once, whatever rows have them."""
    labels = rows.select("label", text.music_block_key("label").alias("block")).distinct().select("block", F.col("label").alias("id"))
    found = blocking.pairs(labels, "block").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = found.select("a", "b", similarity.string_sim(F.col("a"), F.col("b")).alias("sim")).where(F.col("sim") >= least)
    return both.unionByName(labels.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim")))


_CLASSES = f"(SELECT label, data_source, min(id) AS node FROM {PART_SQL} GROUP BY ALL)"
_CLASS_EDGES = f"""(SELECT p.node AS u, q.node AS v FROM {_CLASSES} p JOIN {_CLASSES} q ON p.data_source <> q.data_source
  JOIN {sql.similar_labels("(SELECT DISTINCT p_name AS label FROM part)")} l ON l.a = p.label AND l.b = q.label
  WHERE l.sim >= 0.8 AND {sql.music_key("p.label")} = {sql.music_key("q.label")})"""


@query(
    f"""WITH class AS MATERIALIZED {_CLASSES}, edge AS MATERIALIZED {_CLASS_EDGES}, cc AS ({sql.components("class", "edge")}),
row_cc AS (SELECT p.id, p.label, CASE WHEN p.id <> c.node AND NOT EXISTS (SELECT 1 FROM edge WHERE u = c.node OR v = c.node) THEN p.id ELSE k.component END AS cluster_id
  FROM {PART_SQL} p JOIN class c ON c.label = p.label AND c.data_source = p.data_source JOIN cc k ON k.node = c.node),
n AS (SELECT cluster_id, {sql.simple("label")} AS label, count(*) AS n FROM row_cc GROUP BY ALL)
SELECT cluster_id, CAST(sum(n) AS BIGINT) AS size, first(label ORDER BY n DESC, length(label) DESC, label) AS label FROM n GROUP BY cluster_id"""
)
def cluster_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, size, label. Rows of one label and source have the same links, so components are sought among these classes."""
    rows = adapters.parts(spark, sf_dir)
    classes = durable(rows.groupBy("label", "data_source").agg(F.min("id").alias("node")))
    near = _label_links(rows, 0.8)
    side = lambda a, n: classes.select(F.col("label").alias(a), F.col("data_source").alias(f"{a}_source"), F.col("node").alias(n))
    edges = durable(near.join(side("a", "src"), "a").join(side("b", "dst"), "b").where("a_source <> b_source").select("src", "dst"))
    known = with_components(classes.select(F.col("node").alias("id")), edges).select(F.col("id").alias("node"), "cc_id")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("linked", F.lit(True))
    named = rows.join(classes.join(known, "node").join(ends, "node", "left"), ["label", "data_source"])
    # the rows of a class without any link are clusters of their own
    out = named.select("label", F.when(F.col("linked"), F.col("cc_id")).otherwise(F.col("id")).alias("cluster_id"))
    sizes = out.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.join(representatives.majority(out, "cluster_id", text.simplify("label"), "label"), "cluster_id")


# --- scalar functions


@query(f"""SELECT id, {sql.simple("label")} AS simple, {sql.music_key("label")} AS music_key, {sql.geo_key("label")} AS geo_key,
  rpad(label, 2, ' ') || rpad(artist, 2, ' ') AS nc_key, {sql.simple("artist || ' - ' || label || ' - ' || album")} AS ata FROM {PART_SQL}""")
def text_keys(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir)
    return rows.select("id", text.simplify("label").alias("simple"), text.music_block_key("label").alias("music_key"), text.geo_block_key("label").alias("geo_key"), text.nc_block_key("label", "artist").alias("nc_key"), "ata")


@query("SELECT doc_id AS id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[[:punct:]]', ' ', 'g'), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'))) AS digest FROM documents")
def simplify_documents(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select("id", F.sha2(text.simplify("label").cast("binary"), 256).alias("digest"))


@query(f"""SELECT id, trim(regexp_replace(lower(list_filter(regexp_split_to_array(label, '[[:punct:]]'), lambda x: trim(x) <> '')[1]), '\\s+', ' ', 'g')) AS simple,
  regexp_replace(regexp_replace(label, '[^a-zA-Z0-9_]|[[:punct:]]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g') AS words FROM {GEO_SQL}""")
def geo_labels(spark, sf_dir):
    return adapters.places(spark, sf_dir).select("id", text.geo_simplify("label").alias("simple"), text.split_words("label").alias("words"))


@query(f"""SELECT id, {sql.md5_little("label")} AS hash FROM {PART_SQL}""")
def md5_long_hash(spark, sf_dir):
    return adapters.parts(spark, sf_dir).select("id", text.md5_little("label").alias("hash"))


@query("""SELECT p_partkey AS id, CAST(CASE WHEN p_size < 20 THEN 2000 + p_size ELSE 1900 + p_size END AS INTEGER) AS short_year, CAST(1950 + p_size AS INTEGER) AS long_year,
  CAST(p_size * 60 + p_partkey % 60 AS INTEGER) AS clock, CAST(floor(p_size * 60 + (p_partkey % 10) * 6 + 0.5) AS INTEGER) AS minutes, CAST(p_size * 60 + 7 AS INTEGER) AS lettered,
  CAST(p_size AS INTEGER) AS millis FROM part""")
def music_numbers(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    return rows.select(
        key.alias("id"), text.year(F.concat(F.lit("'"), size)).alias("short_year"), text.year(F.concat(F.lit("Live in Dresden "), (F.col("p_size") + 1950).cast("string"))).alias("long_year"),
        text.song_length(F.concat(size, F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0"))).alias("clock"), text.song_length(F.concat(size, F.lit("."), (key % 10).cast("string"))).alias("minutes"),
        text.song_length(F.concat(size, F.lit("m 07sec"))).alias("lettered"), text.song_length(F.concat(size, F.lit("000"))).alias("millis"),
    )


@query("""SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'esperanto' ELSE 'no_or_minor_lang' END AS language FROM documents WHERE lang IS NOT NULL""")
def fix_language(spark, sf_dir):
    return adapters.documents(spark, sf_dir).where("language IS NOT NULL").select("id", text.language("language").alias("language"))


@query(f"""SELECT label, CAST(bit_or(sources_int) AS BIGINT) AS sources_int, CAST(bit_count(bit_or(sources_int)) AS INTEGER) AS n, bit_or(sources_int) & 3 <> 0 AS with_first_two, bit_or(sources_int) & 31 = 31 AS all_five,
  array_to_string(list_sort(list_distinct(list(data_source))), ',') AS names FROM {PART_SQL} GROUP BY label""")
def source_bitmask(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir).groupBy("label").agg(F.bit_or("sources_int").alias("m"), F.collect_set("data_source").alias("d"))
    again = bits.encode(F.col("d"), bits.MUSIC_SOURCES)
    three, all_ = F.lit(3).cast("long"), F.lit(31).cast("long")
    return rows.select("label", F.when(F.col("m") == again, F.col("m")).alias("sources_int"), bits.count(F.col("m")).alias("n"), bits.overlap(F.col("m"), three).alias("with_first_two"), bits.contains(F.col("m"), all_).alias("all_five"), F.array_join(bits.decode(F.col("m"), bits.MUSIC_SOURCES), ",").alias("names"))


_SHADED = "CASE types[1] WHEN 'School' THEN 'ArchitecturalStructure' WHEN 'Island' THEN 'Mountain' WHEN 'Settlement' THEN 'AdministrativeRegion' WHEN 'Country' THEN 'AdministrativeRegion' ELSE types[1] END"
_TYPE_BIT = f"CASE {_SHADED} WHEN 'ArchitecturalStructure' THEN 16 WHEN 'Mountain' THEN 8 WHEN 'AdministrativeRegion' THEN 4 WHEN 'BodyOfWater' THEN 2 WHEN 'Park' THEN 1 ELSE 0 END"


@query(f"SELECT id, types[1] AS kind, {_SHADED} AS shaded, CAST({_TYPE_BIT} AS INTEGER) AS bits FROM {GEO_SQL}")
def type_mapping(spark, sf_dir):
    names = {"School": "http://dbpedia.org/ontology/University", "Island": "islet", "Settlement": "http://schema.org/City", "Country": "http://dbpedia.org/ontology/Country", "BodyOfWater": "lake", "no_type": "nothing known"}
    table = F.create_map(*(F.lit(x) for p in names.items() for x in p))
    kinds = types.internal(F.array(F.element_at(table, F.get("types", 0))))
    return adapters.places(spark, sf_dir).select("id", kinds.alias("k")).select("id", F.get("k", 0).alias("kind"), F.get(types.shade(F.col("k")), 0).alias("shaded"), types.mask(F.col("k")).alias("bits"))


# --- similarities


def _place_pairs(spark, sf_dir):
    return blocking.pairs(adapters.places(spark, sf_dir), "nation")


@query(f"SELECT s.id AS src, t.id AS dst, {sql.place_sim()} AS sim FROM {GEO_SQL} s JOIN {GEO_SQL} t ON s.nation = t.nation AND s.id < t.id")
def haversine_sim(spark, sf_dir):
    return _place_pairs(spark, sf_dir).select("src", "dst", geo.similarity(S("lat"), S("lon"), T("lat"), T("lon")).alias("sim"))


_ALIKE = "[['ArchitecturalStructure','School'],['Mountain','Island'],['Country','Settlement'],['Settlement','AdministrativeRegion'],['AdministrativeRegion','Country']]"


def _type_sim(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} OR len(list_filter({_ALIKE}, lambda p: p = [{a}, {b}] OR p = [{b}, {a}])) > 0 THEN 1.0 ELSE 0.0 END"


@query(f"SELECT s.id AS src, t.id AS dst, {_type_sim('s.types[1]', 't.types[1]')} AS sim FROM {GEO_SQL} s JOIN {GEO_SQL} t ON s.id % 50 = t.id % 50 AND s.id < t.id")
def type_similarity(spark, sf_dir):
    rows = adapters.places(spark, sf_dir).withColumn("k", F.col("id") % 50)
    return blocking.pairs(rows, "k").select("src", "dst", similarity.type_sim(S("types"), T("types")).alias("sim"))


_NEAR = "CASE WHEN s.{0} = t.{0} THEN 1.0 WHEN abs(s.{0} - t.{0}) = 1 THEN 0.5 ELSE 0.0 END"


@query(f"""SELECT s.id AS src, t.id AS dst, {_NEAR.format("year")} AS sim_year, {_NEAR.format("length")} AS sim_length, CASE WHEN s.number = t.number THEN 1.0 END AS sim_number,
  {sql.mean([_NEAR.format("year"), _NEAR.format("length"), "CASE WHEN s.number = t.number THEN 1.0 END"])} AS sim FROM {PART_SQL} s JOIN {PART_SQL} t ON s.label = t.label AND s.artist = t.artist AND s.id < t.id""")
def number_similarities(spark, sf_dir):
    found = blocking.pairs(adapters.parts(spark, sf_dir), ["label", "artist"])
    sims = {"sim_year": similarity.near_sim(S("year"), T("year")), "sim_length": similarity.near_sim(S("length"), T("length")), "sim_number": similarity.number_sim(S("number"), T("number"))}
    return found.select("src", "dst", *(v.alias(k) for k, v in sims.items()), similarity.mean(*sims.values()).alias("sim"))


@query("""SELECT p.doc_id AS src, q.doc_id AS dst, CASE WHEN p.l = q.l THEN 1.0 WHEN p.l <> 'no_or_minor_lang' AND q.l <> 'no_or_minor_lang' THEN 0.0 END AS sim
  FROM (SELECT doc_id, source, n_chars, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'esperanto' ELSE 'no_or_minor_lang' END AS l FROM documents WHERE lang IS NOT NULL) p
  JOIN (SELECT doc_id, source, n_chars, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'esperanto' ELSE 'no_or_minor_lang' END AS l FROM documents WHERE lang IS NOT NULL) q
  ON p.n_chars = q.n_chars AND p.source = q.source AND p.doc_id < q.doc_id""")
def language_similarity(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("id"), "source", "n_chars", text.language("lang").alias("l"))
    return blocking.pairs(rows, ["source", "n_chars"]).select("src", "dst", similarity.language_sim(S("l"), T("l")).alias("sim"))


@query(f"SELECT a, b, sim FROM {sql.similar_labels('(SELECT DISTINCT p_name AS label FROM part)')} WHERE a < b AND sim >= 0.3")
def cosine_trigram_pairs(spark, sf_dir):
    """Similar pairs of the distinct names, found through shared trigrams: only names that share one are scored."""
    labels = adapters.parts(spark, sf_dir).select(F.col("label").alias("id"), text.simplify("label").alias("simple")).distinct()
    shared = labels.select("id", F.explode(F.array_distinct(text.padded_trigrams("simple"))).alias("gram"))
    found = blocking.pairs(shared, "gram").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return found.select("a", "b", similarity.string_sim(F.col("a"), F.col("b")).alias("sim")).where("sim >= 0.3")


@query(f"SELECT p.s AS a, q.s AS b, round(jaro_winkler_similarity(p.s, q.s), 6) AS sim FROM (SELECT DISTINCT {sql.simple('p_name')} AS s, substr({sql.simple('p_name')}, 1, 1) AS k FROM part) p JOIN (SELECT DISTINCT {sql.simple('p_name')} AS s, substr({sql.simple('p_name')}, 1, 1) AS k FROM part) q ON p.k = q.k AND p.s < q.s")
def jaro_winkler_pairs(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir).select(text.simplify("label").alias("id")).distinct().withColumn("k", F.substring("id", 1, 1))
    return blocking.pairs(rows, "k").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.round(similarity.jaro_winkler(F.col("src"), F.col("dst")), 6).alias("sim"))


@query(f"""SELECT s.id AS src, t.id AS dst, round(coalesce(0.25 * ({_type_sim('s.types[1]', 't.types[1]')}), 0) + 0.3 * ({sql.place_sim()}), 6) AS weighted,
  {sql.mean([f"({_type_sim('s.types[1]', 't.types[1]')})", f"({sql.place_sim()})"], 6)} AS mean FROM {GEO_SQL} s JOIN {GEO_SQL} t ON s.nation = t.nation AND s.id < t.id""")
def aggregated_similarities(spark, sf_dir):
    kind, place = similarity.type_sim(S("types"), T("types")), geo.similarity(S("lat"), S("lon"), T("lat"), T("lon"))
    none = F.lit(None).cast("double")
    return _place_pairs(spark, sf_dir).select("src", "dst", F.round(similarity.weighted(none, kind, place), 6).alias("weighted"), similarity.mean(none, kind, place, places=6).alias("mean"))


# --- blocking

_BLOCKED = f"(SELECT *, {sql.music_key('label')} || artist AS block FROM {PART_SQL})"


def _blocked(spark, sf_dir):
    return adapters.parts(spark, sf_dir).select("id", "sources_int", "label", F.concat(text.music_block_key("label"), F.col("artist")).alias("block"))


@query(f"SELECT s.id AS src, t.id AS dst FROM {_BLOCKED} s JOIN {_BLOCKED} t ON s.block = t.block AND s.id < t.id WHERE s.sources_int & t.sources_int = 0")
def standard_block_pairs(spark, sf_dir):
    return blocking.pairs(_blocked(spark, sf_dir).select("id", "sources_int", "block"), "block", blocking.disjoint(5)).select("src", "dst")


@query(f"SELECT s.id AS src, t.id AS dst FROM {_BLOCKED} s JOIN {_BLOCKED} t ON s.block = t.block AND s.id < t.id WHERE s.sources_int & t.sources_int = 0")
def block_split_pairs(spark, sf_dir):
    return blocking.split_pairs(_blocked(spark, sf_dir).select("id", "sources_int", "block"), "block", blocking.disjoint(5), limit=20).select("src", "dst")


@query(f"SELECT s.id AS src, t.id AS dst FROM {_BLOCKED} s JOIN {_BLOCKED} t ON s.block = t.block AND s.id < t.id WHERE s.sources_int & t.sources_int = 0 AND (s.sources_int = 16 OR t.sources_int = 16)")
def new_source_pairs(spark, sf_dir):
    return blocking.new_source_pairs(_blocked(spark, sf_dir).select("id", "sources_int", "block"), "block", 16).select("src", "dst")


def _geo_blocked(spark, sf_dir):
    rows = adapters.places(spark, sf_dir)
    return rows.select("id", "sources_int", types.mask(F.col("types")).cast("long").alias("types_int"), (F.col("id") % 40).alias("block"))


@query(f"""WITH r AS (SELECT *, id % 40 AS blk, {_TYPE_BIT} AS types_int FROM {GEO_SQL}),
p AS (SELECT s.id AS src, t.id AS dst FROM r s JOIN r t ON s.blk = t.blk AND s.id < t.id WHERE s.sources_int & t.sources_int = 0 AND (s.types_int = 0 OR t.types_int = 0 OR s.types_int & t.types_int <> 0))
SELECT src, dst FROM p UNION ALL SELECT id, id FROM r WHERE id NOT IN (SELECT src FROM p) AND id NOT IN (SELECT dst FROM p)""")
def geo_block_pairs_with_self(spark, sf_dir):
    return blocking.place_pairs(_geo_blocked(spark, sf_dir), "block", 5).select("src", "dst")


@query(f"""WITH p AS (SELECT s.id AS src, t.id AS dst FROM {_BLOCKED} s JOIN {_BLOCKED} t ON s.block = t.block WHERE s.sources_int <> 16 AND t.sources_int = 16)
SELECT src, dst FROM p UNION ALL SELECT id, id FROM {PART_SQL} WHERE id NOT IN (SELECT src FROM p) AND id NOT IN (SELECT dst FROM p)""")
def hungarian_candidates(spark, sf_dir):
    return blocking.two_sided(_blocked(spark, sf_dir).select("id", "sources_int", "block"), "block", 16).select("src", "dst")


@query("SELECT s.p_partkey AS src, t.p_partkey AS dst FROM part s JOIN part t ON s.p_name = t.p_name AND s.p_brand = t.p_brand AND s.p_partkey < t.p_partkey")
def edges_all(spark, sf_dir):
    return blocking.all_edges(adapters.parts(spark, sf_dir).withColumn("k", F.struct("label", "artist")), "k")


@query("SELECT m AS src, p_partkey AS dst FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS m FROM part) WHERE m < p_partkey")
def edges_simple(spark, sf_dir):
    return blocking.simple_edges(adapters.parts(spark, sf_dir).withColumn("k", F.struct("label", "artist")), "k")


@query("SELECT s.p_partkey AS src, t.p_partkey AS dst FROM part s JOIN part t ON s.p_name = t.p_name AND s.p_type = t.p_type AND s.p_brand = t.p_brand AND s.p_partkey < t.p_partkey")
def cluster_pairs(spark, sf_dir):
    clusters = adapters.parts(spark, sf_dir).groupBy("label", "album", "artist").agg(F.collect_list("id").alias("clustered"))
    return blocking.cluster_pairs(clusters)


_WORDS = f"""(SELECT doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_full_match(w, '[a-z]+') AND w NOT IN ({", ".join(f"'{w}'" for w in blocking.STOP_WORDS)})))) AS word FROM documents)"""
_IDF = f"(SELECT word, df, log10(sum(df) OVER () // df) AS idf FROM (SELECT word, count(*) AS df FROM {_WORDS} GROUP BY word))"


@query(f"SELECT word, df, round(idf, 9) AS idf FROM {_IDF}")
def tfidf_words(spark, sf_dir):
    return blocking.inverse_frequencies(blocking.document_words(adapters.documents(spark, sf_dir))).select("word", "df", F.round("idf", 9).alias("idf"))


def _top_sql(order: str, wanted: str) -> str:
    return f"""(SELECT id, word, idf FROM (SELECT id, word, idf, rank() OVER (PARTITION BY id ORDER BY {order}) AS r, {wanted} AS w
  FROM {_WORDS} JOIN {_IDF} USING (word) WHERE length(word) > 1) WHERE r <= w)"""


@query(f"SELECT id, word, round(idf, 9) AS idf FROM {_top_sql('idf DESC', 'greatest(2, ceil(count(*) OVER (PARTITION BY id) / 2))')}")
def idf_topk(spark, sf_dir):
    words = durable(blocking.document_words(adapters.documents(spark, sf_dir)))
    return blocking.top_words(words, blocking.inverse_frequencies(words)).select("id", "word", F.round("idf", 9).alias("idf"))


@query(f"SELECT id, word, round(idf, 9) AS idf FROM {_top_sql('idf', '2')}")
def idf_lowest2(spark, sf_dir):
    words = durable(blocking.document_words(adapters.documents(spark, sf_dir)))
    return blocking.top_words(words, blocking.inverse_frequencies(words), 2).select("id", "word", F.round("idf", 9).alias("idf"))


_TOP = _top_sql("idf DESC", "greatest(2, ceil(count(*) OVER (PARTITION BY id) / 2))")


@query(f"WITH t AS MATERIALIZED {_TOP} SELECT s.id AS src, t.id AS dst, count(*) AS n FROM t s JOIN t ON s.word = t.word AND s.id < t.id GROUP BY ALL HAVING count(*) >= 2")
def idf_block_pairs(spark, sf_dir):
    with Tables(spark) as tables:
        words = tables.keep(blocking.document_words(adapters.documents(spark, sf_dir)))
        return blocking.word_pairs(blocking.top_words(words, blocking.inverse_frequencies(words)), 2)


@query(f"""WITH c AS (SELECT list(word) AS c FROM (SELECT word FROM {_IDF} ORDER BY idf, word LIMIT 20)),
r AS (SELECT doc_id AS id, lower(text) AS low, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda w: NOT list_contains(c, w)), ' ') AS l FROM documents, c)
SELECT id, sha256(CASE WHEN length(l) >= 6 THEN l ELSE low END) AS digest FROM r""")
def stopword_trim(spark, sf_dir):
    rows = adapters.documents(spark, sf_dir).select("id", "label")
    trimmed = blocking.without_common(rows, blocking.common_words(blocking.inverse_frequencies(blocking.document_words(rows))))
    return trimmed.select("id", F.sha2(F.col("label").cast("binary"), 256).alias("digest"))


_TRIGRAMS = """(SELECT id, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS g
  FROM (SELECT doc_id AS id, string_split(lower(text), '') AS c FROM documents WHERE length(text) > 2))"""
_RANKED = f"(SELECT g, n, row_number() OVER (ORDER BY n DESC, g) - 1 AS bit FROM (SELECT g, count(*) AS n FROM {_TRIGRAMS} GROUP BY g))"
_POSITIONS = blocking.sampled_positions()


@query(f"""WITH x AS MATERIALIZED {_TRIGRAMS}, b AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY n DESC, g) - 1 AS bit FROM (SELECT g, count(*) AS n FROM x GROUP BY g) ORDER BY bit LIMIT 3200),
p(family, bit) AS (VALUES {", ".join(f"({f}, {p})" for f, ps in enumerate(_POSITIONS) for p in ps)}),
k AS MATERIALIZED (SELECT id, family, list_sort(list(bit)) AS key FROM x JOIN b USING (g) JOIN p USING (bit) GROUP BY ALL)
SELECT DISTINCT s.id AS src, t.id AS dst FROM k s JOIN k t ON s.family = t.family AND s.key = t.key AND s.id < t.id""")
def lsh_candidate_pairs(spark, sf_dir):
    sets, _ = blocking.trigram_ids(adapters.documents(spark, sf_dir))
    return blocking.lsh_pairs(durable(sets), _POSITIONS)


@query(f"""WITH r AS MATERIALIZED {_RANKED}, b AS (SELECT bit, n, row_number() OVER (ORDER BY n, bit) AS place, count(*) OVER () AS last FROM r WHERE bit < 3200)
SELECT CAST(bit AS INTEGER) AS bit, n, place FROM b WHERE place > 10 AND place <= last - 10""")
def bit_frequency(spark, sf_dir):
    sets, _ = blocking.trigram_ids(adapters.documents(spark, sf_dir))
    return blocking.frequent_bits(sets, 10, 10)


def _digest_int(x: str, kind: str) -> str:
    tail = f"substr({kind}({x}), {25 if kind == 'md5' else 33}, 8)"
    return f"(CASE WHEN CAST('0x' || {tail} AS BIGINT) >= 2147483648 THEN CAST('0x' || {tail} AS BIGINT) - 4294967296 ELSE CAST('0x' || {tail} AS BIGINT) END)"


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(list_transform([0, 1, 2, 3], lambda i: ((a + b * i) % 1024 + 1024) % 1024))), ',') AS bits
  FROM (SELECT doc_id AS id, {_digest_int("text", "md5")} AS a, {_digest_int("text", "sha1")} AS b FROM documents WHERE text IS NOT NULL)""")
def bloom_ops(spark, sf_dir):
    rows = adapters.documents(spark, sf_dir).where("label IS NOT NULL")
    return rows.select("id", F.array_join(F.transform(blocking.bloom_bits(F.col("label")), lambda x: x.cast("string")), ",").alias("bits"))


def _bloom_sql(x: str) -> str:
    return f"list_transform([0, 1, 2, 3], lambda i: (({_digest_int(x, 'md5')} + {_digest_int(x, 'sha1')} * i) % 1024 + 1024) % 1024)"


@query(f"SELECT doc_id AS id, list_has_all(list_concat({_bloom_sql('lang')}, {_bloom_sql('source')}), {_bloom_sql('lang')}) AS own, list_has_all({_bloom_sql('source')}, {_bloom_sql('lang')}) AS other FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def bloom_membership(spark, sf_dir):
    """Whether a filter of a row's language and source holds its language, and whether one of its source alone does."""
    rows = adapters.documents(spark, sf_dir).where("language IS NOT NULL AND data_source IS NOT NULL")
    one, two = blocking.bloom_bits(F.col("language")), blocking.bloom_bits(F.col("data_source"))
    return rows.select("id", blocking.may_hold(blocking.bloom_union(one, two), F.col("language")).alias("own"), blocking.may_hold(two, F.col("language")).alias("other"))


@query(f"""WITH b AS (SELECT block, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM {_BLOCKED} GROUP BY block)
SELECT block, n, CAST(pairs AS BIGINT) AS pairs, CAST(sum(pairs) OVER (ORDER BY block) - pairs AS BIGINT) AS before FROM b""")
def block_pair_offsets(spark, sf_dir):
    return blocking.block_offsets(_blocked(spark, sf_dir), "block")


@query(f"SELECT id, CAST(i AS INTEGER) AS index, CAST(i // 1000 AS INTEGER) AS part FROM (SELECT id, row_number() OVER (PARTITION BY block ORDER BY id) - 1 AS i FROM {_BLOCKED})")
def block_row_index(spark, sf_dir):
    return blocking.block_index(_blocked(spark, sf_dir).select("id", "block"), "block").select("id", F.col("index").cast("int").alias("index"), "part")


@query(f"SELECT s.id AS src, t.id AS dst FROM {PART_SQL} s JOIN {PART_SQL} t ON s.label = t.label WHERE s.data_source = '1' AND t.data_source = '2'")
def linked_sides(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir)
    return links.side_by_side(rows.where("data_source = '1'"), rows.where("data_source = '2'"), "label")


@query(f"SELECT s.id AS src, t.id AS dst FROM {GEO_SQL} s JOIN {GEO_SQL} t ON s.id < t.id WHERE s.sources_int & t.sources_int = 0")
def disjoint_place_pairs(spark, sf_dir):
    """Every two places of different sources: the square of a small table, as the operator has it."""
    return links.disjoint_pairs(adapters.places(spark, sf_dir), 5)


@query(f"SELECT min(p) OVER (PARTITION BY label, artist) AS cc_id, src, dst FROM (SELECT id AS p, * FROM {PART_SQL}) v JOIN (SELECT src, dst FROM {PART_EDGES_SQL} UNION SELECT dst, src FROM {PART_EDGES_SQL}) e ON e.src = v.id")
def component_edges(spark, sf_dir):
    edges = adapters.part_edges(spark, sf_dir)
    return links.component_edges(edges, with_components(adapters.parts(spark, sf_dir).select("id"), edges))


@query(f"""WITH v AS (SELECT id, data_source, min(id) OVER (PARTITION BY label, artist) AS cc_id FROM {PART_SQL}), n AS (SELECT cc_id, count(DISTINCT data_source) AS n, bool_or(data_source = '1') AS has FROM v GROUP BY cc_id)
SELECT id, cc_id FROM v WHERE cc_id IN (SELECT cc_id FROM n WHERE has) OR cc_id IN (SELECT cc_id FROM n WHERE n.n >= 3 ORDER BY cc_id LIMIT 20)""")
def sampled_components(spark, sf_dir):
    """All components with rows of source 1, and the first 20 of three sources or more: a sample by the operator's definition."""
    rows = with_components(adapters.parts(spark, sf_dir).select("id", "data_source"), adapters.part_edges(spark, sf_dir))
    return corruption.components_with_source(rows, "1", 20).select("id", "cc_id")


@query(f"SELECT v.cc_id, v.id, e.dst FROM (SELECT id, min(id) OVER (PARTITION BY label, artist) AS cc_id FROM {PART_SQL}) v LEFT JOIN {PART_EDGES_SQL} e ON e.src = v.id")
def component_fan_out(spark, sf_dir):
    edges = adapters.part_edges(spark, sf_dir)
    rows = with_components(adapters.parts(spark, sf_dir).select("id"), edges)
    return graphs.fan_out(rows, rows.select("cc_id"), edges)


# --- links and groups


def _by_source(alias: str) -> str:
    return f"JOIN {PART_SQL} s ON s.id = {alias}.src JOIN {PART_SQL} t ON t.id = {alias}.dst"


@query(f"SELECT src, dst FROM {PART_EDGES_SQL} e {_by_source('e')} WHERE s.data_source <> t.data_source")
def intra_source_links(spark, sf_dir):
    return links.between_sources(adapters.part_edges(spark, sf_dir), adapters.parts(spark, sf_dir)).select("src", "dst")


@query(f"SELECT DISTINCT src, dst FROM {GEO_EDGES_SQL} WHERE src IN (SELECT s_suppkey FROM supplier) AND dst IN (SELECT s_suppkey FROM supplier)")
def isolated_edges(spark, sf_dir):
    return links.with_known_ends(adapters.place_edges(spark, sf_dir), adapters.places(spark, sf_dir))


@query(f"SELECT id FROM {PART_SQL} WHERE id IN (SELECT src FROM {PART_EDGES_SQL}) OR id IN (SELECT dst FROM {PART_EDGES_SQL})")
def isolated_vertices(spark, sf_dir):
    return links.linked(adapters.parts(spark, sf_dir).select("id"), adapters.part_edges(spark, sf_dir))


_GEO_ENDS = f"{GEO_EDGES_SQL} e JOIN {GEO_SQL} s ON s.id = e.src JOIN {GEO_SQL} t ON t.id = e.dst"


@query(f"SELECT DISTINCT src, dst FROM {_GEO_ENDS} WHERE s.types[1] = 'no_type' OR t.types[1] = 'no_type' OR ({_SHADED.replace('types', 's.types')}) = ({_SHADED.replace('types', 't.types')})")
def type_mismatch(spark, sf_dir):
    return links.of_equal_types(adapters.place_edges(spark, sf_dir), adapters.places(spark, sf_dir))


@query("""SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS cc_id FROM part""")
def connected_components(spark, sf_dir):
    return with_components(adapters.parts(spark, sf_dir).select("id"), adapters.part_edges(spark, sf_dir))


@query("""SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS cc_id FROM documents""")
def document_components(spark, sf_dir):
    rows = adapters.documents(spark, sf_dir).select("id", "label")
    return with_components(rows.select("id"), blocking.simple_edges(rows, "label"))


@query(f"""SELECT id, nation AS cc_id, CASE WHEN types[1] = 'no_type' THEN id ELSE min(id) OVER (PARTITION BY nation, {_SHADED}) END AS group_id FROM {GEO_SQL}""")
def type_overlap_components(spark, sf_dir):
    rows = adapters.places(spark, sf_dir).withColumn("cc_id", F.col("nation"))
    return groups.by_types(rows).select("id", "cc_id", "group_id")


_GEO_SIM = f"(SELECT e.src, e.dst, {sql.place_sim()} AS agg_sim FROM {_GEO_ENDS})"


@query(f"""WITH v AS (SELECT id, types[1] <> 'no_type' AS typed, nation AS hash_cc FROM {GEO_SQL}), e AS {_GEO_SIM},
b AS (SELECT src AS id, dst AS n, agg_sim FROM e UNION ALL SELECT dst, src, agg_sim FROM e),
x AS (SELECT b.id, first(n.hash_cc ORDER BY -agg_sim, n.hash_cc) FILTER (n.typed) AS best, max(n.hash_cc) AS largest FROM b JOIN v ON v.id = b.id AND NOT v.typed JOIN v n ON n.id = b.n GROUP BY b.id)
SELECT v.id, CAST(coalesce(x.best, greatest(v.hash_cc, x.largest), v.hash_cc) AS INTEGER) AS hash_cc FROM v LEFT JOIN x ON x.id = v.id""")
def type_group_by(spark, sf_dir):
    rows = adapters.places(spark, sf_dir).withColumn("hash_cc", F.col("nation"))
    return groups.to_typed_neighbour(rows, _place_links(spark, sf_dir)).select("id", F.col("hash_cc").cast("int").alias("hash_cc"))


def _place_links(spark, sf_dir):
    ends = links.with_ends(adapters.place_edges(spark, sf_dir), adapters.places(spark, sf_dir))
    return ends.select("src", "dst", geo.similarity(S("lat"), S("lon"), T("lat"), T("lon")).alias("agg_sim"))


_PART_SIM = f"""(SELECT s.id AS src, t.id AS dst, {sql.mean([_NEAR.format("length"), "CASE WHEN s.number = t.number THEN 1.0 END", "CASE WHEN s.album = t.album THEN 1.0 ELSE 0.4 END"])} AS agg_sim
  FROM {PART_EDGES_SQL} e {_by_source("e")})"""


def _part_links(spark, sf_dir):
    ends = links.with_ends(adapters.part_edges(spark, sf_dir), adapters.parts(spark, sf_dir))
    album = F.when(S("album") == T("album"), 1.0).otherwise(0.4)
    return ends.select("src", "dst", similarity.mean(similarity.near_sim(S("length"), T("length")), similarity.number_sim(S("number"), T("number")), album).alias("agg_sim"))


@query(f"""WITH e AS {_PART_SIM}, b AS (SELECT src AS id, dst AS n, agg_sim FROM e UNION ALL SELECT dst, src, agg_sim FROM e),
m AS (SELECT id, round(avg(agg_sim), 6) AS m FROM b GROUP BY id), l AS (SELECT b.id, min(m.m) AS nm FROM b JOIN m ON m.id = b.n GROUP BY b.id)
SELECT p.id, NOT coalesce(m.m < 0.4 AND l.nm >= m.m, false) AS status, m.m AS vertex_sim FROM {PART_SQL} p LEFT JOIN m ON m.id = p.id LEFT JOIN l ON l.id = p.id""")
def sim_sort(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir).select("id", text.md5_little("label").alias("hash_cc"))
    return groups.sim_sort(rows, _part_links(spark, sf_dir), 0.4).select("id", "status", "vertex_sim")


@query(f"""WITH r AS (SELECT src, dst, agg_sim, row_number() OVER (PARTITION BY src ORDER BY agg_sim DESC, dst) AS a, row_number() OVER (PARTITION BY dst ORDER BY agg_sim DESC, src) AS b
  FROM (SELECT s.id AS src, t.id AS dst, {_NEAR.format("length")} AS agg_sim FROM {_BLOCKED} s JOIN {_BLOCKED} t ON s.block = t.block AND s.id < t.id))
SELECT src, dst, agg_sim FROM r WHERE a = 1 AND b = 1""")
def max_both(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir).select("id", "length", F.concat(text.music_block_key("label"), F.col("artist")).alias("block"))
    found = blocking.nearest_pairs(rows, "block", "length").select("src", "dst", similarity.near_sim(S("length"), T("length")).alias("agg_sim"))
    return links.max_both(found, "agg_sim")


@query()
def link_filter_basic(spark, sf_dir):
    return links.filter_basic(_part_links(spark, sf_dir), adapters.parts(spark, sf_dir))


@query(f"""WITH e AS {_PART_SIM}, c AS (SELECT id, data_source, min(id) OVER (PARTITION BY label, artist) AS cc FROM {PART_SQL}),
b AS (SELECT src AS id, dst AS n, agg_sim FROM e UNION ALL SELECT dst, src, agg_sim FROM e),
x AS (SELECT b.id, v.cc, v.data_source, avg(agg_sim) AS m FROM b JOIN c v ON v.id = b.id JOIN c n ON n.id = b.n GROUP BY ALL HAVING bool_or(v.data_source = n.data_source)),
l AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY cc, data_source ORDER BY m DESC, id) AS p FROM x) WHERE p > 1)
SELECT src, dst, agg_sim FROM e WHERE src NOT IN (SELECT id FROM l) AND dst NOT IN (SELECT id FROM l)""")
def link_filter_clustering(spark, sf_dir):
    return links.filter_clustering(_part_links(spark, sf_dir), adapters.parts(spark, sf_dir))


@query(f"""SELECT id, to_source, n FROM (SELECT id, to_source, count(*) AS n FROM (SELECT s.id, t.data_source AS to_source FROM {PART_EDGES_SQL} e {_by_source("e")} UNION ALL SELECT t.id, s.data_source FROM {PART_EDGES_SQL} e {_by_source("e")}) GROUP BY ALL) WHERE n > 1""")
def one_to_many_links(spark, sf_dir):
    return links.one_to_many(adapters.part_edges(spark, sf_dir), adapters.parts(spark, sf_dir))


@query(f"SELECT min(id) AS cc_id, count(*) AS n, count(DISTINCT data_source) AS sources FROM {PART_SQL} GROUP BY label, artist HAVING count(DISTINCT data_source) < count(*)")
def overfull_components(spark, sf_dir):
    return links.overfull_components(with_components(adapters.parts(spark, sf_dir).select("id", "data_source"), adapters.part_edges(spark, sf_dir)))


@query(f"SELECT src, dst, sim_type, sim_distance, agg_sim FROM (SELECT src, dst, sim_type, sim_distance, (coalesce(sim_type, 0) + sim_distance) / (1 + CASE WHEN sim_type IS NULL THEN 0 ELSE 1 END) AS agg_sim FROM (SELECT src, dst, CASE WHEN s.types[1] <> 'no_type' AND t.types[1] <> 'no_type' THEN {_type_sim('s.types[1]', 't.types[1]')} END AS sim_type, {sql.place_sim()} AS sim_distance FROM {_GEO_ENDS})) WHERE agg_sim >= 0.5")
def edge_similarities(spark, sf_dir):
    """Similarities of links by type and place, the mean of those that are there at least 0.5."""
    ends = links.with_ends(adapters.place_edges(spark, sf_dir), adapters.places(spark, sf_dir))
    sims = {k: v for k, v in similarity.edge_sims("geo", S, T).items() if k != "sim_label"}
    out = ends.select("src", "dst", *(v.alias(k) for k, v in sims.items()))
    return out.withColumn("agg_sim", similarity.mean(*(F.col(k) for k in sims))).where("agg_sim >= 0.5")


_LABEL_SIM = f"round({sql.dot('x', 'y')} / sqrt(({sql.dot('x', 'x')} * {sql.dot('y', 'y')})::DOUBLE), 6)"


@query(f"""SELECT * FROM (SELECT src, dst, sim_label, sim_distance, sim_type, {sql.mean(["sim_label", "sim_distance", "sim_type"])} AS agg_sim FROM (
  SELECT src, dst, {_LABEL_SIM} AS sim_label, sim_distance, sim_type FROM (SELECT e.src, e.dst, {sql.grams(sql.simple("s.label"))} AS x, {sql.grams(sql.simple("t.label"))} AS y, {sql.place_sim()} AS sim_distance,
    CASE WHEN s.types[1] <> 'no_type' AND t.types[1] <> 'no_type' THEN {_type_sim('s.types[1]', 't.types[1]')} END AS sim_type FROM {_GEO_ENDS})))
WHERE agg_sim > 0.6 AND ((agg_sim > 0.5 AND 2 + CASE WHEN sim_type IS NULL THEN 0 ELSE 1 END >= 2) OR (sim_label > 0.8 AND sim_distance > 0.7 AND coalesce(sim_type, 1) > 0.7))""")
def scored_links(spark, sf_dir):
    """Links with all similarities of places, above the usual threshold."""
    return links.with_similarity(adapters.place_edges(spark, sf_dir), adapters.places(spark, sf_dir), "geo", least=0.6).where(links.acceptable(0.5))


# --- representatives


def _majority_sql(value: str, key: str = "hash_cc") -> str:
    return f"(SELECT {key}, first(v ORDER BY n DESC, length(v) DESC, v) AS v FROM (SELECT {key}, {value} AS v, count(*) AS n FROM r GROUP BY ALL) WHERE v IS NOT NULL GROUP BY {key})"


_COMMON = "SELECT hash_cc, min(id) AS id, array_to_string(list_sort(list(id)), ',') AS clustered, array_to_string(list_sort(list_distinct(list(data_source))), ',') AS data_sources, CAST(bit_or(sources_int) AS BIGINT) AS sources_int FROM r GROUP BY hash_cc"


def _flat(df: DataFrame) -> DataFrame:
    joined = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c, t in df.dtypes if t.startswith("array")}
    return df.select(*(joined.get(c, F.col(c)) for c in df.columns))


@query(f"WITH r AS (SELECT *, {sql.simple('artist')} AS hash_cc, {sql.simple(chr(39) + chr(39) + ' || artist || ' + chr(39) + ' - ' + chr(39) + ' || label || ' + chr(39) + ' - ' + chr(39) + ' || album')} AS ata FROM {PART_SQL}) SELECT c.*, m.v AS label FROM ({_COMMON}) c LEFT JOIN {_majority_sql('ata')} m USING (hash_cc)")
def representative_music(spark, sf_dir):
    return _flat(representatives.music(adapters.parts(spark, sf_dir).withColumn("hash_cc", text.simplify("artist"))))


@query(f"WITH r AS (SELECT *, label AS hash_cc FROM {PART_SQL}) SELECT c.*, l.v AS label, a.v AS artist, b.v AS album, n.v AS number FROM ({_COMMON}) c LEFT JOIN {_majority_sql(sql.simple('label'))} l USING (hash_cc) LEFT JOIN {_majority_sql(sql.simple('artist'))} a USING (hash_cc) LEFT JOIN {_majority_sql(sql.simple('album'))} b USING (hash_cc) LEFT JOIN {_majority_sql(sql.simple('number'))} n USING (hash_cc)")
def representative_nc(spark, sf_dir):
    return _flat(representatives.nc(adapters.parts(spark, sf_dir).withColumn("hash_cc", F.col("label"))))


@query(f"""WITH r AS (SELECT *, nation % 7 AS hash_cc FROM {GEO_SQL}), o AS (SELECT *, CASE data_source WHEN 'http://sws.geonames.org/' THEN 0 WHEN 'http://dbpedia.org/' THEN 1 ELSE 2 END AS k FROM r)
SELECT c.*, m.v AS label, g.lat, g.lon, y.types FROM ({_COMMON}) c LEFT JOIN {_majority_sql(sql.simple('label'))} m USING (hash_cc)
LEFT JOIN (SELECT hash_cc, first(lat ORDER BY k, data_source, id) AS lat, first(lon ORDER BY k, data_source, id) AS lon FROM o GROUP BY hash_cc) g USING (hash_cc)
LEFT JOIN (SELECT hash_cc, array_to_string(list_sort(list_distinct(list(types[1]))), ',') AS types FROM r GROUP BY hash_cc) y USING (hash_cc)""")
def representative_geo(spark, sf_dir):
    return _flat(representatives.places(adapters.places(spark, sf_dir).withColumn("hash_cc", F.col("nation") % 7)))


# --- merging and assignment


def _merge_parts(spark, sf_dir, domain):
    return merging.merge_clusters(adapters.parts(spark, sf_dir), domain, 0.9, 5)


@query()
def merge_execution_music(spark, sf_dir):
    return _flat(_merge_parts(spark, sf_dir, "music")).select("id", "clustered", "sources_int", "label")


@query()
def merge_execution_nc(spark, sf_dir):
    return _flat(_merge_parts(spark, sf_dir, "nc")).select("id", "clustered", "sources_int", "label")


@query()
def merge_execution_geo(spark, sf_dir):
    rows = adapters.places(spark, sf_dir).withColumn("types_int", types.mask(F.col("types")))
    return _flat(merging.merge_clusters(rows, "geo", 0.75, 5, 16)).select("id", "clustered", "sources_int", "label")


@query()
def merge_init(spark, sf_dir):
    rows = adapters.places(spark, sf_dir).withColumn("hash_cc", F.col("id")).withColumn("old_hash_cc", F.when(F.col("id") % 2 == 0, F.col("nation").cast("long")))
    return merging.rejoin(rows, 0.5).select("id", "hash_cc")


def _assigned(spark, sf_dir, unmatched: bool) -> DataFrame:
    rows = adapters.parts(spark, sf_dir).select("id", "length", "data_source", F.concat(text.music_block_key("label"), F.col("artist")).alias("block"))
    sides = (rows.where(F.col("data_source") == x).select("id", "block", "length") for x in ("1", "2"))
    return merging.assign_blocks(*sides, "block", "length", F.round(1 / (1 + F.abs(S("length") - T("length"))), 6), unmatched)


@query()
def hungarian_assign(spark, sf_dir):
    return _assigned(spark, sf_dir, False)


@query()
def hungarian_unmatched(spark, sf_dir):
    """The assignment of hungarian_assign, and the rows that it leaves out as pairs of themselves."""
    return _assigned(spark, sf_dir, True)


@query()
def maximal_cliques(spark, sf_dir):
    return _flat(merging.maximal_cliques(adapters.places(spark, sf_dir), adapters.place_edges(spark, sf_dir).join(adapters.places(spark, sf_dir).select(F.col("id").alias("dst")), "dst")))


# --- workflows


_ATA = sql.simple("artist || ' - ' || label || ' - ' || album")
_ATA_SIM = f"round({sql.dot('s.g', 't.g')} / sqrt(({sql.dot('s.g', 's.g')} * {sql.dot('t.g', 't.g')})::DOUBLE), 6)"


def _music_config(**more) -> workflows.Config:
    return workflows.Config(**({"domain": "music", "incremental": False, "edge_least": 0.6} | more))


def _named_parts(spark, sf_dir):
    return adapters.parts(spark, sf_dir).withColumn("data_sources", F.array("data_source"))


@query()
def default_preprocessing(spark, sf_dir):
    rows, _ = workflows.preprocess(_named_parts(spark, sf_dir), adapters.part_edges(spark, sf_dir), _music_config())
    return rows.select("id", "cc_id", "hash_cc")


@query(f"""WITH v AS (SELECT *, min(id) OVER (PARTITION BY label, artist) AS cc FROM {PART_SQL}), e AS (SELECT s.id AS src, t.id AS dst, {_ATA_SIM} AS agg_sim FROM (SELECT *, {sql.grams(_ATA)} AS g FROM v) s JOIN (SELECT *, {sql.grams(_ATA)} AS g FROM v) t ON s.cc = t.cc AND s.id < t.id),
b AS (SELECT src AS id, dst AS n, agg_sim FROM e UNION ALL SELECT dst, src, agg_sim FROM e),
x AS (SELECT b.id, v.cc, v.data_source, avg(agg_sim) AS m FROM b JOIN v ON v.id = b.id JOIN v n ON n.id = b.n GROUP BY ALL HAVING bool_or(v.data_source = n.data_source)),
l AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY cc, data_source ORDER BY m DESC, id) AS p FROM x) WHERE p > 1)
SELECT src, dst, round(agg_sim, 6) AS agg_sim FROM e WHERE src NOT IN (SELECT id FROM l) AND dst NOT IN (SELECT id FROM l)""")
def closed_links(spark, sf_dir):
    out = workflows.close_links(adapters.parts(spark, sf_dir), adapters.part_edges(spark, sf_dir), _music_config())
    return out.select("src", "dst", F.round("agg_sim", 6).alias("agg_sim"))


@query()
def incremental_initial(spark, sf_dir):
    return _flat(workflows.initial(_named_parts(spark, sf_dir), _music_config())).select("id", "clustered", "sources_int")


@query()
def incremental_vertex(spark, sf_dir):
    rows = _named_parts(spark, sf_dir)
    return _flat(workflows.add_rows(rows.where("sources_int <> 16"), rows.where("sources_int = 16"), _music_config())).select("id", "clustered", "sources_int")


@query(f"""WITH r AS (SELECT id, sources_int, {sql.music_key("label")} AS block, {sql.simple("artist || ' - ' || label || ' - ' || album")} AS x FROM {PART_SQL}),
g AS (SELECT *, {sql.grams("x")} AS g FROM r),
p AS (SELECT s.id AS src, t.id AS dst, s.sources_int AS m, t.sources_int AS n, round({sql.dot("s.g", "t.g")} / sqrt(({sql.dot("s.g", "s.g")} * {sql.dot("t.g", "t.g")})::DOUBLE), 6) AS sim FROM g s JOIN g t ON s.block = t.block WHERE s.sources_int <> 16 AND t.sources_int = 16),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS a, row_number() OVER (PARTITION BY dst ORDER BY sim DESC, src) AS b FROM p WHERE sim >= 0.9) WHERE a = 1 AND b = 1)
SELECT least(src, dst) AS id, least(src, dst) || ',' || greatest(src, dst) AS clustered, m | n AS sources_int FROM c
UNION ALL SELECT id, CAST(id AS VARCHAR), sources_int FROM r WHERE id NOT IN (SELECT src FROM c) AND id NOT IN (SELECT dst FROM c)""")
def incremental_source(spark, sf_dir):
    rows = _named_parts(spark, sf_dir)
    out = workflows.add_source(rows.where("sources_int <> 16"), rows.where("sources_int = 16"), _music_config(merge_least=0.9), 16)
    return _flat(out).select("id", "clustered", "sources_int")


@query()
def holistic_places(spark, sf_dir):
    config = workflows.Config(domain="geo", block_length=16, sources=tuple(bits.GEO_SOURCES.items()), edge_least=0.5, sort_least=0.5, merge_least=0.75)
    return _flat(workflows.holistic(adapters.places(spark, sf_dir), adapters.place_edges(spark, sf_dir), config)).select("id", "clustered", "sources_int")


@query()
def main_source_places(spark, sf_dir):
    config = workflows.Config(domain="geo", block_length=16, sources=tuple(bits.GEO_SOURCES.items()), merge_least=0.7)
    rows = adapters.places(spark, sf_dir).withColumn("data_sources", F.array("data_source"))
    return _flat(workflows.add_main_sources(rows, config)).select("id", "clustered", "sources_int")


# --- filters


@query(f"""SELECT id FROM {PART_SQL} WHERE data_source IN ('1', '4')""")
def source_filter(spark, sf_dir):
    return filters.of_sources(adapters.parts(spark, sf_dir), ["1", "4"]).select("id")


@query(f"SELECT label, array_to_string(list_sort(list(id)), ',') AS clustered FROM {PART_SQL} GROUP BY label, artist HAVING count(*) = 2 AND bit_count(bit_or(sources_int)) < 2")
def cluster_filters(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir).groupBy("label", "artist").agg(F.array_sort(F.collect_list("id")).alias("clustered"), F.bit_or("sources_int").alias("sources_int"))
    return _flat(filters.with_room(filters.of_size(rows, 2), 2)).select("label", "clustered")


@query(f"""WITH p AS (SELECT s.id AS a, t.id AS b, s.sources_int AS m, t.sources_int AS n FROM {_BLOCKED} s JOIN {_BLOCKED} t ON s.block = t.block AND s.id < t.id WHERE s.sources_int & t.sources_int = 0)
SELECT CASE WHEN m = 16 THEN b ELSE a END AS src, CASE WHEN m = 16 THEN a ELSE b END AS dst FROM p WHERE m = 16 OR n = 16""")
def new_source_last(spark, sf_dir):
    found = blocking.new_source_pairs(_blocked(spark, sf_dir).select("id", "sources_int", "block"), "block", 16)
    return filters.new_source_last(filters.smaller_first(found), 16).select("src", "dst")


@query(f"""WITH p AS (SELECT s.id AS src, t.id AS dst FROM {_BLOCKED} s JOIN {_BLOCKED} t ON s.block = t.block AND s.id < t.id WHERE s.sources_int & t.sources_int = 0)
SELECT src AS id, src AS "to" FROM p UNION ALL SELECT dst, src FROM p""")
def merge_transitions(spark, sf_dir):
    return filters.transitions(blocking.pairs(_blocked(spark, sf_dir).select("id", "sources_int", "block"), "block", blocking.disjoint(5)))


@query(f"SELECT id FROM {PART_SQL} WHERE id NOT IN (SELECT src FROM {PART_EDGES_SQL})")
def unmatched_rows(spark, sf_dir):
    return filters.without(adapters.parts(spark, sf_dir).select("id"), adapters.part_edges(spark, sf_dir).select(F.col("src").alias("id")), "id")


@query(f"SELECT id, unnest(types) AS type FROM {GEO_SQL}")
def type_rows(spark, sf_dir):
    return filters.id_types(adapters.places(spark, sf_dir))


@query(f"""WITH e AS {_PART_SIM}, b AS (SELECT src AS id, dst AS n, agg_sim FROM e UNION ALL SELECT dst, src, agg_sim FROM e),
m AS (SELECT id, round(avg(agg_sim), 6) AS m FROM b GROUP BY id), l AS (SELECT b.id, min(m.m) AS nm FROM b JOIN m ON m.id = b.n GROUP BY b.id)
SELECT p.id, {sql.md5_little("label")} AS old_hash_cc FROM {PART_SQL} p JOIN m ON m.id = p.id JOIN l ON l.id = p.id WHERE m.m < 0.4 AND l.nm >= m.m""")
def split_off_rows(spark, sf_dir):
    """Rows that left their group for being unlike it, with the group's hash; they are not active in it."""
    rows = adapters.parts(spark, sf_dir).select("id", text.md5_little("label").alias("hash_cc"))
    found = groups.sim_sort(rows, _part_links(spark, sf_dir), 0.4)
    return filters.split_off(found).select("id", "old_hash_cc")


@query(f"SELECT id, label FROM {PART_SQL} WHERE id IN (SELECT s_suppkey FROM supplier)")
def listed_rows(spark, sf_dir):
    ids = adapters.places(spark, sf_dir).select("id")
    return corruption.sub_graph(adapters.parts(spark, sf_dir), ids).select("id", "label")


@query(f"WITH v AS (SELECT id, min(id) OVER (PARTITION BY label, artist) AS cc_id FROM {PART_SQL}) SELECT id, cc_id FROM v WHERE cc_id IN (SELECT DISTINCT cc_id FROM v ORDER BY cc_id LIMIT 20)")
def first_components(spark, sf_dir):
    """The first 20 components: a sample by the operator's definition."""
    rows = with_components(adapters.parts(spark, sf_dir).select("id"), adapters.part_edges(spark, sf_dir))
    return corruption.sample_components(rows, 20).select("id", "cc_id")


@query(f"SELECT doc_id AS id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]+') AND word NOT IN ({', '.join(repr(w) for w in blocking.STOP_WORDS)}) GROUP BY ALL")
def term_counts(spark, sf_dir):
    return blocking.term_counts(adapters.documents(spark, sf_dir))


@query(f"SELECT e.src, e.dst, s.label AS src_label, t.album AS dst_album FROM {PART_EDGES_SQL} e {_by_source('e')}")
def attached_values(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir)
    return links.with_value(links.with_value(adapters.part_edges(spark, sf_dir), rows, "src", "label", "src_label"), rows, "dst", "album", "dst_album")


@query(f"SELECT id, 'id=' || id || ', label=' || label || ', lat=' || lat AS line FROM (SELECT id, label, CAST(round(lat, 2) AS DECIMAL(9,2)) AS lat FROM {GEO_SQL})")
def described_places(spark, sf_dir):
    rows = adapters.places(spark, sf_dir).withColumn("lat", F.round("lat", 2).cast("decimal(9,2)"))
    return rows.select("id", text.described("id", "label", "lat").alias("line"))


# --- damage, quality, counts


@query("SELECT min(id) AS src, max(id) AS dst FROM (SELECT p_partkey AS id, (row_number() OVER (ORDER BY p_partkey) - 1) // 5 AS g FROM part) GROUP BY g HAVING count(*) = 5")
def corruption_add(spark, sf_dir):
    return corruption.added_edges(adapters.parts(spark, sf_dir))


@query(f"SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY src, dst) AS n FROM {PART_EDGES_SQL}) WHERE n % 4 <> 0")
def corruption_remove(spark, sf_dir):
    return corruption.without_every(adapters.part_edges(spark, sf_dir), 3)


def _rates_sql(counts: str) -> str:
    return f"SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0.0 END AS f1 FROM (SELECT *, CASE WHEN n_found > 0 THEN round(tp / n_found, 4) ELSE 0.0 END AS precision, CASE WHEN n_gold > 0 THEN round(tp / n_gold, 4) ELSE 0.0 END AS recall FROM ({counts}))"


def _cells(*keys: str) -> str:
    return f"(SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM part GROUP BY {', '.join(keys)}))"


@query(_rates_sql(f"SELECT {_cells('p_name', 'p_brand', 'p_size')} AS tp, {_cells('p_name', 'p_size')} AS n_found, {_cells('p_name', 'p_brand')} AS n_gold"))
def quality_of_clusters(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir).withColumn("g", F.struct("label", "artist")).withColumn("f", F.struct("label", "length"))
    return evaluation.quality_of_clusters(rows, "g", "f")


@query(_rates_sql(f"SELECT (SELECT count(*) FROM {PART_EDGES_SQL}) AS tp, (SELECT count(*) FROM {PART_EDGES_SQL}) AS n_found, {_cells('p_name', 'p_brand')} AS n_gold"))
def quality_prf(spark, sf_dir):
    rows = adapters.parts(spark, sf_dir).select("id", F.struct("label", "artist").alias("k"))
    return evaluation.quality_of_links(rows, "k", evaluation.sorted_pairs(adapters.part_edges(spark, sf_dir), "src", "dst"))


@query(f"SELECT data_source, count(*) AS n FROM {PART_SQL} GROUP BY data_source")
def vertex_source_counts(spark, sf_dir):
    return evaluation.vertex_counts(adapters.parts(spark, sf_dir))


@query(f"SELECT least(s.data_source, t.data_source) AS a, greatest(s.data_source, t.data_source) AS b, count(*) AS n FROM {PART_EDGES_SQL} e {_by_source('e')} GROUP BY ALL")
def edge_source_counts(spark, sf_dir):
    return evaluation.edge_counts(adapters.part_edges(spark, sf_dir), adapters.parts(spark, sf_dir))


@query("SELECT CAST(size AS INTEGER) AS size, count(*) AS n FROM (SELECT count(*) AS size FROM part GROUP BY p_name, p_brand) GROUP BY size")
def cluster_size_hist(spark, sf_dir):
    return evaluation.cluster_sizes(adapters.parts(spark, sf_dir).groupBy("label", "artist").agg(F.collect_list("id").alias("clustered")))


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM part GROUP BY p_name, p_brand) GROUP BY size")
def cc_size_hist(spark, sf_dir):
    return evaluation.component_sizes(with_components(adapters.parts(spark, sf_dir).select("id"), adapters.part_edges(spark, sf_dir)))


@query(f"SELECT count(*) AS n, count(*) FILTER (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS n_place, count(*) FILTER (types[1] <> 'no_type') AS n_type FROM {GEO_SQL}")
def property_counts(spark, sf_dir):
    return evaluation.property_counts(adapters.places(spark, sf_dir))


@query(f"SELECT data_source, count(*) AS n, min(id) AS first_id FROM {GEO_SQL} GROUP BY data_source")
def places_by_source(spark, sf_dir):
    return evaluation.places_by_source(adapters.places(spark, sf_dir))


@query(f"SELECT cc_id, CAST(bit_or(sources_int) AS BIGINT) AS sources_int, CAST(bit_count(bit_or(sources_int)) AS INTEGER) AS n_sources FROM (SELECT sources_int, min(id) OVER (PARTITION BY label, artist) AS cc_id FROM {PART_SQL}) GROUP BY cc_id")
def component_masks(spark, sf_dir):
    rows = with_components(adapters.parts(spark, sf_dir).select("id", "sources_int"), adapters.part_edges(spark, sf_dir))
    return evaluation.component_masks(rows)


# --- sources


@query(f"SELECT id, label, data_source, lat, lon, types[1] AS kind FROM {GEO_SQL}")
def json_roundtrip(spark, sf_dir):
    """Places written as a JSON graph and read back."""
    rows = adapters.places(spark, sf_dir).select("id", "label", F.col("data_source").alias("dataSource"), "lat", "lon", F.col("types").alias("typeIntern"))
    out = scratch(spark)
    graphs.write_graph(rows, adapters.place_edges(spark, sf_dir), out, "places")
    vertices, _ = graphs.read_graph(spark, out, "places")
    return graphs.typed_vertices(vertices).select("id", "label", "data_source", "lat", "lon", F.get("types", 0).alias("kind"))


@query("""SELECT p_partkey AS id, CAST(p_partkey % 7 AS BIGINT) AS cc_id, CAST(1 + p_partkey % 5 AS VARCHAR) AS data_source, p_name AS label, CAST(p_size * 60 + 5 AS INTEGER) AS length, CAST(1950 + p_size AS INTEGER) AS year, 'english' AS language FROM part""")
def csv_music_scan(spark, sf_dir):
    """Parts written as a music file and read back, cleaned."""
    rows = adapters.table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    out = scratch(spark)
    columns = {"TID": key, "CID": key % 7, "CTID": key, "SourceID": key % 5 + 1, "id": F.lit("x"), "number": size, "title": F.col("p_name"), "length": F.concat(size, F.lit(":05")), "artist": F.col("p_brand"), "album": F.col("p_type"), "year": (F.col("p_size") + 1950).cast("string"), "language": F.lit("English")}
    rows.select(*(v.alias(k) for k, v in columns.items())).write.option("header", True).csv(out)
    return graphs.read_music(spark, out).select("id", "cc_id", "data_source", "label", "length", "year", "language")
