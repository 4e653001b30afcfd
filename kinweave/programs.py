"""Programs: whole runs from files to clusters, each a function and a command.

    python -m kinweave.programs music --input songs.csv --output out
    python -m kinweave.programs incremental-music --input songs.csv --output out --blocking block_split
    python -m kinweave.programs nc --input graph-folder --output out
    python -m kinweave.programs incremental-nc --input graph-folder --output out
    python -m kinweave.programs settlement --input graph-folder --output out
    python -m kinweave.programs links --input graph-folder --output out
    python -m kinweave.programs quality --input out --gold pairs.csv --output report --domain music
    python -m kinweave.programs rare-words --input songs.csv --output out

Clusters go to output/<step>/vertices as JSON lines. spark.checkpoint.dir must name a shared folder on a cluster.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, text, types
from .operators import blocking, evaluation
from .plans import workflows
from .plans.workflows import Config
from .session import durable
from .sources import graphs


def _entities(rows: DataFrame, sources: dict[str, int]) -> DataFrame:
    """Rows as clusters of one member."""
    return rows.withColumn("sources_int", bits.encode_one(F.col("data_source"), sources)).withColumn("clustered", F.array("id")).withColumn("data_sources", F.array("data_source"))


def songs(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a music file."""
    return durable(_entities(graphs.read_music(spark, path), bits.MUSIC_SOURCES))


def people(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and links of a voter graph in three files."""
    _, vertices, edges = graphs.read_graph_files(spark, path)
    rows, links = graphs.from_graph_files(vertices, edges, "nc")
    return durable(_entities(rows.withColumn("ata", text.artist_title_album("artist", "label", "album")), bits.NC_SOURCES)), links


def places(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and links of a graph of places in JSON lines."""
    vertices, edges = graphs.read_graph(spark, path)
    rows = graphs.typed_vertices(vertices)
    return durable(_entities(rows.withColumn("types", types.internal(F.col("types"))), bits.GEO_SOURCES)), edges.select("src", "dst")


def music(rows: DataFrame, config: Config) -> DataFrame:
    """All songs at once, and the clusters merged."""
    return workflows.merge(workflows.initial(rows, config), config)


def by_sources(rows: DataFrame, config: Config) -> DataFrame:
    """The first source as it is, then one source after another: each row joins at most one cluster."""
    (_, first), *others = sorted(config.sources, key=lambda s: s[1])
    clusters = rows.where(F.col("sources_int") == first)
    for _, bit in others:
        clusters = durable(workflows.add_source(clusters, rows.where(F.col("sources_int") == bit), config, bit))
    return clusters


def rare_words(rows: DataFrame, support: int = 2) -> DataFrame:
    """src, dst, n of the rows that share at least `support` rare words of their labels."""
    words = durable(blocking.document_words(rows.select("id", "label")))
    return blocking.word_pairs(blocking.top_words(words, blocking.inverse_frequencies(words)), support)


def quality(clusters: DataFrame, gold: DataFrame, domain: str, sources: int) -> DataFrame:
    """metric, value of clusters against known pairs (src, dst), which are closed to classes first."""
    from .operators.components import with_components

    ids = gold.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return evaluation.report(clusters, with_components(ids, gold, "class"), domain, sources)


def run(spark: SparkSession, program: str, source: str, output: str, config: Config, gold: str | None = None) -> None:
    """Run a program by its name and write what it gives."""
    step = program.replace("-", "_")
    if program in ("music", "incremental-music", "rare-words"):
        rows = songs(spark, source)
        out = music(rows, config) if program == "music" else by_sources(rows, config) if program == "incremental-music" else rare_words(rows)
    elif program in ("nc", "incremental-nc"):
        rows, links = people(spark, source)
        config = replace(config, domain="nc", sources=tuple(bits.NC_SOURCES.items()))
        out = workflows.holistic(rows, links, config) if program == "nc" else by_sources(rows, config)
    elif program in ("settlement", "links"):
        rows, links = places(spark, source)
        config = replace(config, domain="geo", sources=tuple(bits.GEO_SOURCES.items()))
        out = workflows.holistic(rows, links, config) if program == "settlement" else workflows.preprocess(rows, links, config)[1]
    elif program == "quality":
        if gold is None:
            raise ValueError("quality needs known pairs")
        found = graphs.typed_vertices(graphs.read_vertices(spark, source))
        pairs = graphs.read_gold_pairs(spark, gold) if config.domain == "nc" else graphs.read_pairs(spark, gold, ",")
        quality(found, pairs, config.domain, config.most).coalesce(1).write.mode("overwrite").json(output)
        return
    else:
        raise ValueError(f"no program {program!r}")
    if "src" in out.columns:
        graphs.write_edges(out, graphs.step_path(output, "edges", step))
        return
    renamed = {"clustered": "clusteredVertices", "data_sources": "dataSources", "blocking_label": "blockingLabel", "types": "typeIntern"}
    graphs.write_vertices(out.select(*(F.col(c).alias(renamed.get(c, c)) for c in out.columns)), graphs.step_path(output, "vertices", step))


PROGRAMS = ("music", "incremental-music", "rare-words", "nc", "incremental-nc", "settlement", "links", "quality")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinweave.programs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("program", choices=PROGRAMS)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--gold")
    parser.add_argument("--domain", default="music", choices=("music", "nc", "geo"))
    parser.add_argument("--metric", default="ct")
    parser.add_argument("--blocking", default="standard", choices=blocking.STRATEGIES)
    parser.add_argument("--block-length", type=int, default=4)
    parser.add_argument("--merge-least", type=float, default=0.7)
    parser.add_argument("--match", default="max_both", choices=("max_both", "hungarian"))
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"kinweave {given.program}").getOrCreate()
    config = Config(domain=given.domain, metric=given.metric, blocking=given.blocking, block_length=given.block_length, merge_least=given.merge_least, match=given.match)
    run(spark, given.program, given.input, given.output, config, given.gold)


if __name__ == "__main__":
    main()
