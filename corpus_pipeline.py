"""A training corpus from ``documents``: rules, line dedup, near duplicates, mixing, packing.

Every stage works on all rows its predecessor kept, and all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it back.

Defined cases: documents with a null, empty or wordless text fail the quality rules and go;
repeated rows become one document at the line dedup's or the n-gram join's stage; rows with a null
id are documents like others, of which the n-gram join removes none; a null source is a source of
its own, to which the mixing gives the same weight as to the others; very long texts pass whole
through every stage; further columns go along untouched, whatever their names, up to the packing,
which returns its own; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from colloquy.llm.common import table, written
from colloquy.llm.tokens import public_path

#: Packing patterns come from a histogram, which SQL doesn't express.
ORACLE_SQL = None


def follow_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines of their hosts."""
    return quality_rules.cleaned(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines similar to an earlier line, down to lines of one word; those left
    without words go, and so do those that lose over four fifths of their characters: near
    copies, of which only the changed lines would be left as documents of their own."""
    return line_dedup.deduplicated(docs, most_removed=0.8)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: 5-word shingles, Jaccard 0.8."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in a global shuffle."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of up to 1024 ids with their places in sequences."""
    return packing.packed(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", follow_quality_rules),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
