"""Joins and filters on headers, id maps, keyword lists and lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import PLASMID_FROM

# Words that mark unpublished sequences.
PRIVATE_WORDS = ("private", "unpublished", "draft")


def with_tids(sequences: DataFrame, headers: DataFrame) -> DataFrame:
    """sequences (header, seq) with the tid of their header, from (header, tid); those without one are dropped."""
    return sequences.join(headers.select("header", "tid"), "header")


def unmapped(sequences: DataFrame, headers: DataFrame, on: str = "header") -> DataFrame:
    """Rows of sequences whose key has no entry in a map: the list of what was not found."""
    return sequences.join(headers.select(on), on, "left_anti")


def gi_of(header: Column) -> Column:
    """The number after ``gi|`` in a header; null without one."""
    return F.nullif(F.regexp_extract(header, r"gi\|(\d+)", 1), F.lit("")).cast("bigint")


def gi_tids(sequences: DataFrame, gi_map: DataFrame) -> DataFrame:
    """sequences (header, ...) with gi and the tid of the map (gi, tid); sequences without either are dropped."""
    return sequences.withColumn("gi", gi_of(F.col("header"))).join(gi_map.select("gi", "tid"), "gi")


def in_set(rows: DataFrame, wanted: DataFrame, on: str = "header") -> DataFrame:
    """The rows whose key is in the set: records of a list of headers, or one sequence by its id."""
    return rows.join(wanted.select(on), on, "left_semi")


def contaminated(name: Column, words: list[str]) -> Column:
    """Whether a name holds any of the words, as they are written."""
    return F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(name, w))


def public(rows: DataFrame, words: tuple[str, ...] = PRIVATE_WORDS) -> DataFrame:
    """Rows (tid, header) that no word marks as private and whose id is below the made-up ones."""
    marked = contaminated(F.lower("header"), [w.lower() for w in words])
    return rows.where((F.col("tid") < PLASMID_FROM) & ~F.coalesce(marked, F.lit(False)))


def lineage_matches(lineages: DataFrame, pattern: str) -> DataFrame:
    """(tid): taxa whose lineage text matches a regular expression, case ignored."""
    return lineages.where(F.col("lineage").rlike(f"(?i){pattern}")).select("tid")


def krona(summary: DataFrame, lineages: DataFrame, min_count: int = 0, min_avg: float = 0.0) -> DataFrame:
    """(tid, line): read count and lineage by tabs, for taxa with more than min_count reads of min_avg mean score or more."""
    good = summary.where((F.col("rc") > min_count) & (F.col("wrc") / F.col("rc") >= min_avg))
    return good.join(lineages, "tid").select("tid", F.concat_ws("\t", F.col("rc").cast("string"), "lineage").alias("line"))


def variant_context(variants: DataFrame, genomes: DataFrame, flank: int = 15) -> DataFrame:
    """variants (name, pos from 1, ref, alt) with before and after: the bases of the named sequence on both sides."""
    on = variants.join(genomes.select("name", "seq"), "name")
    start = F.greatest(F.col("pos") - flank, F.lit(1))
    before = F.substring("seq", start, F.col("pos") - start)
    after = F.substring("seq", F.col("pos") + F.char_length("ref"), F.lit(flank))
    return on.select(*variants.columns, before.alias("before"), after.alias("after"))
