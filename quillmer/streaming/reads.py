"""Labelling as a stream: stateless labels of each micro-batch and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import canonical


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """(read_id, seq) of FASTA files as they arrive in a folder."""
    records = spark.readStream.format("text").option("lineSep", "\n>").load(folder).where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(F.regexp_replace(F.substring_index(body, "\n", 1), r"\s+$", "").alias("read_id"), seq.alias("seq"))


def running_hits(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(tid, hits): running k-mer hits of each taxon, for output mode complete or update.

    The index (kmer, tid) is a static table, so every micro-batch is one
    stream-static join and one streaming aggregate; nothing but the totals is
    kept as state.
    """
    s = F.lower("seq")
    starts = F.when(F.char_length("seq") >= k, F.sequence(F.lit(0), F.char_length("seq") - k))
    cut = reads.select(F.array_distinct(F.transform(starts, lambda i: canonical(s.substr(i + 1, F.lit(k))))).alias("ks"))
    kmers = cut.select(F.explode("ks").alias("kmer")).where(F.col("kmer").rlike("^[acgt]+$"))
    return kmers.join(index, "kmer").groupBy("tid").agg(F.count("*").alias("hits"))
